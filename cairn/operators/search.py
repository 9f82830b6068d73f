"""Lexical, BM25 and vector search, and their fusion by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import kind_rank
from ..functions.text import tokens
from ..session import cut, small, spread
from .aggregates import numbered


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """term, doc, tf and len: the inverted index of a text column. Null and empty texts have no posting."""
    d = spread(docs.select(doc, text)).select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("t"))
    words = d.select("doc", F.size("t").alias("len"), F.explode("t").alias("term"))
    return words.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))


def hits(docs: DataFrame, doc: str, text: str, queries: DataFrame, most_terms: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Those postings whose term is in a query, without the whole index, and one row with n and avg of all texts.

    Texts are tokenised once: what is written of each is its number of tokens and those that a
    query asks for, looked up in a hash set. ``queries``: query, text, a bounded set; more than
    ``most_terms`` different terms are refused by an error that says so.
    """
    asked = queries.select(F.explode(tokens(F.col("text"))).alias("t")).distinct().limit(most_terms + 1).collect()
    if len(asked) > most_terms:
        raise ValueError(f"the queries have more than {most_terms} terms; use postings")
    terms = [r.t for r in asked]
    d = spread(docs.select(doc, text)).select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("t"))
    d = cut(d.select("doc", F.size("t").alias("len"), F.filter("t", lambda x: x.isin(terms)).alias("t")).where("len > 0"))
    words = d.select("doc", "len", F.explode("t").alias("term"))
    return words.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf")), d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))


def bm25(index: DataFrame, docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, doc and score of every document that shares a term with a query.

    ``index`` as from ``postings`` or ``hits``; ``docs`` has one row with n (documents with text) and avg
    (their mean length); ``queries``: query, text, a bounded set. Only postings of the queries'
    terms are scored; a term's document count is over all documents.
    """
    q = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = q.select("term").distinct()
    part = index.join(wanted, "term", "left_semi")
    df = part.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = part.join(df, "term").crossJoin(F.broadcast(docs))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = s.select("term", "doc", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))).alias("w"))
    return s.join(q, "term").groupBy("query", "doc").agg(F.sum("w").alias("score"))


def corpus_size(index: DataFrame) -> DataFrame:
    """One row: n documents and their mean length, from the index."""
    return index.select("doc", "len").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))


def ranked(scores: DataFrame, group: str, score: str, key: str, n: int, digits: int = 9) -> DataFrame:
    """The first n of each group by rounded score descending, then key, with 1-based ``rank``."""
    w = Window.partitionBy(group).orderBy(F.desc("_s"), key)
    return scores.withColumn("_s", F.round(score, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_s")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays of double; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


_BLOCK = "block int, ids array<bigint>, dim int, data binary"


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of id and v packed into matrices of about ``rows`` vectors of unit length; zero and null vectors are left out."""
    n = max(1, vectors.count() // rows)

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, size = t["id"].to_numpy(), np.diff(t["v"].combine_chunks().offsets.to_numpy())
        if len(set(size.tolist())) > 1:
            raise ValueError("vectors differ in length")
        m = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        norm = np.sqrt((m * m).sum(1))
        m, ids = m[norm > 0] / norm[norm > 0, None], ids[norm > 0]
        return pa.table([pa.array([t["_b"][0].as_py()], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["block", "ids", "dim", "data"])

    dealt = vectors.where("id is not null and v is not null").select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("_b"), F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return dealt.groupBy("_b").applyInArrow(pack, _BLOCK)


def vector_neighbors(vectors: DataFrame, queries: DataFrame, n: int, *, block: int = 2048) -> DataFrame:
    """query, id, distance (1 - cosine), score (1 / (1 + distance)) and rank of each query's nearest.

    ``vectors``: id, v; ``queries``: query, v. Exact, in blocks: matrices of ``block`` queries
    meet matrices of ``block`` vectors, each pair gives its n best by one product, and the best
    of all are ranked by distance (to nine digits), then id. Nothing is broadcast unless Spark
    finds it small. All queries meet all vectors; ``indexed_neighbors`` looks at a share of them. A query is not its own neighbour; null and zero vectors have none.
    """
    q = _blocks(queries.select(F.col("query").alias("id"), "v"), block).select(F.col("ids").alias("qids"), F.col("dim").alias("qdim"), F.col("data").alias("qdata"))
    pairs = _blocks(vectors.select("id", "v"), block).crossJoin(q)  # of blocks, not of rows
    out = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("ids", "dim", "data", "qids", "qdim", "qdata")}
                if r["dim"] != r["qdim"]:
                    raise ValueError("vectors and queries differ in length")
                ids, qids = np.array(r["ids"], np.int64), np.array(r["qids"], np.int64)
                if not len(ids) or not len(qids):
                    continue
                found = _nearest(qids, np.frombuffer(r["qdata"]).reshape(len(qids), -1), ids, np.frombuffer(r["data"]).reshape(len(ids), -1), n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=out)

    return _ranked_neighbors(pairs.mapInArrow(best, "query bigint, id bigint, distance double"), n)


def fit_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of ``cells`` cells by spherical k-means on at most ``sample`` vectors, those with the least hash of their id."""
    rows = vectors.where("id is not null and v is not null").select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
    x = np.array([r.v for r in rows], float)
    if not len(x):
        return np.zeros((0, 0))
    x = x[np.sqrt((x * x).sum(1)) > 0]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    random = np.random.default_rng(seed)
    c = x[random.permutation(len(x))[: max(1, min(cells, len(x)))]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.stack([x[at == i].sum(0) if (at == i).any() else x[random.integers(len(x))] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def indexed_neighbors(vectors: DataFrame, queries: DataFrame, n: int, *, cells: int = 256, probes: int = 24, sample: int = 20_000, block: int = 2048) -> DataFrame:
    """``vector_neighbors`` by an inverted index: each query looks into the ``probes`` cells nearest to it.

    The cells are fitted on a bounded sample, but every vector lies in one of them, so a query
    meets ``probes / cells`` of the vectors. Large cells are cut into blocks of about ``block``
    vectors, and so are the queries of a cell; each block of these meets each block of those. Distances are exact; a neighbour
    beyond the probed cells is missed (tests measure a recall of 0.9 and more). The centroids,
    at most ``cells`` vectors, travel with the tasks.
    """
    centers = fit_cells(vectors.select("id", "v"), cells, sample)

    def cell_of(source: DataFrame, most: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(centers):
                    continue
                x = np.array(b.column("v").to_pylist(), float)
                near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :most]
                again = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("id").take(again), b.column("v").take(again), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

        clean = source.where("id is not null and v is not null").select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return clean.mapInArrow(run, "id bigint, v array<double>, cell int")

    placed, asked = cut(cell_of(vectors, 1)), cut(cell_of(queries.select(F.col("query").alias("id"), "v"), probes))
    part = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = F.broadcast(part(placed, "m").join(part(asked, "k"), "cell"))  # at most ``cells`` rows
    deal, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = placed.join(blocks, "cell").withColumn("_b", deal("m")).withColumn("_q", every("k")).select("cell", "_b", "_q", "id", "v")
    asks = asked.join(blocks, "cell").withColumn("_q", deal("k")).withColumn("_b", every("m")).select("cell", "_b", "_q", "id", "v")
    out = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, x = t["id"].to_numpy(), np.array(t["v"].to_pylist(), float)
        norm = np.sqrt((x * x).sum(1)) if len(x) else np.zeros(0)
        return ids[norm > 0], (x[norm > 0] / norm[norm > 0, None] if len(x) else x)

    def best(a: pa.Table, q: pa.Table) -> pa.Table:
        (ids, x), (qids, y) = unit(a), unit(q)
        found = _nearest(qids, y, ids, x, n) if len(ids) and len(qids) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(list(map(pa.array, found)), schema=out)

    pairs = mine.groupBy("cell", "_b", "_q").cogroup(asks.groupBy("cell", "_b", "_q")).applyInArrow(best, "query bigint, id bigint, distance double")
    return _ranked_neighbors(pairs, n)


def _nearest(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of each query with all up to its n-th distance, so that ties are left to the ranking."""
    d = np.round(1 - q @ x.T, 9)
    d[qids[:, None] == ids[None, :]] = np.inf
    k = min(n, len(ids)) - 1
    i, j = np.nonzero((d <= np.partition(d, k, axis=1)[:, k : k + 1]) & np.isfinite(d))
    return qids[i], ids[j], d[i, j]


def _ranked_neighbors(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("score", 1 / (1 + F.col("distance")))


def rrf(rankings: DataFrame, group: list[str], key: list[str], weights: dict[str, float] | None = None, k: int = 60, n: int | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """Fuse rankings by reciprocal ranks: group, key, score, best lane and place.

    ``rankings``: group, key, lane, source, rank. Of several sources of a lane the best rank
    counts; the weights of the lanes present in a group are made to sum to 1; order is by score
    in units of 1e-12, then key. Keys in ``pinned`` come first.
    """
    names = list((weights or {}).items())
    weight = F.coalesce(F.create_map(*[F.lit(x) for p in names for x in p])[F.col("lane")], F.lit(1.0)) if names else F.lit(1.0)
    best = rankings.groupBy(*group, *key, "lane").agg(F.min(F.struct("rank", "source")).alias("b"))
    lanes = best.select(*group, "lane").distinct().withColumn("_w", weight).groupBy(*group).agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_n")) if group else best.select("lane").distinct().withColumn("_w", weight).agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_n"))
    both = best.join(lanes, group) if group else best.crossJoin(F.broadcast(lanes))
    part = both.withColumn("_c", F.when(F.col("_t") > 0, weight / F.col("_t")).otherwise(1 / F.col("_n")) / (k + F.col("b.rank")))
    out = part.groupBy(*group, *key).agg(F.sum("_c").alias("score"), F.min_by("b.source", F.struct((-F.round(F.col("_c") * 1e12)).alias("x"), "b.source")).alias("source"))
    first = []
    if pinned is not None:
        out = out.join(pinned.select(*key, F.lit(0).alias("_pin")).distinct(), key, "left").withColumn("_pin", F.coalesce("_pin", F.lit(1)))
        first = [F.asc("_pin")]
    order = [*first, F.desc(F.round(F.col("score") * 1e12)), *key]
    if not group and n is None:  # one order over everything: by ranges, not in one task
        return numbered(out.withColumn("_u", -F.round(F.col("score") * 1e12)), [*(["_pin"] if first else []), "_u", *key], "pos").drop("_pin", "_u")
    if not group:
        out = out.orderBy(*order).limit(n)
    out = out.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).drop("_pin")
    return out if n is None else out.where(F.col("pos") <= n)


def boosted(items: DataFrame, ranks: DataFrame, weight: float = 2.0, cap: float = 2.0) -> DataFrame:
    """``items`` (id, score) times 1 + weight * rank, at most ``cap``; ``ranks``: id, score in 0..1."""
    r = ranks.select("id", F.col("score").alias("_r"))
    return items.join(r, "id", "left").withColumn("score", F.col("score") * F.least(F.lit(cap), 1 + weight * F.coalesce("_r", F.lit(0.0)))).drop("_r")


def file_penalty(path: Column) -> Column:
    """2 for adapters, tests, scripts and built or vendored paths, else 0."""
    return F.when(path.rlike(r"/adapter/|(^|/)tests/|^scripts/|\.test\.|\.spec\.|target/|vendor/"), 2).otherwise(0)


def lexical(symbols: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The first n symbols of each query by a ladder of ranks: exact, exact without case, whole words of the text, place, kind, name, id.

    ``symbols``: id, name, kind, path, text; ``queries``: query, a set so small that it is
    broadcast. A symbol matches if its name or text contains the query, without letter case. The
    query stands as whole words if spaces are around it, or one beside an end of the text.
    """
    q = small(queries.select("query", F.lower("query").alias("lq")))
    name, text, lq = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("text", F.lit(""))), F.col("lq")
    hit = symbols.join(q, F.contains(name, lq) | F.contains(text, lq))
    space = F.lit(" ")
    whole = F.contains(text, F.concat(space, lq, space)) | F.startswith(text, F.concat(lq, space)) | F.endswith(text, F.concat(space, lq))
    order = [F.when(F.col("name") == F.col("query"), 0).otherwise(1), F.when(name == lq, 0).otherwise(1), F.when(whole, 0).otherwise(1), file_penalty(F.coalesce("path", F.lit(""))), kind_rank(F.col("kind")), F.when(F.contains(name, F.col("lq")), 0).otherwise(1), F.col("id")]
    return hit.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("pos") <= n).select("query", "id", "name", "pos")


def lexical_terms(symbols: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The first n symbols of each query of several terms: most terms matched, then name and id.

    ``queries``: query, term, a set so small that it is broadcast.
    """
    q = small(queries.select("query", F.lower("term").alias("term")))
    name = F.lower(F.coalesce("name", F.lit("")))
    hit = symbols.join(q, F.contains(name, F.col("term")))
    m = hit.groupBy("query", "id", "name").agg(F.count(F.lit(1)).alias("matched"))
    w = Window.partitionBy("query").orderBy(F.desc("matched"), "name", "id")
    return m.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
