"""Queries: search over texts, names and vectors, and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..session import cut
from ..sources import graph as G
from ..sources.graph import with_tables as sql
from ..sources.tables import table
from .registry import Registry

registry = Registry()
_add = registry.add

_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9_\\s.-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
_POST = f"tk AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents WHERE text IS NOT NULL), post AS (SELECT doc_id AS doc, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tk) GROUP BY ALL)"
#: Name, text, and the vector whose neighbours the query asks for.
QUERIES = [("q1", "session log parser state", 20), ("q2", "call graph token budget", 40), ("q3", "rangfolge kaltstart", 60), ("q4", "release lunch", 80)]
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in QUERIES) + ") v(query, text, example))"


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query string, text string, example bigint")


@_add("tokenize_terms", f"WITH {_POST} SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs FROM post GROUP BY 1")
def tokenize_terms(spark: SparkSession, root: str) -> DataFrame:
    """Terms of all texts with their counts."""
    return S.postings(table(spark, root, "documents"), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


_BM25 = f"{_POST}, {_Q}, qt AS (SELECT DISTINCT query, unnest({_TOK.format('text')}) AS term FROM q), c AS (SELECT count(*) AS n, avg(len) AS avg FROM (SELECT DISTINCT doc, len FROM post)), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), b AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM post JOIN qt USING (term) JOIN df USING (term), c GROUP BY 1, 2), lane AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM b)"


def _bm25(spark: SparkSession, root: str) -> DataFrame:
    """Scores of all documents that share a term with a query."""
    d, q = table(spark, root, "documents"), _queries(spark)
    index, size = S.hits(d, "doc_id", "text", q)
    return S.bm25(index, size, q)


@_add("bm25_topk", f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM lane WHERE rank <= 75")
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    """The 75 best documents of each query."""
    return S.ranked(_bm25(spark, root), "query", "score", "doc", 75).select("query", "doc", F.round("score", 6).alias("score"), "rank")


_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), near AS (SELECT query, id, distance, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM (SELECT a.id AS query, b.id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS distance FROM v a, v b WHERE a.id % 20 = 0 AND a.id <> b.id))"


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _asked(vectors: DataFrame) -> DataFrame:
    """Searches take as queries every row whose id is divisible by 20, against all rows."""
    return vectors.where("id % 20 = 0").select(F.col("id").alias("query"), "v")


@_add("vector_topk", f"WITH {_VEC} SELECT query, id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10")
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest vectors of each query."""
    v = _vectors(spark, root)
    return S.vector_neighbors(v, _asked(v), 10).select("query", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


@_add("vector_index_topk")
def vector_index_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest vectors of each query that an inverted index of cells finds."""
    v = _vectors(spark, root)
    return S.indexed_neighbors(v, _asked(v), 10).select("query", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


# A document's vector is the one whose vec_id is its doc_id; drafts are the documents of the last three days.
_LANES = (
    f"{_BM25}, {_VEC.split(', near AS')[0]}, ev AS (SELECT doc_id AS doc, v FROM v JOIN documents ON doc_id = id), "
    "vlane AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS rank FROM (SELECT q.query, ev.doc, round(1 - list_dot_product(a.v, ev.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(ev.v, ev.v))), 9) AS distance FROM q JOIN v a ON a.id = q.example JOIN ev ON ev.doc <> q.example)), "
    "olane AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM b JOIN documents ON doc_id = doc WHERE created_at >= (SELECT max(created_at) FROM documents) - INTERVAL 3 DAY), "
    "r AS (SELECT query, doc, 'fts' AS lane, 'fts' AS source, rank FROM lane WHERE rank <= 75 UNION ALL SELECT query, doc, 'vector', 'vector', rank FROM vlane WHERE rank <= 75 UNION ALL SELECT query, doc, 'overlay', 'overlay', rank FROM olane WHERE rank <= 75), "
    "cov AS (SELECT 1000 * (SELECT count(*) FROM ev) // (SELECT count(*) FROM documents) AS permille)"
)


def _lanes(spark: SparkSession, root: str) -> DataFrame:
    """Three rankings of the same queries: terms, vectors, and terms in drafts."""
    docs, q = table(spark, root, "documents").select("doc_id", "text", "created_at"), _queries(spark)
    scores = cut(_bm25(spark, root))
    v = _vectors(spark, root)
    mine = v.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    asked = v.join(F.broadcast(q.select(F.col("example").alias("id"))), "id").select(F.col("id").alias("query"), "v")
    near = S.vector_neighbors(mine, asked, 75).join(F.broadcast(q.select("query", "example").withColumnRenamed("query", "name")), F.col("query") == F.col("example"))
    last = F.broadcast(docs.agg(F.max("created_at").alias("last")))
    drafts = docs.select(F.col("doc_id").alias("doc"), "created_at").join(last, F.col("created_at") >= F.col("last") - F.expr("interval 3 days")).select("doc")
    lane = lambda df, name: df.select("query", "doc", F.lit(name).alias("lane"), F.lit(name).alias("source"), "rank")
    out = lane(S.ranked(scores, "query", "score", "doc", 75), "fts")
    out = out.unionByName(lane(near.select(F.col("name").alias("query"), F.col("id").alias("doc"), "rank"), "vector"))
    return out.unionByName(lane(S.ranked(scores.join(drafts, "doc"), "query", "score", "doc", 75), "overlay"))


def _vector_weight(spark: SparkSession, root: str) -> float:
    """The weight 1 of the vector lane, scaled by the thousandths of documents that have a vector."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"))
    have, total = docs.join(_vectors(spark, root).select("id", F.lit(1).alias("x")), "id", "left").agg(F.count("x"), F.count(F.lit(1))).first()
    return (1000 * have // total if total else 0) / 1000


_FUSE = "SELECT query, doc, round(sum(w / t / (60 + rank)), 9) AS score FROM (SELECT r.*, {w} AS w FROM r) JOIN (SELECT query, sum({w}) AS t FROM (SELECT DISTINCT query, lane FROM r) GROUP BY 1) USING (query) GROUP BY 1, 2"
_FUSED = "pt AS (SELECT query, doc, source, rank, 1.0 / n / (60 + rank) AS c FROM r JOIN (SELECT query, count(DISTINCT lane) AS n FROM r GROUP BY 1) USING (query)), f AS (SELECT query, doc, arg_min(source, struct_pack(x := -round(c * 1e12), s := source)) AS source, row_number() OVER (PARTITION BY query ORDER BY round(sum(c) * 1e12) DESC, {key}) AS pos FROM pt {more} GROUP BY query, doc{extra})"


@_add("rrf_fuse", f"WITH {_LANES} " + _FUSE.format(w="1.0"))
def rrf_fuse(spark: SparkSession, root: str) -> DataFrame:
    """Terms, vectors and drafts fused with equal weights."""
    return S.rrf(_lanes(spark, root), ["query"], ["doc"]).select("query", "doc", F.round("score", 9).alias("score"))


@_add("rrf_weighted", f"WITH {_LANES} " + _FUSE.format(w="CASE lane WHEN 'vector' THEN (SELECT permille FROM cov) / 1000 ELSE 1.0 END"))
def rrf_weighted(spark: SparkSession, root: str) -> DataFrame:
    """The same, the vector lane weighted by how many documents have a vector."""
    return S.rrf(_lanes(spark, root), ["query"], ["doc"], {"vector": _vector_weight(spark, root)}).select("query", "doc", F.round("score", 9).alias("score"))


@_add("rrf_entities", f"WITH {_LANES}, " + _FUSED.format(key="doc, kind", more="JOIN (SELECT doc_id AS doc, doc_kind AS kind FROM documents) USING (doc)", extra=", kind").replace("SELECT query, doc, arg_min", "SELECT query, doc, kind, arg_min") + " SELECT query, doc, kind, source, CAST(pos AS INT) AS pos FROM f WHERE pos <= 20")
def rrf_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entities of several kinds fused under composite keys, 20 for each query."""
    keyed = _lanes(spark, root).join(table(spark, root, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_kind").alias("kind")), "doc")
    return S.rrf(keyed, ["query"], ["doc", "kind"], n=20).select("query", "doc", "kind", "source", "pos")


@_add("rrf_evidence", f"WITH {_LANES}, " + _FUSED.format(key="doc", more="", extra="") + " SELECT query, source, CAST(count(*) AS BIGINT) AS candidates, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos <= 20), '') AS positions FROM (SELECT r.query, r.source, f.pos FROM r JOIN f USING (query, doc)) GROUP BY 1, 2")
def rrf_evidence(spark: SparkSession, root: str) -> DataFrame:
    """How many candidates each source gave, and where they stand among the first 20 fused ones."""
    lanes = cut(_lanes(spark, root))
    fused = S.rrf(lanes, ["query"], ["doc"]).select("query", "doc", "pos")
    at = F.array_sort(F.collect_list(F.when(F.col("pos") <= 20, F.col("pos"))))
    return lanes.join(fused, ["query", "doc"]).groupBy("query", "source").agg(F.count(F.lit(1)).alias("candidates"), F.array_join(at, ",").alias("positions"))


_BOXES = "dk AS (SELECT doc_id AS doc, coalesce(repo_id, '') || ':' || coalesce(doc_kind, '') AS box FROM documents), bx AS (SELECT query, box, row_number() OVER (PARTITION BY query ORDER BY min(rank), box) AS rank FROM r JOIN dk USING (doc) WHERE lane = 'vector' GROUP BY 1, 2), rc AS (SELECT query, doc, 'fts' AS lane, rank FROM r WHERE lane = 'fts' UNION ALL SELECT query, doc, 'vector', bx.rank FROM bx JOIN dk USING (box) WHERE bx.rank <= 5)"


@_add("rrf_context", f"WITH {_LANES}, {_BOXES} SELECT query, doc, round(sum(1.0 / n / (60 + rank)), 9) AS score FROM rc JOIN (SELECT query, count(DISTINCT lane) AS n FROM rc GROUP BY 1) USING (query) GROUP BY 1, 2")
def rrf_context(spark: SparkSession, root: str) -> DataFrame:
    """Term ranks of documents fused with vector ranks of their containers, which fan out to all documents of each."""
    lanes = cut(_lanes(spark, root))
    box = F.concat_ws(":", F.coalesce("repo_id", F.lit("")), F.coalesce("doc_kind", F.lit("")))
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), box.alias("box"))
    best = lanes.where("lane = 'vector'").join(docs, "doc").groupBy("query", "box").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("query").orderBy("at", "box")
    boxes = best.withColumn("rank", F.row_number().over(w)).where("rank <= 5").drop("at")
    wide = docs.join(F.broadcast(boxes), "box").select("query", "doc", F.lit("vector").alias("lane"), F.lit("fileSummary").alias("source"), "rank")
    return S.rrf(lanes.where("lane = 'fts'").unionByName(wide), ["query"], ["doc"]).select("query", "doc", F.round("score", 9).alias("score"))


@_add("ppr_boost", sql("met", "SELECT id, round(fan_in * least(2, 1 + 2 * page_rank / (SELECT max(page_rank) FROM met)), 6) AS score FROM met WHERE fan_in > 0"))
def ppr_boost(spark: SparkSession, root: str) -> DataFrame:
    """Scores raised by rank, twofold at most."""
    m = G.metrics(spark, root)
    ranks = m.crossJoin(F.broadcast(m.agg(F.max("page_rank").alias("top")))).select("id", (F.col("page_rank") / F.col("top")).alias("score"))
    return S.boosted(m.where("fan_in > 0").select("id", F.col("fan_in").cast("double").alias("score")), ranks).select("id", F.round("score", 6).alias("score"))


@_add("feedback_boost", "SELECT user_id, round(least(1, sum(0.3 * value / 100 * CASE event_type WHEN 'click' THEN 1.5 ELSE 1 END)), 6) AS boost FROM events WHERE value >= 0 GROUP BY 1")
def feedback_boost(spark: SparkSession, root: str) -> DataFrame:
    """Boosts of hits summed, those of the same kind half more, 1 at most."""
    e = table(spark, root, "events").where("value >= 0")
    one = 0.3 * F.col("value") / 100 * F.when(F.col("event_type") == "click", 1.5).otherwise(1.0)
    return e.groupBy("user_id").agg(F.round(F.least(F.lit(1.0), F.sum(one)), 6).alias("boost"))


TERMS = ["split", "Batch", "render", "token"]
_TERMS = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") k(query)"


@_add("lexical_search", sql("sym fil", f"SELECT query, id, name, CAST(pos AS INT) AS pos FROM (SELECT query, s.id, s.name, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN s.name = query THEN 0 ELSE 1 END, CASE WHEN lower(s.name) = lower(query) THEN 0 ELSE 1 END, CASE WHEN contains(lower(coalesce(s.summary, '')), ' ' || lower(query) || ' ') OR starts_with(lower(coalesce(s.summary, '')), lower(query) || ' ') OR ends_with(lower(coalesce(s.summary, '')), ' ' || lower(query)) THEN 0 ELSE 1 END, CASE WHEN regexp_matches(coalesce(path, ''), '/adapter/|(^|/)tests/|^scripts/|\\.test\\.|\\.spec\\.|target/|vendor/') THEN 2 ELSE 0 END, coalesce(list_position(['class', 'function', 'interface', 'type', 'method', 'constructor', 'module'], s.kind), 8), CASE WHEN contains(lower(s.name), lower(query)) THEN 0 ELSE 1 END, s.id) AS pos FROM sym s LEFT JOIN fil f USING (file_id), {_TERMS} WHERE contains(lower(s.name), lower(query)) OR contains(lower(coalesce(s.summary, '')), lower(query))) WHERE pos <= 50"))
def lexical_search(spark: SparkSession, root: str) -> DataFrame:
    """Symbols by a ladder of ranks, many queries in one pass."""
    s = G.symbols(spark, root).join(G.files(spark, root).select("file_id", "path"), "file_id", "left").select("id", "name", "kind", "path", F.col("summary").alias("text"))
    return S.lexical(s, spark.createDataFrame([(t,) for t in TERMS], "query string"), 50)


@_add("lexical_multi_term", sql("sym", "SELECT id, name, matched, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (ORDER BY matched DESC, name, id) AS pos FROM (SELECT id, name, count(*) AS matched FROM sym JOIN (VALUES ('split'), ('batch'), ('safe')) k(term) ON contains(lower(name), term) GROUP BY 1, 2)) WHERE pos <= 100"))
def lexical_multi_term(spark: SparkSession, root: str) -> DataFrame:
    """Symbols by the number of terms in their name."""
    q = spark.createDataFrame([("q", t) for t in ("split", "Batch", "safe")], "query string, term string")
    return S.lexical_terms(G.symbols(spark, root).select("id", "name"), q, 100).drop("query")


@_add("subword_terms", sql("sym", "SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS term FROM sym) GROUP BY 1"))
def subword_terms(spark: SparkSession, root: str) -> DataFrame:
    """Parts of all names, counted."""
    return G.symbols(spark, root).select(F.explode(T.subwords(F.col("name"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, CAST(i AS BIGINT), 3)))"


@_add("trigram_jaccard", sql("sym", f"SELECT id, round(CASE WHEN length(n) >= 3 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM (SELECT id, lower(name) AS n, {_GRAMS.format('lower(name)')} AS a, {_GRAMS.format(chr(39) + 'splitbatch' + chr(39))} AS b FROM sym WHERE name IS NOT NULL)"))
def trigram_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """Trigram similarity of all names to one."""
    return G.symbols(spark, root).where("name is not null").select("id", F.round(T.trigram_similarity(F.lower("name"), F.lit("splitbatch")), 6).alias("similarity"))


RELEVANCE = ["splitBatch", "split*", "*atch?", "load*ledger", "load ledger", "batch of split", "render_token", "splitBatchNowAndThen", "core", "zzz qqq"]
_SUB = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2)"
_GLOB = "regexp_replace(regexp_replace(regexp_replace(lower(query), '([.+^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '\\*', '.*', 'g'), '\\?', '.', 'g')"
_RELEVANCE = (
    f"n AS (SELECT id, lower(name) AS n, {_SUB.format('name')} AS np, {_GRAMS.format('lower(name)')} AS ng FROM sym WHERE name IS NOT NULL), "
    f"q AS (SELECT query, lower(query) AS q, {_SUB.format('query')} AS qp, {_GRAMS.format('lower(query)')} AS qg, list_filter(regexp_split_to_array(lower(query), '[\\s_]+'), lambda x: length(x) >= 3) AS ws, {_GLOB} AS pattern, regexp_matches(query, '[*?]') AS star FROM (VALUES " + ", ".join(f"('{x}')" for x in RELEVANCE) + ") k(query)), "
    "m AS (SELECT id, query, n, q, np, qp, ws, star, pattern, len(list_filter(qp, lambda x: len(list_filter(np, lambda y: contains(y, x) OR contains(x, y))) > 0)) AS hq, len(list_filter(np, lambda x: len(list_filter(qp, lambda y: contains(y, x) OR contains(x, y))) > 0)) AS hn, len(list_filter(ws, lambda x: contains(n, x))) AS said, list_filter(np, lambda x: length(x) >= 3) AS long, CASE WHEN length(n) >= 3 AND length(q) >= 3 THEN len(list_intersect(ng, qg)) / len(list_distinct(list_concat(ng, qg))) ELSE 0 END AS tri FROM n, q)"
)


@_add("relevance_tiers", sql("sym", "SELECT id, query, round(CASE WHEN n = q THEN 1 WHEN star AND regexp_full_match(n, pattern) THEN 0.9 WHEN star AND regexp_matches(n, pattern) THEN 0.75 WHEN starts_with(n, q) THEN 0.85 WHEN contains(n, q) THEN 0.7 WHEN starts_with(q, n) AND length(n) >= 3 THEN 0.65 WHEN len(qp) >= 2 AND len(np) >= 2 AND hq = len(qp) THEN 0.8 WHEN len(qp) >= 2 AND len(np) >= 2 AND hn = len(np) THEN 0.7 WHEN len(qp) >= 2 AND len(np) >= 2 AND (hq > 0 OR hn > 0) THEN least(0.79, 0.15 + 0.25 * greatest(hq / len(qp), hn / len(np)) + 0.35 * tri) WHEN len(ws) > 1 AND said > 0 THEN 0.3 + 0.3 * said / len(ws) WHEN length(n) >= 3 AND contains(q, n) THEN 0.5 WHEN tri >= 0.3 THEN 0.1 + 0.3 * tri WHEN len(list_filter(long, lambda x: contains(q, x))) > 0 THEN 0.1 + 0.15 * len(list_filter(long, lambda x: contains(q, x))) / greatest(len(long), 1) ELSE 0.05 END, 6) AS relevance FROM m", _RELEVANCE))
def relevance_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Relevance of all names to queries of every kind: names, globs, several words."""
    q = F.broadcast(spark.createDataFrame([(x,) for x in RELEVANCE], "query string").withColumn("qp", T.subwords(F.col("query"))))
    n = G.symbols(spark, root).where("name is not null").select("id", "name", T.subwords(F.col("name")).alias("np")).join(q, F.lit(True))
    return n.select("id", "query", F.round(T.relevance(F.col("name"), F.col("query"), F.col("np"), F.col("qp")), 6).alias("relevance"))


@_add("token_estimate", "SELECT doc_id, CAST(ceil((length(t) - length(p)) + length(p) / 3.5) AS BIGINT) AS tokens, CAST(ceil(length(t) / 4.0) AS BIGINT) AS coarse, CAST(ceil(length(t) / 3.2) AS BIGINT) AS packed FROM (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), '{}[]:,\"', '') AS p FROM documents)")
def token_estimate(spark: SparkSession, root: str) -> DataFrame:
    """Three estimates of the tokens of every text."""
    t = F.col("text")
    return table(spark, root, "documents").select("doc_id", T.token_estimate(t).alias("tokens"), T.coarse_estimate(t).alias("coarse"), T.packed_estimate(t).alias("packed"))


@_add("card_tokens", sql("sym edg", "SELECT s.id, CAST(50 + ceil(length(coalesce(name, '')) / 4.0) + ceil(length(coalesce(signature_json, '')) / 4.0) + least(ceil(length(coalesce(summary, '')) / 4.0), 150) + 5 * coalesce(n, 0) AS BIGINT) AS tokens FROM sym s LEFT JOIN (SELECT src AS id, count(*) AS n FROM edg GROUP BY 1) USING (id)"))
def card_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Estimated tokens of every symbol's card."""
    n = G.edges(spark, root).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return G.symbols(spark, root).join(n, "id", "left").select("id", T.card_estimate(F.col("name"), F.col("signature_json"), F.col("summary"), F.coalesce("n", F.lit(0))).alias("tokens"))


def _redact_sql() -> str:
    out = "text"
    for name, pattern in T.SECRETS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED:{name}]', 'gi')"
    return out


@_add("redact_secrets", f"SELECT doc_id, sha256({_redact_sql()}) AS digest FROM documents WHERE text IS NOT NULL")
def redact_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Digest of every text without its secrets."""
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("digest"))


@_add("secret_files", sql("fil", "SELECT file_id FROM fil WHERE " + " OR ".join(f"ends_with(translate(path, chr(92), '/'), '{x}')" for x in T.SECRET_ENDS)))
def secret_files(spark: SparkSession, root: str) -> DataFrame:
    """Files whose paths say that they hold secrets."""
    return G.files(spark, root).where(T.may_hold_secrets(F.col("path"))).select("file_id")


_STOPS = ", ".join(f"'{x}'" for x in T.STOP_WORDS)


@_add("task_seed_tokens", f"WITH tk AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents WHERE text IS NOT NULL)), k AS (SELECT doc_id, token, min(i) AS i FROM tk WHERE length(token) >= 3 AND token NOT IN ({_STOPS}) AND NOT regexp_full_match(token, '[0-9]+') AND regexp_matches(token, '[a-z]') GROUP BY 1, 2) SELECT doc_id, CAST(pos AS INT) AS pos, token FROM (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(token, '[._-]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(token, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN length(token) >= 8 THEN 1 ELSE 0 END DESC, length(token) DESC, i) - 1 AS pos FROM k) WHERE pos < 24")
def task_seed_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The 24 most telling tokens of every text."""
    return table(spark, root, "documents").select("doc_id", F.posexplode(T.seed_tokens(F.col("text"))).alias("pos", "token"))


_JOINED = (
    "w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z]{3,}'), lambda x: lower(x)), lambda x: x NOT IN (" + ", ".join(f"'{x}'" for x in T.JOIN_STOP_WORDS) + ")) AS w FROM documents WHERE text IS NOT NULL), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, w[i] AS a, w[i + 1] AS b, min(i) AS i FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY 1, 2, 3)), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, min(i) AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY 1, 2, 3, 4)), "
    "np AS (SELECT doc_id, least(10, count(*)) AS np FROM p GROUP BY 1), cap AS (SELECT doc_id, a, b, NULL AS c FROM p WHERE k <= 10 UNION ALL SELECT doc_id, a, b, c FROM t JOIN np USING (doc_id) WHERE k <= ceil((40 - 3 * np) / 2.0)), "
    "j AS (SELECT doc_id, a || upper(b[1]) || b[2:] || coalesce(upper(c[1]) || c[2:], '') AS name FROM cap UNION ALL SELECT doc_id, upper(a[1]) || a[2:] || upper(b[1]) || b[2:] || coalesce(upper(c[1]) || c[2:], '') FROM cap UNION ALL SELECT doc_id, a || '_' || b FROM cap WHERE c IS NULL)"
)


@_add("text_identifiers", f"WITH {_JOINED} SELECT name, 'joined' AS how, count(*) AS docs FROM j GROUP BY 1 UNION ALL SELECT name, 'written', count(*) FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{T.IDENTIFIER}', 1)) AS name FROM documents) GROUP BY 1")
def text_identifiers(spark: SparkSession, root: str) -> DataFrame:
    """Names in texts, counted, with names joined from adjacent words."""
    d = table(spark, root, "documents")
    found = d.select(F.explode(T.identifiers(F.col("text"))).alias("name"), F.lit("written").alias("how")).unionByName(d.select(T.join_words(F.col("text")).alias("w")).select(F.explode(T.compounds(F.col("w"))).alias("name"), F.lit("joined").alias("how")))
    return found.groupBy("name", "how").agg(F.count(F.lit(1)).alias("docs"))


@_add("file_hash_ids", sql("fil", "SELECT file_id, sha256(repo_id || ':' || path) AS id, sha256(head_text) AS head FROM fil WHERE path IS NOT NULL"))
def file_hash_ids(spark: SparkSession, root: str) -> DataFrame:
    """Content and identity hashes."""
    return G.files(spark, root).where("path is not null").select("file_id", T.file_id(F.col("repo_id"), F.col("path")).alias("id"), F.sha2("head_text", 256).alias("head"))


@_add("name_hashes", sql("sym", "SELECT name, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS hash FROM (SELECT DISTINCT name, hex(encode(coalesce(name, ''))) AS h FROM sym)"))
def name_hashes(spark: SparkSession, root: str) -> DataFrame:
    """32-bit hash of every distinct name."""
    return G.symbols(spark, root).select("name").distinct().select("name", T.fnv1a32(F.col("name")).alias("hash"))


@_add("target_names", sql("edg", "SELECT DISTINCT dst AS target, CASE WHEN starts_with(dst, 'unresolved:call:') THEN 'call' ELSE 'import' END AS kind FROM edg WHERE starts_with(dst, 'unresolved:')"))
def target_names(spark: SparkSession, root: str) -> DataFrame:
    """Unresolved targets by kind."""
    d = F.col("dst")
    return G.edges(spark, root).where(d.startswith("unresolved:")).select(d.alias("target"), F.when(d.startswith("unresolved:call:"), "call").otherwise("import").alias("kind")).distinct()


_LINES = "ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


@_add("line_search_context", f"WITH {_LINES}, hit AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM ln WHERE regexp_matches(line, 'token|symbol', 'i')) WHERE pos <= 50), isl AS (SELECT doc_id, n, sum(CASE WHEN n - prev <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM hit)), mx AS (SELECT doc_id, max(n) AS last FROM ln GROUP BY 1) SELECT doc_id, CAST(greatest(1, min(n) - 2) AS INT) AS first_line, CAST(least(any_value(last), max(n) + 2) AS INT) AS last_line, count(*) AS hits FROM isl JOIN mx USING (doc_id) GROUP BY doc_id, g")
def line_search_context(spark: SparkSession, root: str) -> DataFrame:
    """Line ranges of a pattern with two lines around it, touching ranges merged, 50 hits a text."""
    lines = table(spark, root, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("ls"))
    ln = lines.select("doc_id", F.size("ls").alias("last"), F.posexplode("ls").alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    hit = ln.where(F.col("line").rlike("(?i)token|symbol")).select("doc_id", "last", (F.col("n") + 1).alias("n")).withColumn("pos", F.row_number().over(w)).where("pos <= 50")
    isl = hit.withColumn("new", F.when(F.col("n") - F.lag("n").over(w) <= 5, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return isl.groupBy("doc_id", "g").agg(F.greatest(F.lit(1), F.min("n") - 2).alias("first_line"), F.least(F.max("last"), F.max("n") + 2).alias("last_line"), F.count(F.lit(1)).alias("hits")).drop("g")


@_add("token_truncate_prefix", f"WITH {_LINES} SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(used) AS BIGINT) AS used FROM (SELECT doc_id, sum(ceil(length(line) / 4.0)) OVER (PARTITION BY doc_id ORDER BY n) AS used FROM ln) WHERE used <= 120 GROUP BY 1")
def token_truncate_prefix(spark: SparkSession, root: str) -> DataFrame:
    """The first lines of every text that fit 120 tokens."""
    from ..operators.budget import token_prefix

    lines = table(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    sized = lines.select("doc_id", "n", T.coarse_estimate(F.col("line")).alias("tokens"))
    return token_prefix(sized, ["doc_id"], ["n"], "tokens", 120).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("used").alias("used"))


@_add("duration_texts", sql("run", "SELECT run_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM (SELECT run_id, duration_ms // 1000 AS s FROM run WHERE duration_ms IS NOT NULL)"))
def duration_texts(spark: SparkSession, root: str) -> DataFrame:
    """Durations in two units."""
    return G.runs(spark, root).where("duration_ms is not null").select("run_id", T.duration_text(F.col("duration_ms")).alias("text"))


@_add("legend_prefixes", sql("fil", "SELECT dir, n, n * length(dir) AS gain FROM (SELECT regexp_replace(path, '[^/]*$', '') AS dir, count(*) AS n FROM fil WHERE path LIKE '%/%' GROUP BY 1) WHERE n >= 2 ORDER BY gain DESC, dir LIMIT 16"))
def legend_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """The 16 folder prefixes that save most when interned."""
    d = G.files(spark, root).where("path like '%/%'").groupBy(F.regexp_replace("path", "[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return d.withColumn("gain", F.col("n") * F.length("dir")).orderBy(F.desc("gain"), "dir").limit(16)
