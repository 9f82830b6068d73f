"""Queries: reachability, ranks, communities and slices of the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions import text as T
from ..operators import aggregates as R
from ..operators import budget as B
from ..operators import graph as A
from ..operators import joins as J
from ..session import cut
from ..sources import graph as G
from ..sources.graph import with_tables as sql
from .registry import Registry

registry = Registry()
_add = registry.add

_SEEDS = "seed AS (SELECT DISTINCT id FROM sym WHERE deleted_at IS NOT NULL)"


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    """Changed symbols: those that were deleted."""
    return G.symbols(spark, root).where("deleted_at is not null").select("id")


def _levels(hops: int, near: str = "dst", far: str = "src") -> str:
    """Unrolled levels of a breadth-first search in SQL."""
    out = ["s0 AS (SELECT id, 0 AS distance FROM seed)"]
    for d in range(1, hops + 1):
        out.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT DISTINCT {far}, {d} FROM edg WHERE {near} IN (SELECT id FROM s{d - 1}) AND {far} NOT IN (SELECT id FROM s{d - 1}))")
    return ", ".join([_SEEDS, *out])


_TEST = "(path LIKE '%.test.ts' OR path LIKE '%.spec.ts' OR path LIKE '%.test.tsx' OR path LIKE '%.spec.tsx' OR path LIKE '%\\_\\_tests\\_\\_%' ESCAPE '\\')"


_BLAST = f"SELECT s3.id, s3.distance, round(least(1, greatest(0, 0.6 * greatest(0, 1 - distance / 3.0) + 0.3 * least(1, ln(coalesce(i.n, 0) + 1) / ln(100)) + 0.1 * CASE WHEN {_TEST} THEN 1 ELSE 0 END)), 6) AS rank, CASE WHEN distance = 1 THEN 'direct' ELSE 'graph' END AS signal FROM s3 LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edg GROUP BY 1) i USING (id) LEFT JOIN sym ON sym.id = s3.id LEFT JOIN fil USING (file_id) WHERE distance > 0"


@_add("blast_radius", sql("edg sym fil", _BLAST, _levels(3)))
def blast_radius(spark: SparkSession, root: str) -> DataFrame:
    """Dependents of changed symbols within three hops, ranked: near, much used, tests."""
    e = G.edges(spark, root)
    d = A.reachable(e, _seeds(spark, root), 3).where("distance > 0")
    place = G.symbols(spark, root).select("id", "file_id").join(G.files(spark, root).select("file_id", "path"), "file_id").select("id", "path")
    is_test = F.coalesce(F.col("path").rlike(r"\.(test|spec)\.tsx?$|__tests__"), F.lit(False))
    r = d.join(J.fan_in_out(d, e), "id").join(place, "id", "left")
    return r.select("id", "distance", F.round(C.impact_rank(F.col("distance"), 3, F.col("fan_in"), is_test), 6).alias("rank"), F.when(F.col("distance") == 1, "direct").otherwise("graph").alias("signal"))


def _path_levels(hops: int) -> str:
    out = [_SEEDS, "s0 AS (SELECT id, 0 AS distance, id AS path FROM seed)", "n0 AS (SELECT * FROM s0)"]
    for d in range(1, hops + 1):
        out.append(f"n{d} AS (SELECT src AS id, {d} AS distance, min_by(path, dst) || '>' || src AS path FROM edg JOIN n{d - 1} ON n{d - 1}.id = dst WHERE src NOT IN (SELECT id FROM s{d - 1}) GROUP BY src)")
        out.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM n{d})")
    return ", ".join(out)


@_add("blast_radius_path", sql("edg sym", "SELECT id, distance, path FROM s3 WHERE distance > 0", _path_levels(3)))
def blast_radius_path(spark: SparkSession, root: str) -> DataFrame:
    """How each dependent is reached."""
    return A.impact_paths(G.edges(spark, root), _seeds(spark, root), 3).where("distance > 0").select("id", "distance", F.array_join("path", ">").alias("path"))


@_add("neighborhood_khop", sql("edg sym", "SELECT id, distance FROM s2", _levels(2, "src", "dst")))
def neighborhood_khop(spark: SparkSession, root: str) -> DataFrame:
    """Nodes within two hops along the edges."""
    return A.reachable(G.edges(spark, root), _seeds(spark, root), 2, direction="out")


@_add("neighborhood_edges", sql("edg sym", "SELECT DISTINCT src, dst, edge_type FROM edg WHERE src IN (SELECT id FROM s2) AND dst IN (SELECT id FROM s2)", _levels(2, "src", "dst")))
def neighborhood_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges inside a neighbourhood."""
    return J.induced_edges(G.edges(spark, root), neighborhood_khop(spark, root)).select("src", "dst", "edge_type").distinct()


_PAIRS = "p AS (SELECT (SELECT min(src) FROM edg) AS a, id AS b FROM seed)"


def _pairs(spark: SparkSession, root: str, edges: DataFrame) -> DataFrame:
    """The first symbol with each changed one."""
    return _seeds(spark, root).select(F.col("id").alias("b")).crossJoin(F.broadcast(edges.agg(F.min("src").alias("a")))).select("a", "b")


def _walk(hops: int) -> str:
    out = [_SEEDS, _PAIRS, "w0 AS (SELECT DISTINCT a, a AS node, 0 AS n FROM p)"]
    for d in range(1, hops + 1):
        out.append(f"w{d} AS (SELECT * FROM w{d - 1} UNION ALL SELECT DISTINCT a, dst, {d} FROM w{d - 1} JOIN edg ON src = node WHERE (a, dst) NOT IN (SELECT (a, node) FROM w{d - 1}))")
    return ", ".join(out)


@_add("shortest_path_len", sql("edg sym", "SELECT p.a, p.b, w.n FROM p LEFT JOIN w6 w ON w.a = p.a AND w.node = p.b", _walk(6)))
def shortest_path_len(spark: SparkSession, root: str) -> DataFrame:
    """Least number of edges from one symbol to each changed one, up to six as in its SQL; ``shortest_paths`` goes on."""
    e = G.edges(spark, root)
    return A.shortest_lengths(e, _pairs(spark, root, e), 6)


@_add("shortest_paths")
def shortest_paths(spark: SparkSession, root: str) -> DataFrame:
    """The way from one symbol to each changed one, over at most twelve edges."""
    e = G.edges(spark, root)
    return A.shortest_paths(e, _pairs(spark, root, e), 12).select("a", "b", "n", F.array_join("path", ">").alias("path"))


def _rank_rounds(k: int) -> str:
    out = ["n AS (SELECT DISTINCT id FROM sym)", "t AS (SELECT count(*) AS c FROM n)", "e AS (SELECT src, dst, count(*) AS k FROM edg WHERE edge_type = 'call' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1, 2)", "o AS (SELECT src, sum(k) AS out FROM e GROUP BY 1)", "r0 AS (SELECT id, 1.0 / (SELECT c FROM t) AS score FROM n)"]
    for i in range(1, k + 1):
        out.append(
            f"r{i} AS (SELECT n.id, 0.15 / (SELECT c FROM t) + 0.85 * coalesce(g.got, 0) + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)) / (SELECT c FROM t) AS score"
            f" FROM n LEFT JOIN (SELECT dst AS id, sum(score * k / out) AS got FROM r{i - 1} JOIN e ON e.src = id JOIN o ON o.src = e.src GROUP BY 1) g USING (id))"
        )
    return ", ".join(out)


@_add("pagerank_fixed", sql("edg sym", "SELECT id, round(score, 9) AS score FROM r20", _rank_rounds(20)))
def pagerank_fixed(spark: SparkSession, root: str) -> DataFrame:
    """Page rank over calls, 20 rounds, with the mass of dangling nodes spread."""
    e = G.edges(spark, root).where("edge_type = 'call'")
    return A.page_rank(G.symbols(spark, root), e).select("id", F.round("score", 9).alias("score"))


def _peel(k: int, rounds: int) -> str:
    out = ["b0 AS (SELECT src, dst FROM edg WHERE edge_type = 'call' AND src <> dst AND src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym) UNION SELECT dst, src FROM edg WHERE edge_type = 'call' AND src <> dst AND src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym))"]
    for i in range(1, rounds + 1):
        out.append(f"k{i} AS (SELECT src FROM b{i - 1} GROUP BY 1 HAVING count(*) >= {k}), b{i} AS (SELECT * FROM b{i - 1} WHERE src IN (SELECT src FROM k{i}) AND dst IN (SELECT src FROM k{i}))")
    return ", ".join(out)


def _bounds(rounds: int) -> str:
    """Unrolled lowering of each node's bound to the largest h that h neighbours reach."""
    out = [_peel(0, 0), "h0 AS (SELECT src AS id, count(*) AS h FROM b0 GROUP BY 1)"]
    for i in range(1, rounds + 1):
        out.append(f"h{i} AS (SELECT src AS id, max(least(h, rn)) AS h FROM (SELECT b0.src, p.h, row_number() OVER (PARTITION BY b0.src ORDER BY p.h DESC) AS rn FROM b0 JOIN h{i - 1} p ON p.id = b0.dst) GROUP BY 1)")
    return ", ".join(out)


@_add("k_core", sql("edg sym", "SELECT s.id, coalesce(h, 0) AS coreness FROM (SELECT DISTINCT id FROM sym) s LEFT JOIN h60 USING (id)", _bounds(60)))
def k_core(spark: SparkSession, root: str) -> DataFrame:
    """Coreness of each symbol over calls."""
    return A.k_core(G.symbols(spark, root), G.edges(spark, root).where("edge_type = 'call'"))


@_add("k_core_members", sql("edg sym", "SELECT DISTINCT src AS id FROM b20", _peel(4, 20)))
def k_core_members(spark: SparkSession, root: str) -> DataFrame:
    """Symbols in the 4-core of the call graph."""
    return k_core(spark, root).where("coreness >= 4").select("id")


_ADJ = "adj0 AS (SELECT src, dst, greatest(0, coalesce(weight, 1)) * least(1, greatest(0, coalesce(confidence, 1))) AS w FROM edg WHERE src <> dst), adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM adj0 UNION ALL SELECT dst, src, w * 0.5 FROM adj0) GROUP BY 1, 2 HAVING sum(w) > 0)"


@_add("weighted_adjacency", sql("edg", "SELECT src, dst, round(w, 6) AS w FROM adj", _ADJ))
def weighted_adjacency(spark: SparkSession, root: str) -> DataFrame:
    """Strengths between nodes, both ways."""
    return A.weighted_adjacency(G.edges(spark, root)).select("src", "dst", F.round("w", 6).alias("w"))


def _ppr_rounds(k: int) -> str:
    out = [_SEEDS, _ADJ, "tot AS (SELECT src, sum(w) AS t FROM adj GROUP BY 1)", "m0 AS (SELECT id, 1.0 / (SELECT count(*) FROM seed) AS r FROM seed)"]
    for i in range(1, k):
        out.append(f"m{i} AS (SELECT dst AS id, sum(0.85 * r * w / t) AS r FROM m{i - 1} JOIN adj ON src = id JOIN tot USING (src) GROUP BY 1)")
    return ", ".join(out)


@_add("ppr_power", sql("edg sym", "SELECT id, round(sum(0.15 * r), 9) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(10)) + ") GROUP BY 1", _ppr_rounds(10)))
def ppr_power(spark: SparkSession, root: str) -> DataFrame:
    """Personalised rank from the changed symbols, ten rounds."""
    s = _seeds(spark, root)
    seeds = s.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))).select("id", (1.0 / F.col("n")).alias("weight"))
    return A.personal_rank(A.weighted_adjacency(G.edges(spark, root)), seeds).select("id", F.round("score", 9).alias("score"))


@_add("ppr_fallback", sql("edg sym", "SELECT id, round(CASE WHEN distance = 0 THEN 1 ELSE 1.0 / (distance + 1) END, 6) AS score FROM s3", _levels(3, "src", "dst")))
def ppr_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Scores by distance where the walk has nowhere to go."""
    d = A.reachable(G.edges(spark, root), _seeds(spark, root), 3, direction="out")
    return d.select("id", F.round(F.when(F.col("distance") == 0, 1.0).otherwise(1.0 / (F.col("distance") + 1)), 6).alias("score"))


def _relax(rounds: int) -> str:
    out = ["c0 AS (SELECT src, dst, min(CASE edge_type WHEN 'call' THEN 1.0 WHEN 'config' THEN 1.5 ELSE 2.0 END) AS cost FROM edg GROUP BY 1, 2)", "c AS (SELECT src, dst, min(cost) AS cost FROM (SELECT * FROM c0 UNION ALL SELECT dst, src, cost FROM c0) GROUP BY 1, 2)", "t0 AS (SELECT id, 0.0 AS d, id AS seed FROM sym JOIN fil USING (file_id) WHERE starts_with(path, 'tests/'))"]
    for i in range(1, rounds + 1):
        out.append(f"t{i} AS (SELECT id, min(d) AS d, arg_min(seed, struct_pack(d := d, s := seed)) AS seed FROM (SELECT * FROM t{i - 1} UNION ALL SELECT dst, t{i - 1}.d + cost, seed FROM t{i - 1} JOIN c ON src = id WHERE t{i - 1}.d < 12) GROUP BY 1)")
    return ", ".join(out)


def _costs(spark: SparkSession, root: str) -> DataFrame:
    """Edges with what a step over them costs."""
    cost = F.when(F.col("edge_type") == "call", 1.0).when(F.col("edge_type") == "config", 1.5).otherwise(2.0)
    return G.edges(spark, root).select("src", "dst", cost.alias("cost"))


@_add("canonical_test", sql("edg sym fil", "SELECT id, d AS distance, seed, round(1 / (1 + d), 6) AS proximity FROM t5", _relax(5)))
def canonical_test(spark: SparkSession, root: str) -> DataFrame:
    """The cheapest test under tests/ over at most five edges, as in its SQL; ``nearest_tests`` has neither bound."""
    tests = G.symbols(spark, root).select("id", "file_id").join(G.files(spark, root).where("path like 'tests/%'").select("file_id"), "file_id").select("id")
    return A.nearest_seed(_costs(spark, root), tests, 12.0, 5).withColumn("proximity", F.round(1 / (1 + F.col("distance")), 6))


@_add("nearest_tests")
def nearest_tests(spark: SparkSession, root: str) -> DataFrame:
    """The cheapest test of each symbol, whatever the number of edges, up to a cost of 12."""
    tests = G.symbols(spark, root).select("id", "file_id").join(G.files(spark, root).where(T.is_test_file(F.col("path"))).select("file_id"), "file_id").select("id")
    return A.nearest_seed(_costs(spark, root), tests, 12.0).withColumn("proximity", F.round(1 / (1 + F.col("distance")), 6))


@_add("components", sql("edg", "SELECT id, min(c) AS component FROM cc GROUP BY 1", "k AS (SELECT src, dst FROM edg WHERE edge_type = 'implements' AND src <> dst), b AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k), cc AS (SELECT src AS id, src AS c FROM b UNION SELECT dst, c FROM cc JOIN b ON src = id)"))
def components(spark: SparkSession, root: str) -> DataFrame:
    """Connected components over implementations only; ``call_components`` has those over calls."""
    return A.components(G.edges(spark, root).where("edge_type = 'implements' and src <> dst"))


def _repo_edges(spark: SparkSession, root: str) -> DataFrame:
    """Calls inside a repository, with it."""
    s = G.symbols(spark, root).select("id", "repo_id")
    e = G.edges(spark, root).where("edge_type = 'call'").select("src", "dst", "weight", "confidence")
    j = e.join(s.select(F.col("id").alias("src"), "repo_id"), "src").join(s.select(F.col("id").alias("dst"), F.col("repo_id").alias("other")), "dst")
    return j.where("repo_id = other").drop("other")


@_add("call_components")
def call_components(spark: SparkSession, root: str) -> DataFrame:
    """Connected components over all calls, across repositories too; a symbol without calls is one of its own."""
    alone = G.symbols(spark, root).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return A.components(G.edges(spark, root).where("edge_type = 'call'").select("src", "dst").unionByName(alone))


@_add("label_propagation")
def label_propagation(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of 3 to 250 symbols by sequential label propagation in each repository, named by their members."""
    label = A.local_clusters(_repo_edges(spark, root), "repo_id")
    members = label.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n between 3 and 250")
    kept = label.join(members, ["repo_id", "label"])
    # At most 250 members a cluster, so the list is bounded.
    named = kept.groupBy("repo_id", "label").agg(F.sha2(F.concat(F.lit("cluster:"), F.array_join(F.array_sort(F.collect_list("id")), "|")), 256).alias("cluster_id"))
    return kept.join(named, ["repo_id", "label"]).select("id", "cluster_id", "n")


def _votes(rounds: int) -> str:
    out = ["u AS (SELECT src, dst FROM edg WHERE edge_type = 'call' AND src <> dst UNION SELECT dst, src FROM edg WHERE edge_type = 'call' AND src <> dst)", "v0 AS (SELECT DISTINCT src AS id, src AS label FROM u)"]
    for i in range(1, rounds + 1):
        out.append(f"v{i} AS (SELECT id, arg_min(label, struct_pack(c := -c, l := label)) AS label FROM (SELECT u.src AS id, label, count(*) AS c FROM u JOIN v{i - 1} v ON v.id = u.dst GROUP BY 1, 2) GROUP BY 1)")
    return ", ".join(out)


@_add("label_spread", sql("edg", "SELECT id, label FROM v5", _votes(5)))
def label_spread(spark: SparkSession, root: str) -> DataFrame:
    """Labels after five rounds in which all nodes move together."""
    return A.spread_labels(G.edges(spark, root).where("edge_type = 'call'"))


@_add("call_communities")
def call_communities(spark: SparkSession, root: str) -> DataFrame:
    """Communities of symbols by modularity over all calls."""
    e = G.edges(spark, root).where("edge_type = 'call'").select("src", "dst", F.lit(1.0).alias("w"))
    return A.communities(e)


@_add("flow_traces")
def flow_traces(spark: SparkSession, root: str) -> DataFrame:
    """Depth-first traces of calls from entries whose name says so."""
    s = G.symbols(spark, root).where("name rlike '^(main|run|handle|render)[A-Z]' and symbol_status = 'real'").select("repo_id", "id")
    t = A.trace_flows(_repo_edges(spark, root), s, "repo_id")
    return t.select(F.sha2(F.concat(F.lit("process:"), "entry"), 256).alias("process_id"), "entry", "id", "step", "depth")


@_add("beam_slice")
def beam_slice(spark: SparkSession, root: str) -> DataFrame:
    """A slice of at most 60 symbols and 12,000 tokens of each repository, best first.

    It starts from the three symbols with most edges going out as entries, and from callers of
    changed symbols as edited ones.
    """
    s = G.symbols(spark, root).where("repo_id is not null").select("repo_id", "id", "kind", "name", "signature_json", "summary", "file_id", "symbol_status", "deleted_at")
    e = G.edges(spark, root).select("src", "dst", "edge_type", "confidence")
    inner = cut(e.join(s.select(F.col("id").alias("src"), "repo_id"), "src").join(s.select(F.col("id").alias("dst"), F.col("repo_id").alias("other")), "dst").where("repo_id = other").drop("other"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    busy = cut(R.top_per_group(s.select("repo_id", "id").join(out, "id"), ["repo_id"], [F.desc("out"), F.asc("id")], 3).select("repo_id", "id", F.lit("entrySymbol").alias("source")))
    changed = s.where("deleted_at is not null").select(F.col("id").alias("dst"))
    edited = inner.join(changed, "dst", "left_semi").select("repo_id", F.col("src").alias("id"), F.lit("editedFile").alias("source")).distinct()
    m = G.metrics(spark, root)
    top = F.broadcast(m.agg(F.max("page_rank").alias("tp"), F.max("k_core").alias("tk")))
    worth = (0.15 * C.hotness(F.col("fan_in"), F.col("fan_out"), F.col("churn30d")) + 0.15 * C.path_specificity(F.col("path")) + 0.1 * C.kind_specificity(F.col("kind"))) / 0.4
    part = lambda c: F.coalesce(F.length(c), F.lit(0)) / 4
    tokens = F.ceil(50 + part("name") + part("signature_json") + F.least(part("summary"), F.lit(150)) + 5 * F.coalesce("out", F.lit(0)))
    cluster = A.spread_labels(inner.where("edge_type = 'call'"))
    home = busy.join(cluster, "id").select("repo_id", "label").distinct().withColumn("entry", F.lit(True))
    n = s.join(m.join(top), "id", "left").join(out, "id", "left").join(G.files(spark, root).select("file_id", "path"), "file_id", "left").join(cluster, "id", "left").join(home, ["repo_id", "label"], "left")
    n = n.select("repo_id", "id", F.coalesce(worth, F.lit(0.0)).alias("score"), C.centrality(F.col("page_rank"), F.col("k_core"), F.col("tp"), F.col("tk")).alias("signal"), C.cohesion(F.col("label"), F.coalesce("entry", F.lit(False)), F.lit(False)).alias("boost"), tokens.alias("tokens"), (F.col("symbol_status") == "external").alias("external"))
    return B.beam_slices(inner, busy.unionByName(edited), n, "repo_id")


def greedy_sql(items: str, most_items: int, most_total: int) -> str:
    """Items of ``it`` (rn from 1, t) taken in order while they fit, as a recursive table ``g``."""
    fits = f"n < {most_items} AND used + t <= {most_total}"
    return f"it AS ({items}), g AS (SELECT 0 AS rn, 0 AS used, 0 AS n, false AS kept UNION ALL SELECT it.rn, used + CASE WHEN {fits} THEN t ELSE 0 END, n + CASE WHEN {fits} THEN 1 ELSE 0 END, {fits} FROM g JOIN it ON it.rn = g.rn + 1)"


_ITEMS = f"SELECT *, CAST(greatest(0, coalesce(tokens, 50)) AS BIGINT) AS t, CAST(row_number() OVER (ORDER BY priority, neg_rank, distance, id) AS INT) AS rn FROM (SELECT CASE WHEN distance = 1 THEN 0 WHEN rank >= 0.5 THEN 1 ELSE 2 END AS priority, -rank AS neg_rank, distance, r.id, CAST(ceil(length(name) / 4.0) + ceil(coalesce(length(signature_json), 0) / 4.0) + 50 AS BIGINT) AS tokens FROM ({_BLAST}) r LEFT JOIN sym USING (id))"


@_add("blast_budget", sql("edg sym fil", "SELECT priority, neg_rank, distance, id, tokens, kept FROM it JOIN g USING (rn)", _levels(3) + ", " + greedy_sql(_ITEMS, 60, 2000)))
def blast_budget(spark: SparkSession, root: str) -> DataFrame:
    """Dependents that fit a budget of 60 cards and 2,000 tokens, in order of priority."""
    r = blast_radius(spark, root)
    s = G.symbols(spark, root).select("id", (F.ceil(F.length("name") / 4) + F.ceil(F.coalesce(F.length("signature_json"), F.lit(0)) / 4) + 50).alias("tokens"))
    priority = F.when(F.col("distance") == 1, 0).when(F.col("rank") >= 0.5, 1).otherwise(2)
    items = r.join(s, "id", "left").select(priority.alias("priority"), (-F.col("rank")).alias("neg_rank"), "distance", "id", "tokens")
    return B.greedy_budget(items, ["priority", "neg_rank", "distance", "id"], "tokens", 60, 2000)


@_add("process_impact", "WITH steps AS (SELECT l_orderkey AS p, l_partkey AS item, min(l_linenumber) AS step FROM lineitem GROUP BY 1, 2), s AS (SELECT * FROM steps WHERE item IN (SELECT p_partkey FROM part WHERE p_size = 11)) SELECT item, round(max(greatest(0, 1 - d / 20.0)), 6) AS rank FROM (SELECT a.item, s.item AS st, min(a.step - s.step) AS d FROM steps a JOIN s ON a.p = s.p AND a.step > s.step AND a.item <> s.item GROUP BY 1, 2) GROUP BY 1")
def process_impact(spark: SparkSession, root: str) -> DataFrame:
    """Items after changed ones in a process, by how soon they follow."""
    from .relational import _steps

    starts = spark.read.parquet(f"{root}/part.parquet").where("p_size = 11").select(F.col("p_partkey").alias("item"))
    after = J.later_steps(_steps(spark, root), starts, "process_id", "item", "step")
    return after.groupBy("item").agg(F.round(F.max(F.greatest(F.lit(0.0), 1 - F.col("distance") / 20.0)), 6).alias("rank"))


@_add("seed_weights", sql("sym cal", "SELECT id, CAST(sum(1.0 / n / t) AS DOUBLE) AS weight FROM (SELECT c.name, s.id, count(*) OVER (PARTITION BY c.name) AS n, (SELECT count(DISTINCT name) FROM m) AS t FROM (SELECT DISTINCT name FROM m) c JOIN sym s ON s.name = c.name) GROUP BY 1".replace("CAST(sum(1.0 / n / t) AS DOUBLE)", "round(CAST(sum(1.0 / n / t) AS DOUBLE), 9)"), "m AS (SELECT DISTINCT callee_identifier AS name FROM cal WHERE NOT is_resolved AND callee_identifier IN (SELECT name FROM sym))"))
def seed_weights(spark: SparkSession, root: str) -> DataFrame:
    """Mentioned names as seeds; the weights of all mentions sum to 1."""
    s = G.symbols(spark, root).select("name", "id")
    m = G.calls(spark, root).where("not is_resolved").select(F.col("callee_identifier").alias("name")).distinct().join(s.select("name").distinct(), "name", "left_semi")
    n = s.join(m, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.count(F.lit(1)).alias("t"))
    w = s.join(n, "name").crossJoin(F.broadcast(total))
    return w.groupBy("id").agg(F.round(F.sum(1.0 / F.col("n") / F.col("t")), 9).alias("weight"))
