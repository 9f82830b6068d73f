"""Queries: aggregations, rankings and scores over the code index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import aggregates as A
from ..operators import joins as J
from ..sources import graph as G
from ..sources.graph import with_tables as sql
from ..sources.tables import table
from .registry import Registry

registry = Registry()
_add = registry.add


def _n() -> Column:
    return F.count(F.lit(1))


@_add("edge_counts_by_type", sql("edg", "SELECT edge_type, count(*) AS n FROM edg GROUP BY 1"))
def edge_counts_by_type(spark: SparkSession, root: str) -> DataFrame:
    """Edges by kind."""
    return G.edges(spark, root).groupBy("edge_type").agg(_n().alias("n"))


@_add("call_resolution_counts", sql("edg", "SELECT count(*) AS total, CAST(count_if(resolution <> 'unresolved') AS BIGINT) AS resolved, CAST(count_if(resolution = 'exact') AS BIGINT) AS exact, CAST(count_if(NOT starts_with(dst, 'unresolved:') OR resolution = 'exact') AS BIGINT) AS resolvable FROM edg WHERE edge_type = 'call'"))
def call_resolution_counts(spark: SparkSession, root: str) -> DataFrame:
    """Four conditional counts of calls in one pass."""
    e = G.edges(spark, root).where("edge_type = 'call'")
    return e.agg(_n().alias("total"), F.count_if(F.col("resolution") != "unresolved").alias("resolved"), F.count_if(F.col("resolution") == "exact").alias("exact"), F.count_if(~F.col("dst").startswith("unresolved:") | (F.col("resolution") == "exact")).alias("resolvable"))


@_add("entity_counts", sql("sym edg fil", "SELECT 'symbols' AS entity, count(*) AS n FROM sym UNION ALL SELECT 'edges', count(*) FROM edg UNION ALL SELECT 'files', count(*) FROM fil UNION ALL SELECT 'versions', count(*) FROM versions"))
def entity_counts(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of nodes and edges."""
    out = None
    for name, df in (("symbols", G.symbols(spark, root)), ("edges", G.edges(spark, root)), ("files", G.files(spark, root)), ("versions", table(spark, root, "versions"))):
        one = df.agg(_n().alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_add("summary_coverage", sql("sym", "SELECT repo_id, count(*) AS eligible, count(summary) AS covered FROM sym WHERE symbol_status = 'real' GROUP BY 1"))
def summary_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Eligible symbols and those with a summary (the state table holds each symbol once)."""
    return G.symbols(spark, root).where("symbol_status = 'real'").groupBy("repo_id").agg(_n().alias("eligible"), F.count("summary").alias("covered"))


@_add("coverage_permille", sql("sym", "SELECT language, CAST(floor(1000.0 * sum(least(covered, eligible)) / sum(eligible) + 0.5) AS BIGINT) AS permille FROM (SELECT repo_id, language, count(*) AS eligible, count(summary) AS covered FROM sym WHERE symbol_status = 'real' GROUP BY 1, 2) GROUP BY 1"))
def coverage_permille(spark: SparkSession, root: str) -> DataFrame:
    """Coverage of all repositories together, in thousandths."""
    s = G.symbols(spark, root).where("symbol_status = 'real'").groupBy("repo_id", "language").agg(_n().alias("e"), F.count("summary").alias("c"))
    return s.groupBy("language").agg(F.floor(1000 * F.sum(F.least("c", "e")) / F.sum("e") + F.lit(0.5)).alias("permille"))


@_add("universe", sql("sym edg", "SELECT s.repo_id, s.symbols, s.clusters, coalesce(e.n, 0) AS edges FROM (SELECT repo_id, count(*) AS symbols, count(DISTINCT file_id) AS clusters FROM sym GROUP BY 1) s LEFT JOIN (SELECT repo_id, count(*) AS n FROM edg JOIN sym ON sym.id = src GROUP BY 1) e USING (repo_id)"))
def universe(spark: SparkSession, root: str) -> DataFrame:
    """Per repository: symbols, clusters, edges; each table aggregated before the join."""
    s = G.symbols(spark, root)
    a = s.groupBy("repo_id").agg(_n().alias("symbols"), F.countDistinct("file_id").alias("clusters"))
    e = G.edges(spark, root).groupBy(F.col("src").alias("id")).agg(_n().alias("n")).join(s.select("id", "repo_id"), "id").groupBy("repo_id").agg(F.sum("n").alias("n"))
    return a.join(e, "repo_id", "left").select("repo_id", "symbols", "clusters", F.coalesce("n", F.lit(0)).alias("edges"))


_SIZES = "c AS (SELECT repo_id, file_id, count(*) AS size FROM sym WHERE file_id IS NOT NULL GROUP BY 1, 2)"


@_add("cluster_overview", sql("sym", "SELECT repo_id, count(*) AS clusters, round(avg(size), 6) AS mean_size FROM c GROUP BY 1", _SIZES))
def cluster_overview(spark: SparkSession, root: str) -> DataFrame:
    """Clusters and their mean size."""
    c = G.symbols(spark, root).where("file_id is not null").groupBy("repo_id", "file_id").agg(_n().alias("size"))
    return c.groupBy("repo_id").agg(_n().alias("clusters"), F.round(F.avg("size"), 6).alias("mean_size"))


@_add("cluster_top5", sql("sym", "SELECT repo_id, file_id, size, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, file_id) AS pos FROM c) WHERE pos <= 5", _SIZES))
def cluster_top5(spark: SparkSession, root: str) -> DataFrame:
    """The five largest clusters of each repository."""
    c = G.symbols(spark, root).where("file_id is not null").groupBy("repo_id", "file_id").agg(_n().alias("size"))
    return A.top_per_group(c, ["repo_id"], [F.desc("size"), F.asc("file_id")], 5)


@_add("cluster_top_members", sql("sym met", "SELECT file_id, id, fan_in, CAST(pos AS INT) AS pos FROM (SELECT s.file_id, s.id, coalesce(m.fan_in, 0) AS fan_in, row_number() OVER (PARTITION BY s.file_id ORDER BY coalesce(m.fan_in, 0) DESC, s.id) AS pos FROM sym s LEFT JOIN met m USING (id) WHERE s.file_id IS NOT NULL) WHERE pos <= 5"))
def cluster_top_members(spark: SparkSession, root: str) -> DataFrame:
    """The five most used members of each cluster."""
    s = G.symbols(spark, root).where("file_id is not null").select("file_id", "id").join(G.metrics(spark, root).select("id", "fan_in"), "id", "left")
    return A.top_per_group(s.select("file_id", "id", F.coalesce("fan_in", F.lit(0)).alias("fan_in")), ["file_id"], [F.desc("fan_in"), F.asc("id")], 5)


@_add("process_overview", "WITH p AS (SELECT l_orderkey, count(*) AS depth, min_by(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS entry FROM lineitem GROUP BY 1) SELECT count(*) AS processes, round(avg(depth), 6) AS mean_depth, count(DISTINCT entry) AS entries FROM p")
def process_overview(spark: SparkSession, root: str) -> DataFrame:
    """Processes, their mean depth and distinct entries."""
    p = table(spark, root, "lineitem").groupBy("l_orderkey").agg(_n().alias("depth"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("entry"))
    return p.agg(_n().alias("processes"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.countDistinct("entry").alias("entries"))


@_add("duplicate_deliveries", "SELECT edge_id, count(*) AS n FROM depends_on GROUP BY 1 HAVING count(*) > 1")
def duplicate_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Keys that occur more than once."""
    return table(spark, root, "depends_on").groupBy("edge_id").agg(_n().alias("n")).where("n > 1")


@_add("index_quality", sql("sym edg fil", "SELECT count(*) AS symbols, count_if(symbol_status = 'real') AS real_symbols, count_if(symbol_status = 'unresolved') AS unresolved, count_if(summary IS NULL) AS no_summary, count_if(signature_json IS NULL) AS no_signature, count_if(deleted_at IS NOT NULL) AS deleted, count_if(file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM fil)) AS lost_file, count_if(id NOT IN (SELECT src FROM edg)) AS no_edge FROM sym"))
def index_quality(spark: SparkSession, root: str) -> DataFrame:
    """Filtered counts and two anti joins in one row."""
    s = G.symbols(spark, root).select("id", "symbol_status", "summary", "signature_json", "deleted_at", "file_id")
    s = s.join(G.files(spark, root).select("file_id", F.lit(True).alias("has_file")), "file_id", "left")
    s = s.join(G.edges(spark, root).select(F.col("src").alias("id"), F.lit(True).alias("has_edge")).distinct(), "id", "left")
    is_ = lambda c: F.count_if(c)
    return s.agg(_n().alias("symbols"), is_(F.col("symbol_status") == "real").alias("real_symbols"), is_(F.col("symbol_status") == "unresolved").alias("unresolved"), is_(F.col("summary").isNull()).alias("no_summary"), is_(F.col("signature_json").isNull()).alias("no_signature"), is_(F.col("deleted_at").isNotNull()).alias("deleted"), is_(F.col("file_id").isNotNull() & F.col("has_file").isNull()).alias("lost_file"), is_(F.col("has_edge").isNull()).alias("no_edge"))


@_add("repo_stats", sql("sym", "SELECT repo_id, count(*) AS total, count_if(kind = 'class') AS class, count_if(kind = 'function') AS function, count_if(kind = 'method') AS method, count(*) FILTER (WHERE exported) AS exported, floor(count(*) * 10.0 / count(DISTINCT file_id) + 0.5) / 10 AS per_file FROM sym WHERE file_id IS NOT NULL GROUP BY 1"))
def repo_stats(spark: SparkSession, root: str) -> DataFrame:
    """Pivot of kinds, exported count and an average rounded to a tenth."""
    s = G.symbols(spark, root).where("file_id is not null")
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("class", "function", "method")]
    return s.groupBy("repo_id").agg(_n().alias("total"), *kinds, F.count_if("exported").alias("exported"), C.half_up(_n() / F.countDistinct("file_id"), 1).alias("per_file"))


_DIRS = "d AS (SELECT s.*, regexp_replace(f.path, '/[^/]*$', '') AS dir FROM sym s JOIN fil f USING (file_id) WHERE f.path LIKE '%/%')"


def _dirs(spark: SparkSession, root: str) -> DataFrame:
    f = G.files(spark, root).where("path like '%/%'").select("file_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    return G.symbols(spark, root).join(f, "file_id")


@_add("directory_rollup", sql("sym fil", "SELECT dir, count(DISTINCT file_id) AS files, count(*) AS symbols, count(*) FILTER (WHERE exported) AS exported, count_if(kind = 'class') AS classes FROM d GROUP BY 1", _DIRS))
def directory_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Files, symbols and kinds of each directory."""
    return _dirs(spark, root).groupBy("dir").agg(F.countDistinct("file_id").alias("files"), _n().alias("symbols"), F.count_if("exported").alias("exported"), F.count_if(F.col("kind") == "class").alias("classes"))


@_add("directory_top3", sql("sym fil met", "SELECT dir, id, fan_in, CAST(pos AS INT) AS pos FROM (SELECT d.dir, d.id, coalesce(m.fan_in, 0) AS fan_in, row_number() OVER (PARTITION BY d.dir ORDER BY coalesce(m.fan_in, 0) DESC, d.id) AS pos FROM d LEFT JOIN met m USING (id)) WHERE pos <= 3", _DIRS))
def directory_top3(spark: SparkSession, root: str) -> DataFrame:
    """The three most used symbols of each directory."""
    d = _dirs(spark, root).select("dir", "id").join(G.metrics(spark, root).select("id", "fan_in"), "id", "left")
    return A.top_per_group(d.select("dir", "id", F.coalesce("fan_in", F.lit(0)).alias("fan_in")), ["dir"], [F.desc("fan_in"), F.asc("id")], 3)


@_add("hotspots", sql("met sym edg", "SELECT * FROM (SELECT 'fan_in' AS kind, id AS item, fan_in AS n FROM met ORDER BY fan_in DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'churn', id, churn30d FROM met ORDER BY churn30d DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'symbols', file_id, count(*) AS n FROM sym WHERE file_id IS NOT NULL GROUP BY 2 ORDER BY n DESC, file_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'edges', file_id, count(*) AS n FROM edg JOIN sym ON sym.id = src WHERE file_id IS NOT NULL GROUP BY 2 ORDER BY n DESC, file_id LIMIT 10)"))
def hotspots(spark: SparkSession, root: str) -> DataFrame:
    """Ten items each by fan-in, churn, symbols and edges of a file."""
    m, s = G.metrics(spark, root), G.symbols(spark, root).where("file_id is not null")
    top = lambda df, kind, item, n: df.select(F.lit(kind).alias("kind"), F.col(item).alias("item"), F.col(n).cast("bigint").alias("n")).orderBy(F.desc("n"), "item").limit(10)
    by_edges = G.edges(spark, root).select(F.col("src").alias("id")).join(s.select("id", "file_id"), "id").groupBy("file_id").count()
    return top(m, "fan_in", "id", "fan_in").unionByName(top(m, "churn", "id", "churn30d")).unionByName(top(s.groupBy("file_id").count(), "symbols", "file_id", "count")).unionByName(top(by_edges, "edges", "file_id", "count"))


#: Layers and the paths that show them.
LAYERS = [("tests", r"^(tests?|spec)(/|$)"), ("api", r"(^|/)(api|routes?|controllers?)(/|$)"), ("ui", r"(^|/)(ui|views?|components?)(/|$)"), ("data", r"(^|/)(store|db|models?|cache)(/|$)"), ("core", r"(^|/)(core|lib|internal)(/|$)"), ("tools", r"(^|/)(tools?|scripts?|cmd|cli)(/|$)")]


@_add("layers", sql("fil", "SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in LAYERS) + " ELSE 'other' END AS layer, count(*) AS files FROM fil WHERE path IS NOT NULL GROUP BY 1"))
def layers(spark: SparkSession, root: str) -> DataFrame:
    """Files by the layer that their path shows."""
    c = None
    for name, pattern in LAYERS:
        hit = F.lower("path").rlike(pattern)
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return G.files(spark, root).where("path is not null").groupBy(c.otherwise("other").alias("layer")).agg(_n().alias("files"))


@_add("usage_rollup", sql("run", "SELECT variant, count(*) AS runs, CAST(sum(total) AS BIGINT) AS used, CAST(sum(saved) AS BIGINT) AS saved, CASE WHEN sum(total + saved) > 0 THEN floor(100.0 * (1 - sum(CASE WHEN saved IS NOT NULL THEN total END) / sum(total + saved)) + 0.5) ELSE 0 END AS percent FROM run GROUP BY 1"))
def usage_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Tokens used and saved, with the share saved."""
    both = F.sum(F.col("total") + F.col("saved"))
    used = F.sum(F.when(F.col("saved").isNotNull(), F.col("total")))
    percent = F.when(both > 0, F.floor(100.0 * (1 - used / both) + 0.5).cast("double")).otherwise(0.0)
    return G.runs(spark, root).groupBy("variant").agg(_n().alias("runs"), F.sum("total").alias("used"), F.sum("saved").alias("saved"), percent.alias("percent"))


@_add("tool_breakdown", "SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE json_valid(props) GROUP BY 1")
def tool_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """Sums of a JSON column by tool; text that does not parse is skipped."""
    e = table(spark, root, "events").select("event_type", F.from_json("props", "k bigint").alias("p")).where("p is not null")
    return e.groupBy(F.col("event_type").alias("tool")).agg(_n().alias("calls"), F.sum("p.k").alias("k"))


@_add("feedback_aggregate", "WITH f AS (SELECT * FROM symbol_metrics ORDER BY updated_at DESC NULLS LAST, symbol_id, fan_in LIMIT 10000) SELECT ref, count(*) AS n FROM (SELECT unnest(from_json(test_refs_json, '[\"VARCHAR\"]')) AS ref FROM f WHERE test_refs_json IS NOT NULL) GROUP BY 1")
def feedback_aggregate(spark: SparkSession, root: str) -> DataFrame:
    """Items of JSON arrays over the latest 10,000 rows, counted."""
    f = table(spark, root, "symbol_metrics").orderBy(F.desc_nulls_last("updated_at"), "symbol_id", "fan_in").limit(10_000)
    return f.select(F.explode(F.from_json("test_refs_json", "array<string>")).alias("ref")).groupBy("ref").agg(_n().alias("n"))


@_add("percentile_floor", sql("run", "SELECT variant, p, list_extract(list(duration_ms ORDER BY duration_ms), CAST(least(floor(p * count(*)), count(*) - 1) AS BIGINT) + 1) AS value FROM run, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) WHERE duration_ms IS NOT NULL GROUP BY 1, 2"))
def percentile_floor(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles by floor index."""
    return A.floor_percentiles(G.runs(spark, root).select("variant", "duration_ms"), ["variant"], "duration_ms", [0.5, 0.95, 0.99])


_IQR = "q AS (SELECT variant, quantile_cont(duration_ms, 0.25) AS q1, quantile_cont(duration_ms, 0.5) AS median, quantile_cont(duration_ms, 0.75) AS q3, stddev_pop(duration_ms) AS sd FROM run WHERE duration_ms IS NOT NULL GROUP BY 1)"


@_add("iqr_outliers", sql("run", "SELECT q.variant, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(sd, 2) AS sd, count_if(duration_ms < q1 - 1.5 * (q3 - q1) OR duration_ms > q3 + 1.5 * (q3 - q1)) AS outliers FROM run JOIN q ON run.variant = q.variant WHERE duration_ms IS NOT NULL GROUP BY ALL", _IQR))
def iqr_outliers(spark: SparkSession, root: str) -> DataFrame:
    """Interpolated quartiles, deviation and outliers."""
    r = G.runs(spark, root).where("duration_ms is not null").select("variant", F.col("duration_ms").cast("double").alias("duration_ms"))
    s = A.smoothed(r, ["variant"], "duration_ms")
    return s.select("variant", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), F.round("sd", 2).alias("sd"), "outliers")


@_add("threshold_eval", sql("run", "SELECT category, round(b, 4) AS base, round(c, 4) AS cur, round((c - b) / b * 100, 4) AS percent, CASE WHEN b <= 0 THEN 'skip' WHEN (c - b) / b > 0.2 THEN 'fail' WHEN (c - b) / b > 0.1 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT category, avg(CASE WHEN variant = 'baseline' THEN total END) AS b, avg(CASE WHEN variant <> 'baseline' THEN total END) AS c FROM run GROUP BY 1) WHERE b IS NOT NULL AND c IS NOT NULL"))
def threshold_eval(spark: SparkSession, root: str) -> DataFrame:
    """Means against a baseline and their status."""
    base = F.avg(F.when(F.col("variant") == "baseline", F.col("total"))).alias("b")
    cur = F.avg(F.when(F.col("variant") != "baseline", F.col("total"))).alias("c")
    r = G.runs(spark, root).groupBy("category").agg(base, cur).where("b is not null and c is not null").withColumn("d", (F.col("c") - F.col("b")) / F.col("b"))
    status = F.when(F.col("b") <= 0, "skip").when(F.col("d") > 0.2, "fail").when(F.col("d") > 0.1, "warn").otherwise("pass")
    return r.select("category", F.round("b", 4).alias("base"), F.round("c", 4).alias("cur"), F.round(F.col("d") * 100, 4).alias("percent"), status.alias("status"))


@_add("regression_report", sql("run", "SELECT category, CASE WHEN d < -0.05 THEN 'improved' WHEN d > 0.05 THEN 'degraded' ELSE 'neutral' END AS trend, CASE WHEN abs(d) >= 0.2 THEN 'critical' WHEN abs(d) >= 0.1 THEN 'high' WHEN abs(d) >= 0.05 THEN 'medium' ELSE 'low' END AS impact FROM (SELECT category, (avg(CASE WHEN ts >= TIMESTAMP '2026-04-01' THEN duration_ms END) - avg(CASE WHEN ts < TIMESTAMP '2026-04-01' THEN duration_ms END)) / avg(CASE WHEN ts < TIMESTAMP '2026-04-01' THEN duration_ms END) AS d FROM run GROUP BY 1)"))
def regression_report(spark: SparkSession, root: str) -> DataFrame:
    """Trend and size of the change of mean durations between two periods."""
    late = F.avg(F.when(F.col("ts") >= F.lit("2026-04-01").cast("timestamp_ntz"), F.col("duration_ms")))
    early = F.avg(F.when(F.col("ts") < F.lit("2026-04-01").cast("timestamp_ntz"), F.col("duration_ms")))
    r = G.runs(spark, root).groupBy("category").agg(((late - early) / early).alias("d"))
    trend = F.when(F.col("d") < -0.05, "improved").when(F.col("d") > 0.05, "degraded").otherwise("neutral")
    impact = F.when(F.abs("d") >= 0.2, "critical").when(F.abs("d") >= 0.1, "high").when(F.abs("d") >= 0.05, "medium").otherwise("low")
    return r.select("category", trend.alias("trend"), impact.alias("impact"))


@_add("precision_recall", sql("cal edg", "SELECT call_type, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT call_type, count_if(e AND r) AS tp, count_if(e AND NOT r) AS fp, count_if(r AND NOT e) AS fn FROM (SELECT call_type, coalesce(is_resolved, false) AS r, lower(trim(callee_symbol_id)) IN (SELECT dst FROM edg) IS TRUE AS e FROM cal) GROUP BY 1)"))
def precision_recall(spark: SparkSession, root: str) -> DataFrame:
    """Edges found against calls expected, by kind of call."""
    c = G.calls(spark, root).select("call_type", F.coalesce("is_resolved", F.lit(False)).alias("r"), F.lower(F.trim("callee_symbol_id")).alias("dst"))
    e = G.edges(spark, root).select("dst").distinct().withColumn("e", F.lit(True))
    j = c.join(e, "dst", "left").withColumn("e", F.coalesce("e", F.lit(False)))
    g = j.groupBy("call_type").agg(F.count_if(F.col("e") & F.col("r")).alias("tp"), F.count_if(F.col("e") & ~F.col("r")).alias("fp"), F.count_if(F.col("r") & ~F.col("e")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("call_type", "tp", "fp", "fn", F.round(C.rate(tp, tp + fp), 6).alias("prec"), F.round(C.rate(tp, tp + fn), 6).alias("recall"), F.round(C.rate(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


@_add("edge_confidence", sql("edg", "SELECT edge_id, round(greatest(0, least(1, base - CASE WHEN n > 1 THEN least(0.35, n * 0.04) ELSE 0 END)), 6) AS confidence FROM (SELECT edge_id, coalesce(confidence, CASE resolution WHEN 'exact' THEN 0.92 WHEN 'heuristic' THEN 0.72 WHEN 'unresolved' THEN 0.2 ELSE 0.5 END) AS base, count(*) OVER (PARTITION BY src, edge_type, split_part(dst, ':', 1)) AS n FROM edg)"))
def edge_confidence(spark: SparkSession, root: str) -> DataFrame:
    """Confidence of each edge less the cost of rival candidates of its source."""
    e = G.edges(spark, root).withColumn("family", F.split("dst", ":")[0])
    n = e.groupBy("src", "edge_type", "family").agg(_n().alias("n"))
    j = e.join(n, on=[e.src == n.src, e.edge_type.eqNullSafe(n.edge_type), e.family == n.family])
    return j.select("edge_id", F.round(C.calibrated(F.coalesce("confidence", C.confidence_of(F.col("resolution"))), F.col("n")), 6).alias("confidence"))


@_add("index_health", sql("sym edg", "SELECT s.repo_id, CAST(floor(100 * (0.25 * fresh + 0.35 * cover + 0.2 + 0.2 * coalesce(q, 1)) + 0.5) AS BIGINT) AS score FROM (SELECT repo_id, greatest(0, 1 - date_diff('minute', max(updated_at), (SELECT max(updated_at) FROM sym)) / 1440.0) AS fresh, count(summary) / count(*) AS cover FROM sym GROUP BY 1) s LEFT JOIN (SELECT repo_id, count_if(resolution <> 'unresolved') / count(*) AS q FROM edg JOIN sym ON sym.id = src WHERE edge_type = 'call' GROUP BY 1) e USING (repo_id)"))
def index_health(spark: SparkSession, root: str) -> DataFrame:
    """Weighted health of each repository."""
    s = G.symbols(spark, root)
    last = s.agg(F.date_trunc("minute", F.max("updated_at")).alias("now"))
    minutes = F.timestamp_diff("MINUTE", F.date_trunc("minute", F.max("updated_at")), F.max("now"))
    r = s.join(F.broadcast(last)).groupBy("repo_id").agg((1 - minutes / 1440.0).alias("fresh"), (F.count("summary") / _n()).alias("cover"))
    e = G.edges(spark, root).where("edge_type = 'call'").select(F.col("src").alias("id"), "resolution").join(s.select("id", "repo_id"), "id").groupBy("repo_id").agg((F.count_if(F.col("resolution") != "unresolved") / _n()).alias("q"))
    return r.join(e, "repo_id", "left").select("repo_id", C.health(F.col("fresh"), F.col("cover"), F.lit(1.0), F.coalesce("q", F.lit(1.0))).cast("bigint").alias("score"))


@_add("precision_score", sql("sym edg", "SELECT s.repo_id, round(0.25 * m + 0.25 * coalesce(q, 0) + 0.25 * f + 0.1 + 0.05, 3) AS score FROM (SELECT repo_id, count_if(symbol_status = 'real') / count(*) AS m, count_if(file_id IS NOT NULL) / count(*) AS f FROM sym GROUP BY 1) s LEFT JOIN (SELECT repo_id, count_if(resolution <> 'unresolved') / count(*) AS q FROM edg JOIN sym ON sym.id = src GROUP BY 1) e USING (repo_id)"))
def precision_score(spark: SparkSession, root: str) -> DataFrame:
    """Weighted precision of what a provider matched."""
    s = G.symbols(spark, root)
    r = s.groupBy("repo_id").agg((F.count_if(F.col("symbol_status") == "real") / _n()).alias("m"), (F.count("file_id") / _n()).alias("f"))
    e = G.edges(spark, root).select(F.col("src").alias("id"), "resolution").join(s.select("id", "repo_id"), "id").groupBy("repo_id").agg((F.count_if(F.col("resolution") != "unresolved") / _n()).alias("q"))
    return r.join(e, "repo_id", "left").select("repo_id", F.round(0.25 * C.clamp(F.col("m")) + 0.25 * C.clamp(F.col("q")) + 0.25 * C.clamp(F.col("f")) + 0.1 + 0.05, 3).alias("score"))


@_add("bottleneck", sql("run", "SELECT agent, CASE WHEN greatest(a, b, c) < 0.15 THEN 'balanced' WHEN a >= b AND a >= c THEN 'slow' WHEN b >= c THEN 'tokens' ELSE 'errors' END AS dominant, round(CASE WHEN greatest(a, b, c) < 0.15 THEN 1 - greatest(a, b, c) / 0.15 ELSE (greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c))) / greatest(a, b, c) END, 6) AS confidence FROM (SELECT agent, least(1, avg(duration_ms) / 60000) AS a, least(1, avg(total) / 50000) AS b, count_if(status IN ('fail', 'error', 'timeout')) / count(*) AS c FROM run GROUP BY 1)"))
def bottleneck(spark: SparkSession, root: str) -> DataFrame:
    """Which of several rule scores dominates, and by how much of itself it leads."""
    r = G.runs(spark, root).groupBy("agent").agg(F.least(F.lit(1.0), F.avg("duration_ms") / 60_000).alias("a"), F.least(F.lit(1.0), F.avg("total") / 50_000).alias("b"), (F.count_if(F.col("status").isin("fail", "error", "timeout")) / _n()).alias("c"))
    rules = F.array_sort(F.array(*(F.struct((-F.col(x)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (x, n) in enumerate((("a", "slow"), ("b", "tokens"), ("c", "errors"))))))
    r = r.select("agent", rules.alias("r"))
    top, second = -F.col("r")[0]["s"], -F.col("r")[1]["s"]
    return r.select("agent", F.when(top < 0.15, "balanced").otherwise(F.col("r")[0]["n"]).alias("dominant"), F.round(F.when(top < 0.15, 1 - top / 0.15).otherwise((top - second) / top), 6).alias("confidence"))


@_add("reference_count_page", sql("edg sym", "SELECT dst, edge_type, count(*) AS n FROM edg WHERE dst IN (SELECT id FROM sym WHERE file_id IS NULL) AND (dst > 'unresolved:c' OR (dst = 'unresolved:c' AND edge_type > 'call')) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100"))
def reference_count_page(spark: SparkSession, root: str) -> DataFrame:
    """Keyset page over (target, kind) of targets without a file."""
    t = G.symbols(spark, root).where("file_id is null").select(F.col("id").alias("dst"))
    after = (F.col("dst") > "unresolved:c") | ((F.col("dst") == "unresolved:c") & (F.col("edge_type") > "call"))
    return G.edges(spark, root).where(after).join(t, "dst", "left_semi").groupBy("dst", "edge_type").agg(_n().alias("n")).orderBy("dst", "edge_type").limit(100)


@_add("fan_in_counts", sql("edg", "SELECT dst AS id, count(*) AS n FROM edg GROUP BY 1"))
def fan_in_counts(spark: SparkSession, root: str) -> DataFrame:
    """Incoming edges of each target."""
    return G.edges(spark, root).groupBy(F.col("dst").alias("id")).agg(_n().alias("n"))


@_add("fan_out_counts", sql("edg", "SELECT src AS id, count(*) AS n FROM edg GROUP BY 1"))
def fan_out_counts(spark: SparkSession, root: str) -> DataFrame:
    """Outgoing edges of each source."""
    return G.edges(spark, root).groupBy(F.col("src").alias("id")).agg(_n().alias("n"))


@_add("version_hashes", sql("ver", "SELECT version_id, sha256(coalesce(prev_version_hash, 'none') || ':' || string_agg(coalesce(ast_fingerprint, ''), '|' ORDER BY symbol_id)) AS digest FROM ver JOIN versions USING (version_id) GROUP BY version_id, prev_version_hash"))
def version_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Chained digest over the fingerprints of each snapshot in symbol order."""
    v = table(spark, root, "versions").select("version_id", "prev_version_hash")
    r = G.versions(spark, root).select("version_id", "symbol_id", "ast_fingerprint").join(v, "version_id")
    return A.ordered_digest(r, "version_id", "symbol_id", "ast_fingerprint", "prev_version_hash")


@_add("top_fan_in", sql("met", "SELECT id, fan_in FROM met ORDER BY fan_in DESC, id LIMIT 10"))
def top_fan_in(spark: SparkSession, root: str) -> DataFrame:
    """Ten symbols with the largest fan-in."""
    return G.metrics(spark, root).select("id", "fan_in").orderBy(F.desc("fan_in"), "id").limit(10)


@_add("top_churn", sql("met", "SELECT id, churn30d FROM met ORDER BY churn30d DESC, id LIMIT 10"))
def top_churn(spark: SparkSession, root: str) -> DataFrame:
    """Ten symbols that changed most."""
    return G.metrics(spark, root).select("id", "churn30d").orderBy(F.desc("churn30d"), "id").limit(10)


@_add("hotness_score", sql("met", "SELECT id, round(0.5 * CASE WHEN fan_in > 0 THEN least(ln(fan_in + 1) / ln(101), 1) ELSE 0 END + 0.3 * CASE WHEN fan_out > 0 THEN least(ln(fan_out + 1) / ln(51), 1) ELSE 0 END + 0.2 * least(churn30d / 20, 1), 6) AS hotness FROM met"))
def hotness_score(spark: SparkSession, root: str) -> DataFrame:
    """Hotness of each symbol."""
    return G.metrics(spark, root).select("id", F.round(C.hotness(F.col("fan_in"), F.col("fan_out"), F.col("churn30d")), 6).alias("hotness"))


@_add("centrality_signal", sql("met", "SELECT id, round(0.6 * page_rank / (SELECT max(page_rank) FROM met) + 0.4 * k_core / (SELECT max(k_core) FROM met), 6) AS signal FROM met"))
def centrality_signal(spark: SparkSession, root: str) -> DataFrame:
    """Page rank and coreness against their maxima, which are one row."""
    m = G.metrics(spark, root)
    top = m.agg(F.max("page_rank").alias("tp"), F.max("k_core").alias("tk"))
    return m.join(F.broadcast(top)).select("id", F.round(C.centrality(F.col("page_rank"), F.col("k_core"), F.col("tp"), F.col("tk")), 6).alias("signal"))


@_add("symbol_score", sql("sym fil met", "SELECT s.id, round(0.15 / 0.4 * (0.5 * CASE WHEN fan_in > 0 THEN least(ln(fan_in + 1) / ln(101), 1) ELSE 0 END + 0.3 * CASE WHEN fan_out > 0 THEN least(ln(fan_out + 1) / ln(51), 1) ELSE 0 END + 0.2 * least(churn30d / 20, 1)) + 0.15 / 0.4 * greatest(0.15, CASE WHEN regexp_matches(lower(path), '/tests/|^tests/|dist-tests/|\\.test\\.|\\.spec\\.') THEN 0.55 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '^dist/|/dist/|^dist-tests/') THEN 0.6 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '^scripts/') THEN 0.75 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '(^|/)(target|vendor)/') THEN 0.3 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '\\.min\\.(js|css)$') THEN 0.2 ELSE 1 END * CASE WHEN regexp_matches(lower(path), '(^|/)(index|tools|types|main|mod|util|utils)\\.[^./]+$') THEN 0.72 ELSE 1 END) + 0.1 / 0.4 * CASE kind WHEN 'class' THEN 1 WHEN 'function' THEN 0.98 WHEN 'method' THEN 0.95 WHEN 'interface' THEN 0.9 WHEN 'type' THEN 0.88 WHEN 'constructor' THEN 0.8 WHEN 'module' THEN 0.7 ELSE 0.55 END, 6) AS score FROM sym s JOIN fil f USING (file_id) JOIN met m USING (id)"))
def symbol_score(spark: SparkSession, root: str) -> DataFrame:
    """Weighted score of hotness, place and kind."""
    s = G.symbols(spark, root).select("id", "kind", "file_id").join(G.files(spark, root).select("file_id", "path"), "file_id").join(G.metrics(spark, root), "id")
    total = 0.15 * C.hotness(F.col("fan_in"), F.col("fan_out"), F.col("churn30d")) + 0.15 * C.path_specificity(F.col("path")) + 0.1 * C.kind_specificity(F.col("kind"))
    return s.select("id", F.round(total / 0.4, 6).alias("score"))


@_add("latest_versions", "SELECT repo_id, max_by(version_id, created_at) AS version_id, count(*) AS versions FROM versions GROUP BY 1")
def latest_versions(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of each repository."""
    return table(spark, root, "versions").groupBy("repo_id").agg(F.max_by("version_id", "created_at").alias("version_id"), _n().alias("versions"))


@_add("version_list", "SELECT repo_id, version_id, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, version_id) AS pos FROM versions) WHERE pos <= 3")
def version_list(spark: SparkSession, root: str) -> DataFrame:
    """The three latest versions of each repository."""
    return A.top_per_group(table(spark, root, "versions").select("repo_id", "version_id", "created_at"), ["repo_id"], [F.desc("created_at"), F.asc("version_id")], 3).drop("created_at")


@_add("usage_history", sql("run", "SELECT run_id, ts, total FROM run WHERE ts >= TIMESTAMP '2026-06-01' ORDER BY ts DESC, run_id LIMIT 100"))
def usage_history(spark: SparkSession, root: str) -> DataFrame:
    """The newest records since a date."""
    return G.runs(spark, root).where("ts >= timestamp_ntz'2026-06-01'").select("run_id", "ts", "total").orderBy(F.desc("ts"), "run_id").limit(100)


@_add("strategy_summary", "SELECT event_type AS strategy, n, round(score, 6) AS score FROM (SELECT event_type, count(*) AS n, greatest(-1, least(1, 0.45 * count_if(value > 50) / count(*) + 0.25 * count_if(value > 80) / count(*) + 0.2 * greatest(0, least(1, sum(value) / (count(*) * 100))) - 0.5 * count_if(value < 10) / count(*))) AS score FROM events GROUP BY 1) ORDER BY abs(score) DESC, strategy LIMIT 5")
def strategy_summary(spark: SparkSession, root: str) -> DataFrame:
    """The five strategies whose score is farthest from zero."""
    v = F.col("value")
    e = table(spark, root, "events").groupBy(F.col("event_type").alias("strategy")).agg(_n().alias("n"), F.count_if(v > 50).alias("u"), F.count_if(v > 80).alias("a"), F.count_if(v < 10).alias("w"), F.sum(v).alias("s"))
    e = e.select("strategy", "n", C.prefetch_score(F.col("n"), F.col("u"), F.col("a"), F.col("w"), F.lit(0), F.col("s")).alias("score"))
    return e.orderBy(F.desc(F.abs("score")), "strategy").limit(5).withColumn("score", F.round("score", 6))


@_add("graph_metrics_gap", sql("edg met", "SELECT m.id, m.fan_in AS stored, coalesce(e.n, 0) AS counted FROM met m LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edg GROUP BY 1) e USING (id) WHERE m.fan_in <> coalesce(e.n, 0)"))
def graph_metrics_gap(spark: SparkSession, root: str) -> DataFrame:
    """Stored fan-in that differs from the edges."""
    m = G.metrics(spark, root).select("id", F.col("fan_in").alias("stored"))
    d = J.fan_in_out(m, G.edges(spark, root)).select("id", F.col("fan_in").alias("counted"))
    return m.join(d, "id").where("stored <> counted")


@_add("fan_in_at_version", sql("ver edg met", "SELECT v.symbol_id, coalesce(e.n, 0) AS fan_in, coalesce(m.fan_in, 0) AS fan_in_now FROM (SELECT symbol_id FROM ver WHERE version_id = (SELECT version_id FROM ver GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) v LEFT JOIN (SELECT dst, count(*) AS n FROM edg WHERE src IN (SELECT symbol_id FROM ver WHERE version_id = (SELECT version_id FROM ver GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) GROUP BY 1) e ON e.dst = v.symbol_id LEFT JOIN met m ON m.id = v.symbol_id"))
def fan_in_at_version(spark: SparkSession, root: str) -> DataFrame:
    """Fan-in within the largest snapshot, beside that of now."""
    v = G.versions(spark, root).select("version_id", "symbol_id")
    one = v.groupBy("version_id").count().orderBy(F.desc("count"), "version_id").limit(1)
    ids = v.join(F.broadcast(one), "version_id", "left_semi").select(F.col("symbol_id").alias("id"))
    e = G.edges(spark, root).join(ids.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(_n().alias("n"))
    return ids.join(e, "id", "left").join(G.metrics(spark, root).select("id", F.col("fan_in").alias("now")), "id", "left").select(F.col("id").alias("symbol_id"), F.coalesce("n", F.lit(0)).alias("fan_in"), F.coalesce("now", F.lit(0)).alias("fan_in_now"))
