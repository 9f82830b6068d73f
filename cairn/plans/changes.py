"""Queries: version deltas with their risk, event sequences, and record transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import aggregates as A
from ..operators import delta as D
from ..operators import sequences as Q
from ..operators import transforms as X
from ..sources import graph as G
from ..sources.graph import with_tables as sql
from ..sources.tables import table
from .registry import Registry

registry = Registry()
_add = registry.add


def _sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The latest and the one before of the snapshots with rows, over all repositories."""
    rows = G.versions(spark, root)
    have = rows.select("version_id").distinct()
    v = table(spark, root, "versions").join(have, "version_id", "left_semi").select("repo_id", "version_id", "created_at")
    at = A.top_per_group(v, ["repo_id"], [F.desc("created_at"), F.asc("version_id")], 2)
    new, old = (rows.join(F.broadcast(at.where(F.col("pos") == i).select("version_id")), "version_id", "left_semi") for i in (1, 2))
    return old, new


_TWO = "lastv AS (SELECT version_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, version_id) AS pos FROM versions WHERE version_id IN (SELECT version_id FROM ver)), o AS (SELECT * FROM ver WHERE version_id IN (SELECT version_id FROM lastv WHERE pos = 2)), n AS (SELECT * FROM ver WHERE version_id IN (SELECT version_id FROM lastv WHERE pos = 1))"
_SIG = "coalesce(json_object('n', json_extract_string({0}, '$.name'), 'r', json_extract_string({0}, '$.returns'), 'p', list_zip(json_extract_string({0}, '$.params[*].name'), json_extract_string({0}, '$.params[*].type')))::VARCHAR, {0})"
_SAFE = "CASE WHEN json_valid({0}) THEN " + _SIG + " ELSE {0} END"
_DELTA = f"{_TWO}, d0 AS (SELECT coalesce(o.symbol_id, n.symbol_id) AS symbol_id, o.symbol_id IS NULL AS a, n.symbol_id IS NULL AS r, o.ast_fingerprint IS NOT DISTINCT FROM n.ast_fingerprint AS f, {_SAFE.format('o.signature_json')} IS NOT DISTINCT FROM {_SAFE.format('n.signature_json')} AS g, o.summary IS NOT DISTINCT FROM n.summary AS s FROM o FULL JOIN n ON o.symbol_id = n.symbol_id), d AS (SELECT symbol_id, CASE WHEN a THEN 'added' WHEN r THEN 'removed' ELSE 'modified' END AS change_type, NOT a AND NOT r AND g AS interface_stable, NOT a AND NOT r AND f AND s AS behavior_stable, NOT a AND NOT r AS effects_stable FROM d0 WHERE a OR r OR NOT f OR (NOT s AND NOT g)), dr AS (SELECT *, 100 - CASE WHEN interface_stable THEN 33 ELSE 0 END - CASE WHEN behavior_stable THEN 33 ELSE 0 END - CASE WHEN effects_stable THEN 34 ELSE 0 END AS risk FROM d)"


def _delta(spark: SparkSession, root: str) -> DataFrame:
    return D.with_risk(D.version_delta(*_sides(spark, root)))


@_add("version_delta", sql("ver", "SELECT symbol_id, change_type FROM d", _DELTA))
def version_delta(spark: SparkSession, root: str) -> DataFrame:
    """Symbols that changed between the last two snapshots of each repository."""
    return _delta(spark, root).select("symbol_id", "change_type")


@_add("staleness_tiers", sql("ver", "SELECT change_type, interface_stable, behavior_stable, risk, count(*) AS n FROM dr GROUP BY ALL", _DELTA))
def staleness_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Changes by what stayed stable."""
    return _delta(spark, root).groupBy("change_type", "interface_stable", "behavior_stable", "risk").agg(F.count(F.lit(1)).alias("n"))


@_add("risk_score", sql("ver met", "SELECT symbol_id, CAST(least(100, risk + least(2 * coalesce(fan_in, 0), 20) + least(coalesce(fan_out, 0), 10)) AS INT) AS risk FROM dr LEFT JOIN met ON met.id = symbol_id", _DELTA))
def risk_score(spark: SparkSession, root: str) -> DataFrame:
    """Risk of each change with its reach."""
    m = G.metrics(spark, root).select(F.col("id").alias("symbol_id"), "fan_in", "fan_out")
    d = _delta(spark, root).join(m, "symbol_id", "left")
    return d.select("symbol_id", C.symbol_risk(F.col("risk"), F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0)), F.lit(False)).cast("int").alias("risk"))


_DEP = "dep AS (SELECT DISTINCT src AS id FROM edg WHERE dst IN (SELECT symbol_id FROM d) AND src NOT IN (SELECT symbol_id FROM d))"


def _dependents(spark: SparkSession, root: str, d: DataFrame) -> DataFrame:
    ids = d.select(F.col("symbol_id").alias("dst"))
    e = G.edges(spark, root).join(ids, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return e.join(ids.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("distance", F.lit(1))


@_add("pr_findings", sql("ver edg", "SELECT * FROM (SELECT 'high-risk-changes' AS finding, 'high' AS severity, count(*) AS n FROM dr WHERE risk >= 70 UNION ALL SELECT 'interface-breaking-changes', 'high', count(*) FROM dr WHERE NOT interface_stable AND change_type = 'modified' UNION ALL SELECT 'removed-symbols', 'medium', count(*) FROM dr WHERE change_type = 'removed' UNION ALL SELECT 'new-symbols', 'low', count(*) FROM dr WHERE change_type = 'added' UNION ALL SELECT 'large-impact-radius', 'medium', CASE WHEN count(*) > 10 THEN count(*) ELSE 0 END FROM dep) WHERE n > 0", f"{_DELTA}, {_DEP}"))
def pr_findings(spark: SparkSession, root: str) -> DataFrame:
    """What stands out in the changes of the last snapshots."""
    d = _delta(spark, root)
    return D.findings(d, _dependents(spark, root, d))


@_add("pr_risk", sql("ver edg met", "SELECT CAST(floor(least(100, 0.4 * (SELECT avg(risk) FROM dr) + 0.2 * 100 * (SELECT count_if(NOT interface_stable) / count(*) FROM dr) + 0.1 * 100 * (SELECT count_if(NOT effects_stable) / count(*) FROM dr) + 0.3 * least(100, (SELECT avg(100 * least(1, 0.4 + 0.3 * least(1, ln(coalesce(fan_in, 0) + 1) / ln(100))) * (1 + 0.25 * coalesce(page_rank / (SELECT max(page_rank) FROM met), 0))) FROM dep LEFT JOIN met USING (id)))) + 0.5) AS BIGINT) AS risk", f"{_DELTA}, {_DEP}"))
def pr_risk(spark: SparkSession, root: str) -> DataFrame:
    """Risk of the last snapshots' changes as one number."""
    d, m = _delta(spark, root), G.metrics(spark, root)
    top = m.agg(F.max("page_rank").alias("top"))
    dep = _dependents(spark, root, d).join(m, "id", "left").crossJoin(F.broadcast(top))
    rank = F.least(F.lit(1.0), 0.4 + 0.3 * F.least(F.lit(1.0), F.log(F.coalesce("fan_in", F.lit(0)) + 1.0) / F.log(F.lit(100.0))))
    return D.change_risk(d, dep.select(rank.alias("rank"), F.coalesce(F.col("page_rank") / F.col("top"), F.lit(0.0)).alias("signal")))


@_add("recommended_tests", sql("ver edg", "SELECT * FROM (SELECT 'unit-tests' AS kind, 'high' AS priority, count(*) AS n FROM dr WHERE change_type = 'modified' UNION ALL SELECT 'integration-tests', 'high', count(*) FROM dr WHERE NOT interface_stable AND change_type = 'modified' UNION ALL SELECT 'regression-tests', 'medium', count(*) FROM dep UNION ALL SELECT 'api-breakage-tests', 'high', count(*) FROM dr WHERE change_type = 'removed' UNION ALL SELECT 'new-coverage-tests', 'low', count(*) FROM dr WHERE change_type = 'added') WHERE n > 0", f"{_DELTA}, {_DEP}"))
def recommended_tests(spark: SparkSession, root: str) -> DataFrame:
    """Kinds of tests that the changes call for, with the number of symbols."""
    d = _delta(spark, root)
    n = d.agg(F.count_if(F.col("change_type") == "modified").alias("m"), F.count_if(~F.col("interface_stable") & (F.col("change_type") == "modified")).alias("i"), F.count_if(F.col("change_type") == "removed").alias("r"), F.count_if(F.col("change_type") == "added").alias("a"))
    n = n.crossJoin(_dependents(spark, root, d).agg(F.count(F.lit(1)).alias("d")))
    rules = [("unit-tests", "high", "m"), ("integration-tests", "high", "i"), ("regression-tests", "medium", "d"), ("api-breakage-tests", "high", "r"), ("new-coverage-tests", "low", "a")]
    return n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority"), F.col(c).alias("n")) for k, p, c in rules))).alias("x")).select("x.*").where("n > 0")


@_add("fan_in_trend", sql("ver edg", "SELECT symbol_id, a, b, CASE WHEN a > 0 THEN round((b - a) / a, 6) END AS growth, a > 0 AND (b - a) / a > 0.2 AS amplifier FROM (SELECT n.symbol_id, coalesce(x.c, 0) AS a, coalesce(y.c, 0) AS b FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM edg WHERE src IN (SELECT symbol_id FROM o) GROUP BY 1) x ON x.dst = n.symbol_id LEFT JOIN (SELECT dst, count(*) AS c FROM edg WHERE src IN (SELECT symbol_id FROM n) GROUP BY 1) y ON y.dst = n.symbol_id)", _TWO))
def fan_in_trend(spark: SparkSession, root: str) -> DataFrame:
    """Fan-in within the last two snapshots, and whether it grew by more than a fifth."""
    old, new = _sides(spark, root)
    e = G.edges(spark, root)
    count = lambda side, name: e.join(side.select(F.col("symbol_id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias(name))
    r = new.select("symbol_id").join(count(old, "a"), "symbol_id", "left").join(count(new, "b"), "symbol_id", "left").na.fill(0)
    growth = (F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0))
    return r.select("symbol_id", "a", "b", F.round(growth, 6).alias("growth"), F.coalesce(growth > 0.2, F.lit(False)).alias("amplifier"))


@_add("delta_array_diff", "WITH m AS (SELECT symbol_id, test_refs_json, updated_at, row_number() OVER (PARTITION BY symbol_id ORDER BY updated_at DESC, test_refs_json DESC) AS pos FROM symbol_metrics), p AS (SELECT a.symbol_id, CASE WHEN a.test_refs_json IS NULL THEN [] ELSE from_json(a.test_refs_json, '[\"VARCHAR\"]') END AS x, CASE WHEN b.test_refs_json IS NULL THEN [] ELSE from_json(b.test_refs_json, '[\"VARCHAR\"]') END AS y FROM m a JOIN m b ON a.symbol_id = b.symbol_id AND a.pos = 1 AND b.pos = 2) SELECT symbol_id, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))), ',') AS added, array_to_string(list_sort(list_distinct(list_filter(y, lambda v: NOT list_contains(x, v)))), ',') AS removed FROM p")
def delta_array_diff(spark: SparkSession, root: str) -> DataFrame:
    """Items of a JSON array that came and went between the last two rows of a key."""
    w = Window.partitionBy("symbol_id").orderBy(F.desc("updated_at"), F.desc("test_refs_json"))
    m = table(spark, root, "symbol_metrics").select("symbol_id", "test_refs_json", "updated_at").withColumn("pos", F.row_number().over(w)).withColumn("old", F.lead("test_refs_json").over(w)).withColumn("n", F.lead("pos").over(w)).where("pos = 1 and n is not null")
    plus, minus = D.array_delta(F.col("old"), F.col("test_refs_json"))
    return m.select("symbol_id", F.array_join(plus, ",").alias("added"), F.array_join(minus, ",").alias("removed"))


@_add("matched_symbols")
def matched_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of a file matched to its declared calls by name and overlap of lines."""
    s = G.symbols(spark, root).where("file_id is not null").select("id", "file_id", "name", F.lit("x").alias("kind"), F.col("range_start_line").alias("lo"), F.col("range_end_line").alias("hi"))
    c = G.calls(spark, root)
    f = G.files(spark, root).select("repo_id", "path", "file_id")
    part = F.split("caller_node_id", ":")
    c = c.select("repo_id", part[0].alias("path"), part[1].alias("name"), F.try_element_at(part, F.lit(3)).try_cast("bigint").alias("lo"), F.concat(F.lit("call:"), "call_id").alias("id"), F.col("end_line").cast("bigint").alias("hi"))
    new = c.join(f, ["repo_id", "path"]).where("lo is not null").select("id", "file_id", "name", F.lit("x").alias("kind"), "lo", "hi")
    return D.match_symbols(s, new)


_MATCHES = "c AS (SELECT repo_id, split_part(caller_node_id, ':', 1) AS path, split_part(caller_node_id, ':', 2) AS name, TRY_CAST(split_part(caller_node_id, ':', 3) AS BIGINT) AS lo, CAST(end_line AS BIGINT) AS hi FROM cal), m AS (SELECT f.file_id, 'index npm ' || c.repo_id || ' 1 ' || c.path || '/' || c.name || '().' AS index_symbol, s.id, s.kind IS DISTINCT FROM 'function' AS other, row_number() OVER (PARTITION BY f.file_id, c.path, c.name, c.repo_id ORDER BY c.lo, c.hi NULLS FIRST, s.kind IS DISTINCT FROM 'function', -greatest(0, least(c.hi, s.range_end_line) - greatest(c.lo, s.range_start_line) + 1), s.range_start_line NULLS FIRST, s.id) AS k FROM c JOIN fil f USING (repo_id, path) JOIN sym s ON s.file_id = f.file_id AND s.name = c.name WHERE c.lo IS NOT NULL AND c.name <> '')"


@_add("index_matches", sql("cal fil sym", "SELECT file_id, index_symbol, id, CASE WHEN other THEN 'nameOnly' ELSE 'exact' END AS how FROM m WHERE k = 1", _MATCHES))
def index_matches(spark: SparkSession, root: str) -> DataFrame:
    """Callers, written as symbols of an index, found among the symbols of their file."""
    part = F.split("caller_node_id", ":")
    c = G.calls(spark, root).select("repo_id", part[0].alias("path"), part[1].alias("name"), F.try_element_at(part, F.lit(3)).try_cast("bigint").alias("lo"), F.col("end_line").cast("bigint").alias("hi"))
    text = F.concat(F.lit("index npm "), "repo_id", F.lit(" 1 "), "path", F.lit("/"), "name", F.lit("()."))
    d = c.where("lo is not null").join(G.files(spark, root).select("repo_id", "path", "file_id"), ["repo_id", "path"]).select("file_id", text.alias("index_symbol"), F.lit("function").alias("kind"), "lo", "hi")
    s = G.symbols(spark, root).select("file_id", "id", "name", "kind", F.col("range_start_line").alias("lo"), F.col("range_end_line").alias("hi"))
    return D.match_index_symbols(d, s)


@_add("signature_hashes")
def signature_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Hash of the value of each different signature."""
    s = G.symbols(spark, root).select("signature_json").where("signature_json is not null").distinct()
    return s.select("signature_json", X.value_hash("signature_json").alias("hash"))


@_add("last_n_latency", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 899 PRECEDING AND CURRENT ROW)")
def last_n_latency(spark: SparkSession, root: str) -> DataFrame:
    """Mean over the last 900 entries of each key, whatever their age."""
    w = Q.last_n(["ts", "event_id"], 900, ["user_id"])
    return table(spark, root, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))


@_add("hit_rate_series", "SELECT event_id, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW), 6) AS rate FROM events")
def hit_rate_series(spark: SparkSession, root: str) -> DataFrame:
    """Share of hits over the last 1,440 entries of each key."""
    w = Q.last_n(["ts", "event_id"], 1440, ["user_id"])
    return table(spark, root, "events").select("event_id", F.round(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).over(w), 6).alias("rate"))


@_add("tumbling_rate", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_rate(spark: SparkSession, root: str) -> DataFrame:
    """Hourly counts by event time."""
    e = table(spark, root, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "value")


@_add("sliding_rate", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS start FROM events) GROUP BY 1")
def sliding_rate(spark: SparkSession, root: str) -> DataFrame:
    """Counts of three hours, every hour."""
    e = table(spark, root, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@_add("session_debounce", "WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last FROM s GROUP BY user_id, g")
def session_debounce(spark: SparkSession, root: str) -> DataFrame:
    """Runs of events with gaps below two hours, and the payload that fires after each."""
    return Q.sessions(table(spark, root, "events"), "user_id", "ts", 7200, F.col("event_type"), "event_id")


@_add("idle_keys", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def idle_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys whose newest event is old enough for a checkpoint."""
    e = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(e.agg(F.max("last").alias("now")))).where("last <= now - interval 2 hours").drop("now")


@_add("reconcile_queue", "SELECT user_id, min(ts) AS queued, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS files FROM events GROUP BY 1 ORDER BY queued, user_id LIMIT 10000")
def reconcile_queue(spark: SparkSession, root: str) -> DataFrame:
    """What waits for each key, oldest first, 10,000 keys."""
    e = table(spark, root, "events").groupBy("user_id").agg(F.min("ts").alias("queued"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("files"))
    return e.orderBy("queued", "user_id").limit(10_000)


@_add("version_gated_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS pos FROM events) WHERE pos = 1")
def version_gated_upsert(spark: SparkSession, root: str) -> DataFrame:
    """State after updates that count only if their version is newer."""
    return Q.newest(table(spark, root, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@_add("outcome_ewma", "WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL), r AS (SELECT user_id, n, CAST(value AS DOUBLE) AS e FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, r.e * 0.5 + s.value * 0.5 FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) SELECT user_id, max(n) AS n, round(arg_max(e, n), 6) AS ewma FROM r GROUP BY 1")
def outcome_ewma(spark: SparkSession, root: str) -> DataFrame:
    """Exponential mean of each key's values in order."""
    return Q.ewma(table(spark, root, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "n", F.round("ewma", 6).alias("ewma"))


@_add("trigram_transition", "WITH t AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL) SELECT a, b, arg_min(c, struct_pack(m := -n, c := c)) AS next, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY 1, 2 HAVING sum(n) >= 5 AND max(n) / sum(n) >= 0.2")
def trigram_transition(spark: SparkSession, root: str) -> DataFrame:
    """The likeliest next event after each pair."""
    return Q.transitions(table(spark, root, "events"), ["user_id"], ["ts", "event_id"], "event_type", 5, 0.2)


@_add("session_dedup", "SELECT event_id, row_number() OVER (PARTITION BY user_id, sha256(event_type || props) ORDER BY ts, event_id) > 1 AS unchanged FROM events")
def session_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Whether a session has seen the same content before."""
    return Q.first_seen(table(spark, root, "events"), ["user_id"], F.concat("event_type", "props"), ["ts", "event_id"]).select("event_id", "unchanged")


@_add("retention_sweep", "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1")
def retention_sweep(spark: SparkSession, root: str) -> DataFrame:
    """What is left after the retention of 14 days."""
    e = table(spark, root, "events").select("event_type", "ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where("ts >= now - interval 14 days").groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@_add("recency_decay", sql("sym met", "SELECT id, round(0.9::DOUBLE / (1 + date_diff('day', updated_at, (SELECT max(updated_at) FROM sym)) / 30.0::DOUBLE) * (1 + 0.1::DOUBLE * least(1, coalesce(page_rank, 0) * 100)), 9) AS score FROM sym LEFT JOIN met USING (id)"))
def recency_decay(spark: SparkSession, root: str) -> DataFrame:
    """Confidence that fades with age and gains by centrality."""
    s = G.symbols(spark, root).select("id", "updated_at")
    j = s.join(G.metrics(spark, root).select("id", "page_rank"), "id", "left").crossJoin(F.broadcast(s.agg(F.max("updated_at").alias("now"))))
    days = F.datediff("now", "updated_at")
    return j.select("id", F.round(0.9 / (1 + days / 30.0) * (1 + 0.1 * F.least(F.lit(1.0), F.coalesce("page_rank", F.lit(0.0)) * 100)), 9).alias("score"))


@_add("data_pick", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, NULL AS missing FROM events")
def data_pick(spark: SparkSession, root: str) -> DataFrame:
    """Named paths of each record; what does not resolve is null."""
    return X.data_pick(table(spark, root, "events"), {"event_id": "event_id", "k": "props.k", "kind": "event_type", "missing": "props.none.x"}, json=["props"])


@_add("data_map", "SELECT symbol_id, version_id, string_agg(name || ':' || type, ',' ORDER BY pos) AS params FROM (SELECT symbol_id, version_id, json_extract_string(signature_json, '$.params[' || i || '].name') AS name, json_extract_string(signature_json, '$.params[' || i || '].type') AS type, i AS pos FROM (SELECT DISTINCT symbol_id, version_id, signature_json FROM symbol_versions WHERE json_valid(signature_json)), range(0, 12) t(i) WHERE i < json_array_length(signature_json, '$.params')) GROUP BY ALL".replace("SELECT DISTINCT symbol_id, version_id, signature_json FROM symbol_versions WHERE json_valid(signature_json)", "SELECT symbol_id, version_id, max_by(signature_json, row_id) AS signature_json FROM symbol_versions WHERE json_valid(signature_json) GROUP BY 1, 2"))
def data_map(spark: SparkSession, root: str) -> DataFrame:
    """One record for each element of an array inside each record."""
    v = table(spark, root, "symbol_versions").select("symbol_id", "version_id", "row_id", F.from_json("signature_json", "params array<struct<name:string,type:string>>", {"mode": "PERMISSIVE"}).alias("s"), "signature_json").where(F.try_parse_json("signature_json").isNotNull())
    v = v.groupBy("symbol_id", "version_id").agg(F.max_by("s", "row_id").alias("s")).where(F.size("s.params") > 0)
    return v.select("symbol_id", "version_id", F.array_join(X.data_map(F.col("s.params"), lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("params"))


@_add("data_filter", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND event_type IN ('click', 'view') AND contains(props, 'k')")
def data_filter(spark: SparkSession, root: str) -> DataFrame:
    """Records that satisfy all clauses."""
    clauses = [("props.k", "gte", "50"), ("event_type", "in", ["click", "view"]), ("props", "contains", "k")]
    return X.data_filter(table(spark, root, "events"), clauses, "all", json=["props"]).select("event_id")


@_add("predicate_ops", "SELECT event_id, event_type = 'click' AS eq, event_type <> 'click' AS ne, value > 50 AS gt, value <= 10 AS lte, contains(lower(event_type), 'ic') AS icontains, props IS NOT NULL AS \"exists\", coalesce(TRY_CAST(event_type AS DOUBLE) > 1, false) AS text_gt FROM events")
def predicate_ops(spark: SparkSession, root: str) -> DataFrame:
    """Every clause operator on text and numbers."""
    e = table(spark, root, "events")
    ops = {"eq": ("event_type", "eq", "click"), "ne": ("event_type", "ne", "click"), "gt": ("value", "gt", 50), "lte": ("value", "lte", "10"), "icontains": ("event_type", "icontains", "IC"), "exists": ("props", "exists", None), "text_gt": ("event_type", "gt", 1)}
    return e.select("event_id", *(X.clause(e, *c).alias(n) for n, c in ops.items()))


@_add("data_sort", "SELECT event_id, CAST(row_number() OVER (ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) NULLS FIRST, event_id) AS BIGINT) AS pos FROM events ORDER BY 2 LIMIT 200")
def data_sort(spark: SparkSession, root: str) -> DataFrame:
    """The first 200 records by a typed key, null first, with their place."""
    e = X.data_sort(table(spark, root, "events"), [("props.k", "number", False)], ["event_id"], json=["props"]).limit(200)
    w = Window.orderBy(F.asc_nulls_first(X.path(e, "props.k", ["props"]).try_cast("double")), "event_id")
    return e.select("event_id", F.row_number().over(w).cast("bigint").alias("pos"))


@_add("data_template", "SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' (' || json_extract_string(props, '$.k') || ')' AS text FROM events")
def data_template(spark: SparkSession, root: str) -> DataFrame:
    """A line of text for each record."""
    return X.data_template(table(spark, root, "events"), "user {{user_id}} did {{event_type}} ({{props.k}})", "text", json=["props"]).select("event_id", "text")


@_add("json_path", "SELECT symbol_id, version_id, json_extract_string(sj, '$.params[0].type') AS first_type, json_extract_string(sj, '$.returns') AS returns, CAST(json_array_length(sj, '$.params') AS INT) AS arity FROM (SELECT symbol_id, version_id, max_by(signature_json, row_id) AS sj FROM symbol_versions WHERE json_valid(signature_json) GROUP BY 1, 2)")
def json_path(spark: SparkSession, root: str) -> DataFrame:
    """Dot paths with array places and lengths in a JSON column."""
    v = table(spark, root, "symbol_versions").where(F.try_parse_json("signature_json").isNotNull()).groupBy("symbol_id", "version_id").agg(F.max_by("signature_json", "row_id").alias("sj"))
    return v.select("symbol_id", "version_id", X.path(v, "sj.params[0].type", ["sj"]).alias("first_type"), X.path(v, "sj.returns", ["sj"]).alias("returns"), X.path(v, "sj.params.length", ["sj"]).cast("int").alias("arity"))
