"""Queries: selection, merging, windows and excerpts for a reader with a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import budget as B
from ..operators import excerpts as X
from ..operators import search as S
from ..operators import sequences as Q
from ..sources import graph as G
from ..sources.graph import with_tables as sql
from ..sources.tables import table
from .graphs import greedy_sql
from .registry import Registry

registry = Registry()
_add = registry.add


@_add("adaptive_edges", sql("edg met", "SELECT edge_id FROM edg JOIN met ON met.id = edg.src WHERE confidence >= CASE WHEN fan_out / 20.0 > 0.9 THEN greatest(0.5, 0.95) WHEN fan_out / 20.0 > 0.7 THEN greatest(0.5, 0.8) ELSE 0.5 END"))
def adaptive_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges under a least confidence that rises as a source's budget of 20 is used up."""
    m = G.metrics(spark, root).select(F.col("id").alias("src"), (F.col("fan_out") / 20.0).alias("used"))
    least = C.adaptive_confidence(F.lit(0.5), F.col("used"))
    return G.edges(spark, root).join(m, "src").where(F.col("confidence") >= least).select("edge_id")


@_add("blast_seeds", sql("met", "SELECT id, risk FROM (SELECT id, CAST(least(100, fan_in * 2 + fan_out) AS BIGINT) AS risk FROM met) WHERE risk >= 20 ORDER BY risk DESC, id LIMIT 500"))
def blast_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Changed symbols worth a walk: risky enough, the 500 riskiest."""
    m = G.metrics(spark, root).select("id", F.least(F.lit(100), F.col("fan_in") * 2 + F.col("fan_out")).cast("bigint").alias("risk"))
    return m.where("risk >= 20").orderBy(F.desc("risk"), "id").limit(500)


@_add("budget_eviction", sql("sym met", "SELECT repo_id, id, used FROM (SELECT repo_id, id, CAST(sum(t) OVER (PARTITION BY repo_id ORDER BY e DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT s.repo_id, s.id, coalesce(m.fan_in, 0) AS e, 50 + length(coalesce(s.name, '')) AS t FROM sym s LEFT JOIN met m USING (id))) WHERE used <= 2000"))
def budget_eviction(spark: SparkSession, root: str) -> DataFrame:
    """What stays of each repository when the weakest evidence goes until 2,000 tokens fit."""
    s = G.symbols(spark, root).select("repo_id", "id", (50 + F.length(F.coalesce("name", F.lit("")))).alias("t")).join(G.metrics(spark, root).select("id", "fan_in"), "id", "left").withColumn("e", F.coalesce("fan_in", F.lit(0)))
    return B.token_prefix(s, ["repo_id"], [F.desc("e"), F.asc("id")], "t", 2000).select("repo_id", "id", "used")


_HOT = "0.5 * CASE WHEN fan_in > 0 THEN least(ln(fan_in + 1) / ln(101), 1) ELSE 0 END + 0.3 * CASE WHEN fan_out > 0 THEN least(ln(fan_out + 1) / ln(51), 1) ELSE 0 END + 0.2 * least(churn30d / 20, 1)"
_CARDS = f"SELECT id, t, CAST(row_number() OVER (ORDER BY round(hot / t, 12) DESC, id) AS INT) AS rn FROM (SELECT id, {_HOT} AS hot, CAST(50 + ceil(length(coalesce(name, '')) / 4.0) + ceil(length(coalesce(signature_json, '')) / 4.0) + least(ceil(length(coalesce(summary, '')) / 4.0), 150) AS BIGINT) AS t FROM sym JOIN met USING (id))"


@_add("tier_selection", sql("sym met", "SELECT id, t AS tokens FROM it JOIN g USING (rn) WHERE kept", greedy_sql(_CARDS, 60, 6000)))
def tier_selection(spark: SparkSession, root: str) -> DataFrame:
    """Symbols by value for each token within a budget, later smaller ones after larger ones that did not fit."""
    s = G.symbols(spark, root).select("id", T.card_estimate(F.col("name"), F.col("signature_json"), F.col("summary"), F.lit(0)).alias("tokens")).join(G.metrics(spark, root), "id")
    value = C.hotness(F.col("fan_in"), F.col("fan_out"), F.col("churn30d"))
    items = s.select((-F.round(value / F.col("tokens"), 12)).alias("order"), "id", "tokens")
    return B.greedy_budget(items, ["order", "id"], "tokens", 60, 6000).where("kept").select("id", "tokens")


for _keep, _where in (("start", "a <= 5"), ("end", "b <= 5"), ("both", "a <= 3 OR b <= 2")):

    @_add(f"count_truncation_{_keep}", sql("sym", f"SELECT file_id, id, CAST(a AS INT) AS pos FROM (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY range_start_line, id) AS a, row_number() OVER (PARTITION BY file_id ORDER BY range_start_line DESC, id DESC) AS b FROM sym WHERE file_id IS NOT NULL AND range_start_line IS NOT NULL) WHERE {_where}"))
    def count_truncation(spark: SparkSession, root: str, keep: str = _keep) -> DataFrame:
        """Five symbols of each file from its start, its end, or both."""
        s = G.symbols(spark, root).where("file_id is not null and range_start_line is not null").select("file_id", "id", "range_start_line")
        return X.truncated(s, ["file_id"], ["range_start_line", "id"], 5, keep).select("file_id", "id", "pos")


@_add("exact_first", sql("sym", "SELECT id, name, CAST(pos AS INT) AS pos FROM (SELECT id, name, row_number() OVER (ORDER BY CASE WHEN name = (SELECT min(name) FROM sym) THEN 0 WHEN starts_with(lower(name), 'split') THEN 1 ELSE 2 END, id) AS pos FROM sym WHERE name IS NOT NULL) WHERE pos <= 300"))
def exact_first(spark: SparkSession, root: str) -> DataFrame:
    """Results with exact matches moved to the front, the rest in their order."""
    s = G.symbols(spark, root).where("name is not null").select("id", "name")
    top = F.broadcast(s.agg(F.min("name").alias("want")))
    bucket = F.when(F.col("name") == F.col("want"), 0).when(F.startswith(F.lower("name"), F.lit("split")), 1).otherwise(2)
    return s.crossJoin(top).withColumn("bucket", bucket).orderBy("bucket", "id").limit(300).withColumn("pos", F.row_number().over(Window.orderBy("bucket", "id"))).select("id", "name", "pos")


_SEARCH = "hit AS (SELECT s.id, s.name, s.kind, coalesce(f.path, '') AS path, false AS draft FROM sym s LEFT JOIN fil f USING (file_id) WHERE contains(lower(s.name), 'batch') AND s.updated_at < (SELECT max(updated_at) FROM sym) - INTERVAL 3 DAY UNION ALL SELECT s.id, s.name, s.kind, coalesce(f.path, ''), true FROM sym s LEFT JOIN fil f USING (file_id) WHERE contains(lower(s.name), 'batch') AND s.updated_at >= (SELECT max(updated_at) FROM sym) - INTERVAL 3 DAY), r AS (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY CASE WHEN regexp_matches(path, '/adapter/|(^|/)tests/|^scripts/|\\.test\\.|\\.spec\\.|target/|vendor/') THEN 2 ELSE 0 END, coalesce(list_position(['class', 'function', 'interface', 'type', 'method', 'constructor', 'module'], kind), 8), name, path, id) AS k FROM hit)"


@_add("overlay_search", sql("sym fil", "SELECT id, name, draft FROM r WHERE draft OR k <= greatest(0, 100 - (SELECT count(*) FROM r WHERE draft))", _SEARCH))
def overlay_search(spark: SparkSession, root: str) -> DataFrame:
    """Durable results beside draft ones: drafts are never cut, they reserve their slots among 100."""
    s = G.symbols(spark, root).join(G.files(spark, root).select("file_id", "path"), "file_id", "left").select("id", "name", "kind", F.coalesce("path", F.lit("")).alias("path"), "updated_at")
    now = F.broadcast(G.symbols(spark, root).agg(F.max("updated_at").alias("now")))
    hit = s.where(F.contains(F.lower("name"), F.lit("batch"))).crossJoin(now).withColumn("draft", F.col("updated_at") >= F.expr("now - interval 3 days"))
    w = Window.partitionBy("draft").orderBy(S.file_penalty(F.col("path")), C.kind_rank(F.col("kind")), "name", "path", "id")
    drafts = F.broadcast(hit.agg(F.count_if("draft").alias("reserved")))
    return hit.withColumn("k", F.row_number().over(w)).crossJoin(drafts).where(F.col("draft") | (F.col("k") <= F.greatest(F.lit(0), 100 - F.col("reserved")))).select("id", "name", "draft")


@_add("task_scoped_ranking", sql("sym fil", "SELECT id, score, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM (SELECT s.id, CAST(3 * (CASE WHEN contains(lower(path), 'core') THEN 1 ELSE 0 END + CASE WHEN contains(lower(path), 'cache') THEN 1 ELSE 0 END) + CASE WHEN regexp_matches(lower(path), '(^|/)tests/|\\.test\\.|\\.spec\\.') THEN -6 ELSE 0 END + CASE WHEN starts_with(path, 'src/') THEN 2 ELSE 0 END + CASE WHEN exported THEN 2 ELSE 0 END AS INT) AS score FROM sym s JOIN fil USING (file_id) WHERE path IS NOT NULL)) WHERE pos <= 200"))
def task_scoped_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Symbols by how their path fits a task; tests lose, exported source gains."""
    p = F.lower("path")
    score = 3 * (F.when(F.contains(p, F.lit("core")), 1).otherwise(0) + F.when(F.contains(p, F.lit("cache")), 1).otherwise(0)) + F.when(T.is_test_path(F.col("path")), -6).otherwise(0) + F.when(F.startswith("path", F.lit("src/")), 2).otherwise(0) + F.when(F.col("exported"), 2).otherwise(0)
    s = G.symbols(spark, root).select("id", "file_id", "exported").join(G.files(spark, root).where("path is not null").select("file_id", "path"), "file_id").select("id", score.cast("int").alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(200).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@_add("focus_partition", sql("fil", "SELECT file_id, CAST(bucket AS INT) AS bucket FROM (SELECT file_id, CASE WHEN starts_with(lower(path), 'src/core/') THEN 0 WHEN starts_with(lower(path), 'src/') THEN 1 ELSE 2 END AS bucket, path FROM fil WHERE path IS NOT NULL ORDER BY 2, 3, 1 LIMIT 250)"))
def focus_partition(spark: SparkSession, root: str) -> DataFrame:
    """Candidates in three stable parts: the focus, its parent folder, the rest."""
    p = F.lower("path")
    bucket = F.when(F.startswith(p, F.lit("src/core/")), 0).when(F.startswith(p, F.lit("src/")), 1).otherwise(2)
    return G.files(spark, root).where("path is not null").select("file_id", bucket.alias("bucket"), "path").orderBy("bucket", "path", "file_id").limit(250).drop("path")


@_add("narrowed_files", sql("sym fil", "SELECT file_id, CAST(min(pos) AS INT) AS pos FROM (SELECT s.file_id, row_number() OVER (ORDER BY CASE WHEN lower(s.name) = 'split' THEN 0 ELSE 1 END, length(s.name), s.id) AS pos FROM sym s WHERE contains(lower(s.name), 'split')) JOIN fil USING (file_id) GROUP BY 1"))
def narrowed_files(spark: SparkSession, root: str) -> DataFrame:
    """Distinct files of a search's symbols by their best place."""
    s = G.symbols(spark, root).where(F.contains(F.lower("name"), F.lit("split"))).select("file_id", "id", "name")
    order = s.select("file_id", "id", F.when(F.lower("name") == "split", 0).otherwise(1).alias("other"), F.length("name").alias("size"))
    return A.numbered(order, ["other", "size", "id"], "pos").join(G.files(spark, root).select("file_id"), "file_id").groupBy("file_id").agg(F.min("pos").cast("int").alias("pos"))


@_add("catalog_ranking", "SELECT p_partkey, score FROM (SELECT p_partkey, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')), ['part', 'item', '7', 'seven'])) AS INT) AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 100")
def catalog_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Catalog entries by how many words or synonyms of a query they hold."""
    words = F.array(*map(F.lit, ("part", "item", "7", "seven")))
    score = F.size(F.array_intersect(F.array_distinct(F.split(F.lower("p_name"), "[^a-z0-9]+")), words))
    return table(spark, root, "part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(100)


@_add("note_query", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND contains(lower(text), 'order') AND contains(lower(text), 'stable') AND doc_kind IN ('issue', 'review') ORDER BY created_at DESC, doc_id LIMIT 50")
def note_query(spark: SparkSession, root: str) -> DataFrame:
    """Notes that hold every word and have one of the kinds, newest first."""
    words = F.array(F.lit("order"), F.lit("stable"))
    d = table(spark, root, "documents").where("text is not null and doc_kind in ('issue', 'review')")
    return d.where(F.forall(words, lambda w: F.contains(F.lower("text"), w))).orderBy(F.desc("created_at"), "doc_id").limit(50).select("doc_id")


@_add("code_windows", "SELECT doc_id, array_to_string(list_slice(ls, f, f + 4), chr(10)) AS lines FROM (SELECT doc_id, ls, greatest(1, least(c - 2, len(ls) - 4)) AS f FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, len(ls) // 2 + 1 AS c FROM documents WHERE text IS NOT NULL))")
def code_windows(spark: SparkSession, root: str) -> DataFrame:
    """Five lines around the middle line of every text."""
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", X.line_window(F.col("text"), F.floor(F.size(F.split("text", "\n")) / 2) + 1, 5).alias("lines"))


@_add("hot_excerpts")
def hot_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """Ranges around lines with given words in every text, within a budget."""
    return X.excerpts(table(spark, root, "documents"), "doc_id", "text", ["ledger", "token"])


_SAME = "CASE WHEN coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i]), true), 0) > 0 THEN list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i]), true) - 1 ELSE least(len({a}), len({b})) END"
_DELTAS = f"d AS (SELECT repo_id, symbol_id, version_id, signature_json AS new, lag(signature_json) OVER w AS old, row_number() OVER w AS rn FROM ver JOIN (SELECT version_id, repo_id, created_at FROM versions) USING (version_id) WINDOW w AS (PARTITION BY repo_id, symbol_id ORDER BY created_at, version_id)), x AS (SELECT *, CASE WHEN old IS NULL THEN [] ELSE string_split(old, chr(10)) END AS a, CASE WHEN new IS NULL THEN [] ELSE string_split(new, chr(10)) END AS b FROM d WHERE rn > 1 AND old IS DISTINCT FROM new), y AS (SELECT *, {_SAME.format(a='a', b='b')} AS head, list_reverse(a) AS ra, list_reverse(b) AS rb FROM x), z AS (SELECT *, least({_SAME.format(a='ra', b='rb')}, least(len(a), len(b)) - head) AS tail FROM y)"


@_add("session_deltas", sql("ver", "SELECT symbol_id, version_id, CAST(head + 1 AS INT) AS line, CAST(greatest(0, len(a) - head - tail) AS INT) AS removed, CAST(greatest(0, len(b) - head - tail) AS INT) AS added FROM z", _DELTAS))
def session_deltas(spark: SparkSession, root: str) -> DataFrame:
    """What a symbol's signature text changed against the snapshot before, as one hunk of lines."""
    v = table(spark, root, "versions").select("version_id", "repo_id", "created_at")
    r = G.versions(spark, root).select("version_id", "symbol_id", "signature_json").join(v, "version_id")
    w = Window.partitionBy("repo_id", "symbol_id").orderBy("created_at", "version_id")
    d = r.withColumn("old", F.lag("signature_json").over(w)).withColumn("first", F.row_number().over(w) == 1).where("not first and not (signature_json <=> old)")
    x = X.line_delta(F.col("old"), F.col("signature_json"))
    return d.select("symbol_id", "version_id", x["line"].alias("line"), F.size(x["removed"]).alias("removed"), F.size(x["added"]).alias("added"))


@_add("output_digest", "SELECT doc_id, count(*) AS lines, count_if(contains(line, ' ERR ')) AS errors, count_if(contains(line, ' WARN ')) AS warnings, count_if(contains(line, ' INFO ')) AS infos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^\\d\\d:\\d\\d:\\d\\d\\.\\d+ ') GROUP BY 1")
def output_digest(spark: SparkSession, root: str) -> DataFrame:
    """Log lines of every text by their level."""
    ln = table(spark, root, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\d\d:\d\d:\d\d\.\d+ "))
    level = lambda x: F.count_if(F.contains("line", F.lit(f" {x} ")))
    return ln.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), level("ERR").alias("errors"), level("WARN").alias("warnings"), level("INFO").alias("infos"))


_MODEL = "t AS (SELECT user_id, ts, event_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL), m AS (SELECT a, b, arg_min(c, struct_pack(m := -n, c := c)) AS next FROM k GROUP BY 1, 2 HAVING sum(n) >= 5 AND max(n) / sum(n) >= 0.2), l AS (SELECT user_id, max(CASE WHEN p = 2 THEN event_type END) AS a, max(CASE WHEN p = 1 THEN event_type END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 2 GROUP BY 1)"


@_add("predict_next", f"WITH {_MODEL} SELECT user_id, m.next FROM l LEFT JOIN m USING (a, b)")
def predict_next(spark: SparkSession, root: str) -> DataFrame:
    """The likeliest next event of each key after its last two."""
    e = table(spark, root, "events")
    model = Q.transitions(e, ["user_id"], ["ts", "event_id"], "event_type", 5, 0.2).select("a", "b", "next")
    last = A.top_per_group(e.select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2)
    pair = last.groupBy("user_id").agg(F.max(F.when(F.col("pos") == 2, F.col("event_type"))).alias("a"), F.max(F.when(F.col("pos") == 1, F.col("event_type"))).alias("b"))
    return pair.join(model, ["a", "b"], "left").select("user_id", "next")


@_add("lifetime_counters", "SELECT event_type, CAST(least(1000000, sum(k)) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def lifetime_counters(spark: SparkSession, root: str) -> DataFrame:
    """Counters that add up over parts and stop at a million."""
    e = table(spark, root, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.least(F.lit(1_000_000), F.sum("k")).alias("total"))


@_add("policy_paths", sql("run", "SELECT run_id, CASE WHEN total > 100000 THEN 'over' WHEN total > 20000 THEN 'high' WHEN total IS NULL THEN 'unknown' ELSE 'normal' END AS band FROM run"))
def policy_paths(spark: SparkSession, root: str) -> DataFrame:
    """The first of prioritised conditions that a record meets."""
    t = F.col("total")
    return G.runs(spark, root).select("run_id", F.when(t > 100_000, "over").when(t > 20_000, "high").when(t.isNull(), "unknown").otherwise("normal").alias("band"))


@_add("short_ids", "SELECT user_id, CAST(row_number() OVER (ORDER BY first, user_id) AS BIGINT) AS short FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY 1)")
def short_ids(spark: SparkSession, root: str) -> DataFrame:
    """Each key's place in the order in which keys were first seen."""
    first = table(spark, root, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return A.numbered(first, ["first", "user_id"], "short").select("user_id", "short")


@_add("packed_rows", sql("edg", "SELECT edge_id, src, dst, edge_type, weight FROM edg"))
def packed_rows(spark: SparkSession, root: str) -> DataFrame:
    """Edges as lines of text that decode to the same rows."""
    e = G.edges(spark, root).select("edge_id", "src", "dst", "edge_type", "weight")
    return X.unpack_rows(X.pack_rows(e, e.columns), "edge_id bigint, src string, dst string, edge_type string, weight double")
