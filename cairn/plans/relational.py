"""Queries: scans, filters, joins and set operations over the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import scans as S
from ..sources import graph as G
from ..sources.graph import with_tables as sql
from ..sources.tables import table
from .registry import Registry

registry = Registry()
_add = registry.add


@_add("symbols_by_repo", sql("sym", "SELECT repo_id, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE exported) AS BIGINT) AS exported FROM sym GROUP BY ALL"))
def symbols_by_repo(spark: SparkSession, root: str) -> DataFrame:
    """Label scan with a property filter, counted by repository and kind."""
    return G.symbols(spark, root).groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("exported").alias("exported"))


@_add("symbols_lite", sql("sym", "SELECT symbol_id, name, kind FROM sym WHERE symbol_status = 'real' AND deleted_at IS NULL"))
def symbols_lite(spark: SparkSession, root: str) -> DataFrame:
    """Narrow scan: three columns of living real symbols."""
    return G.symbols(spark, root).where("symbol_status = 'real' and deleted_at is null").select("symbol_id", "name", "kind")


@_add("symbol_page", sql("sym", "SELECT symbol_id, name FROM sym WHERE symbol_status = 'real' AND symbol_id > '8' ORDER BY symbol_id LIMIT 100"))
def symbol_page(spark: SparkSession, root: str) -> DataFrame:
    """Keyset page of real symbols."""
    return S.keyset_page(G.symbols(spark, root).where("symbol_status = 'real'").select("symbol_id", "name"), "symbol_id", "8", 100)


@_add("symbol_lookup", sql("sym", "SELECT symbol_id, name, kind, file_id FROM sym WHERE id = (SELECT min(id) FROM sym)"))
def symbol_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Point lookup on the primary key."""
    s = G.symbols(spark, root)
    return S.lookup(s, "id", s.agg(F.min("id").alias("id"))).select("symbol_id", "name", "kind", "file_id")


@_add("called_symbols", sql("sym edg", "SELECT symbol_id, name, kind FROM sym WHERE id IN (SELECT dst FROM edg WHERE edge_type = 'call')"))
def called_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Multi-get of a list of ids that is a table."""
    ids = G.edges(spark, root).where("edge_type = 'call'").select(F.col("dst").alias("id"))
    return S.lookup(G.symbols(spark, root), "id", ids).select("symbol_id", "name", "kind")


@_add("existing_targets", sql("sym edg", "SELECT DISTINCT dst AS id FROM edg WHERE dst IN (SELECT id FROM sym)"))
def existing_targets(spark: SparkSession, root: str) -> DataFrame:
    """Existence multi-get: the targets that exist."""
    targets = G.edges(spark, root).select(F.col("dst").alias("id")).distinct()
    return S.lookup(targets, "id", G.symbols(spark, root))


@_add("files_by_prefix", sql("fil sym", "SELECT file_id, path FROM fil WHERE starts_with(path, 'src/') AND file_id NOT IN (SELECT file_id FROM sym WHERE kind = 'class' AND file_id IS NOT NULL) ORDER BY path, file_id LIMIT 200"))
def files_by_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Prefix scan without files that declare a class, first 200 in order."""
    classes = G.symbols(spark, root).where("kind = 'class' and file_id is not null").select("file_id")
    return S.prefix_scan(G.files(spark, root), "path", "src/", exclude=classes, key="file_id").select("file_id", "path")


@_add("files_by_directory", sql("fil", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, CAST(count(*) AS BIGINT) AS files, CAST(sum(byte_size) AS BIGINT) AS bytes FROM fil WHERE path LIKE '%/%' GROUP BY 1"))
def files_by_directory(spark: SparkSession, root: str) -> DataFrame:
    """Directory equality scan for every directory at once."""
    f = G.files(spark, root).where("path like '%/%'").withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return f.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("byte_size").alias("bytes"))


@_add("paths_to_ids", sql("fil cal", "SELECT DISTINCT repo_id, path, file_id FROM fil JOIN (SELECT DISTINCT repo_id, split_part(caller_node_id, ':', 1) AS path FROM cal) USING (repo_id, path)"))
def paths_to_ids(spark: SparkSession, root: str) -> DataFrame:
    """Bulk lookup of the paths that callers name."""
    wanted = G.calls(spark, root).select("repo_id", F.split("caller_node_id", ":")[0].alias("path")).distinct()
    return G.files(spark, root).join(wanted, ["repo_id", "path"]).select("repo_id", "path", "file_id").distinct()


@_add("scoped_pool", sql("sym fil", "SELECT path, symbol_id, name FROM sym JOIN fil USING (file_id) WHERE lower(path) = 'src/core' OR starts_with(lower(path), 'src/core/')"))
def scoped_pool(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of a path scope, without letter case."""
    return G.symbols(spark, root).select("file_id", "symbol_id", "name").join(G.files(spark, root), "file_id").where(S.in_scope(F.col("path"), "src/core")).select("path", "symbol_id", "name")


_EXT = "CASE WHEN regexp_matches(path, '\\.(ts|tsx|js|jsx|py|go|java|rs|c|cs|kt|php|sh)$') AND byte_size <= 200000 THEN 1 ELSE 0 END"


@_add("scan_by_language", sql("fil", f"SELECT lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS ext, CAST(count(*) AS BIGINT) AS files, CAST(sum({_EXT}) AS BIGINT) AS kept FROM fil GROUP BY 1"))
def scan_by_language(spark: SparkSession, root: str) -> DataFrame:
    """Repository scan with the language filter and the size cap."""
    keep = F.col("path").rlike(r"\.(ts|tsx|js|jsx|py|go|java|rs|c|cs|kt|php|sh)$") & (F.col("byte_size") <= 200_000)
    return G.files(spark, root).groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(keep, 1).otherwise(0)).alias("kept"))


@_add("drop_compiled", sql("fil", "SELECT file_id, path FROM fil f WHERE NOT (path LIKE '%.js' AND EXISTS (SELECT 1 FROM fil t WHERE t.path = regexp_replace(f.path, '\\.js$', '.ts')))"))
def drop_compiled(spark: SparkSession, root: str) -> DataFrame:
    """Files without compiled output that shadows its source."""
    return S.drop_compiled(G.files(spark, root), "path").select("file_id", "path")


@_add("changed_files", "WITH a AS (SELECT file_id, max_by(content_hash, last_indexed_at) AS h FROM source_files WHERE last_indexed_at < TIMESTAMP '2026-05-01' GROUP BY 1), b AS (SELECT file_id, max_by(content_hash, last_indexed_at) AS h FROM source_files WHERE last_indexed_at >= TIMESTAMP '2026-04-01' GROUP BY 1) SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN a.file_id IS NULL THEN 'added' WHEN b.file_id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.file_id = b.file_id")
def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """Incremental scan: the files known before against the files seen now."""
    f = table(spark, root, "source_files")
    side = lambda c: f.where(c).groupBy("file_id").agg(F.max_by("content_hash", "last_indexed_at").alias("h"))
    return S.classify_changes(side("last_indexed_at < timestamp_ntz'2026-05-01'"), side("last_indexed_at >= timestamp_ntz'2026-04-01'"), "file_id", "h")


@_add("churn_30d", "SELECT user_id, CAST(count(*) AS BIGINT) AS churn FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def churn_30d(spark: SparkSession, root: str) -> DataFrame:
    """Changes of each key in the last 30 days."""
    e = table(spark, root, "events").select("user_id", "ts")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).where("ts > last - interval 30 days").groupBy("user_id").agg(F.count(F.lit(1)).alias("churn"))


@_add("boundary_symbols", sql("sym", "SELECT symbol_id FROM sym WHERE (coalesce(symbol_status, 'real') = 'real' AND coalesce(file_id, '') <> '') OR (symbol_status = 'external' AND placeholder_kind = 'scip')"))
def boundary_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Symbols that a search may return."""
    ok = "(coalesce(symbol_status, 'real') = 'real' and coalesce(file_id, '') <> '') or (symbol_status = 'external' and placeholder_kind = 'scip')"
    return G.symbols(spark, root).where(ok).select("symbol_id")


@_add("target_kinds", sql("edg", "SELECT CASE WHEN starts_with(dst, 'unresolved:call:') THEN 'unresolved call' WHEN starts_with(dst, 'unresolved:') THEN 'unresolved import' WHEN starts_with(dst, 'external:') OR starts_with(dst, 'scip:') THEN 'external' ELSE 'real' END AS target, CAST(count(*) AS BIGINT) AS n FROM edg GROUP BY 1"))
def target_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Dependency targets by what their id's prefix says."""
    d = F.col("dst")
    kind = F.when(d.startswith("unresolved:call:"), "unresolved call").when(d.startswith("unresolved:"), "unresolved import").when(d.startswith("external:") | d.startswith("scip:"), "external").otherwise("real")
    return G.edges(spark, root).groupBy(kind.alias("target")).agg(F.count(F.lit(1)).alias("n"))


@_add("unresolved_imports", sql("edg", "SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM edg WHERE edge_type = 'import' AND starts_with(dst, 'unresolved:') GROUP BY ALL"))
def unresolved_imports(spark: SparkSession, root: str) -> DataFrame:
    """Import edges to targets that are not resolved."""
    return G.edges(spark, root).where("edge_type = 'import'").where(F.col("dst").startswith("unresolved:")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_add("weak_call_candidates", sql("edg sym fil", "SELECT e.edge_id, e.src, e.dst, f.path FROM edg e JOIN sym s ON s.id = e.src JOIN fil f ON f.file_id = s.file_id WHERE e.edge_type = 'call' AND s.language = 'typescript' AND (e.resolution IN ('heuristic', 'unresolved') OR e.confidence < 0.6) ORDER BY e.confidence NULLS FIRST, e.edge_id LIMIT 200"))
def weak_call_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Weak calls of one language with their files, worst first."""
    e = G.edges(spark, root).where("edge_type = 'call' and (resolution in ('heuristic', 'unresolved') or confidence < 0.6)")
    s = G.symbols(spark, root).where("language = 'typescript'").select(F.col("id").alias("src"), "file_id")
    return e.join(s, "src").join(G.files(spark, root).select("file_id", "path"), "file_id").orderBy(F.asc_nulls_first("confidence"), "edge_id").limit(200).select("edge_id", "src", "dst", "path")


@_add("edges_from_symbols", sql("edg sym", "SELECT s.name AS src_name, t.name AS dst_name, e.edge_type, e.confidence FROM edg e JOIN sym s ON s.id = e.src JOIN sym t ON t.id = e.dst WHERE s.kind = 'class'"))
def edges_from_symbols(spark: SparkSession, root: str) -> DataFrame:
    """One hop out: edges of all classes with both names."""
    s = G.symbols(spark, root).select("id", "name", "kind")
    a = s.where("kind = 'class'").select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = s.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return G.edges(spark, root).join(a, "src").join(b, "dst").select("src_name", "dst_name", "edge_type", "confidence")


@_add("edges_into_repo", sql("edg sym", "SELECT t.repo_id, e.edge_type, CAST(count(*) AS BIGINT) AS n FROM edg e JOIN sym t ON t.id = e.dst JOIN sym s ON s.id = e.src AND s.repo_id = t.repo_id GROUP BY ALL"))
def edges_into_repo(spark: SparkSession, root: str) -> DataFrame:
    """One hop in, both ends in one repository."""
    s = G.symbols(spark, root).select("id", "repo_id")
    e = G.edges(spark, root).select("src", "dst", "edge_type")
    both = e.join(s.withColumnRenamed("id", "dst"), "dst").join(s.select(F.col("id").alias("src"), F.col("repo_id").alias("src_repo")), "src").where("repo_id = src_repo")
    return both.groupBy("repo_id", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@_add("slice_edges", sql("edg", "SELECT src, dst, edge_type, max(weight) AS weight FROM edg WHERE (edge_type <> 'call' OR confidence >= 0.7) GROUP BY ALL"))
def slice_edges(spark: SparkSession, root: str) -> DataFrame:
    """Narrow edge projection under a least confidence of calls."""
    return G.edges(spark, root).where(J.min_call_confidence(0.7)).groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))


@_add("bounded_targets", sql("edg sym fil", "SELECT t.id, t.name, f.path FROM t LEFT JOIN fil f USING (file_id)", "t AS (SELECT DISTINCT t.id, t.name, t.file_id FROM edg e JOIN sym s ON s.id = e.src JOIN sym t ON t.id = e.dst WHERE s.kind = 'class' ORDER BY t.name, t.id LIMIT 50)"))
def bounded_targets(spark: SparkSession, root: str) -> DataFrame:
    """The first 50 targets of all classes by name, with their files."""
    s = G.symbols(spark, root).select("id", "name", "file_id", "kind")
    e = G.edges(spark, root).join(s.where("kind = 'class'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return s.drop("kind").join(e, "id", "left_semi").orderBy("name", "id").limit(50).join(G.files(spark, root).select("file_id", "path"), "file_id", "left").select("id", "name", "path")


for _way, _body in {
    "out": "SELECT DISTINCT src AS id, dst AS neighbor FROM edg WHERE src IN (SELECT id FROM k)",
    "in": "SELECT DISTINCT dst AS id, src AS neighbor FROM edg WHERE dst IN (SELECT id FROM k)",
    "both": "SELECT src AS id, dst AS neighbor FROM edg WHERE src IN (SELECT id FROM k) UNION SELECT dst, src FROM edg WHERE dst IN (SELECT id FROM k)",
}.items():

    @_add(f"neighbors_{_way}", sql("edg sym", _body, "k AS (SELECT id FROM sym WHERE kind = 'class')"))
    def neighbors(spark: SparkSession, root: str, way: str = _way) -> DataFrame:
        """Distinct neighbours of all classes."""
        return J.one_hop(G.edges(spark, root), G.symbols(spark, root).where("kind = 'class'").select("id"), way)


@_add("symbols_named", sql("sym fil", "SELECT s.symbol_id, s.name, f.path FROM sym s LEFT JOIN fil f USING (file_id) WHERE s.name = (SELECT min(name) FROM sym)"))
def symbols_named(spark: SparkSession, root: str) -> DataFrame:
    """Exact name with an optional file."""
    s = G.symbols(spark, root)
    return s.join(s.agg(F.min("name").alias("name")), "name", "left_semi").join(G.files(spark, root).select("file_id", "path"), "file_id", "left").select("symbol_id", "name", "path")


@_add("fan_in_out", sql("edg sym", "SELECT s.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM sym s LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edg GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM edg GROUP BY 1) o USING (id)"))
def fan_in_out(spark: SparkSession, root: str) -> DataFrame:
    """Degrees over every edge, 0 where there is none."""
    return J.fan_in_out(G.symbols(spark, root), G.edges(spark, root))


@_add("fan_in_set", sql("edg sym", "SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1", "e AS (SELECT * FROM edg WHERE src IN (SELECT id FROM sym) AND dst IN (SELECT id FROM sym))"))
def fan_in_set(spark: SparkSession, root: str) -> DataFrame:
    """Degrees over edges with both ends in the set; symbols without such edges are absent."""
    e = J.induced_edges(G.edges(spark, root), G.symbols(spark, root))
    both = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


@_add("missing_metrics", sql("sym met", "SELECT id FROM sym WHERE symbol_status = 'real' AND id NOT IN (SELECT id FROM met)"))
def missing_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Real symbols without metrics."""
    return S.missing(G.symbols(spark, root).where("symbol_status = 'real'").select("id"), G.metrics(spark, root), "id")


@_add("repaired_metrics", sql("sym met edg", "SELECT s.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, 0 AS churn30d FROM sym s LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edg GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM edg GROUP BY 1) o USING (id) WHERE s.symbol_status = 'real' AND s.id NOT IN (SELECT id FROM met)"))
def repaired_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics rows for symbols that lack them: degrees and zeros."""
    return J.fan_in_out(missing_metrics(spark, root), G.edges(spark, root)).withColumn("churn30d", F.lit(0))


@_add("callers_of_hot", sql("edg met", "SELECT DISTINCT src AS id FROM edg WHERE edge_type IN ('call', 'import') AND dst IN (SELECT id FROM met WHERE fan_in >= 20)"))
def callers_of_hot(spark: SparkSession, root: str) -> DataFrame:
    """Distinct callers and importers of symbols with a large fan-in."""
    hot = G.metrics(spark, root).where("fan_in >= 20").select(F.col("id").alias("dst"))
    return G.edges(spark, root).where("edge_type in ('call', 'import')").join(hot, "dst", "left_semi").select(F.col("src").alias("id")).distinct()


_CLUSTER = "SELECT e.edge_type, a.file_id AS src_cluster, b.file_id AS dst_cluster FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst WHERE a.file_id IS NOT NULL AND b.file_id IS NOT NULL"


def _cluster_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges between the clusters (files) of their ends."""
    m = G.symbols(spark, root).where("file_id is not null").select("id", "file_id")
    e = G.edges(spark, root).select("src", "dst", "edge_type")
    return e.join(m.select(F.col("id").alias("src"), F.col("file_id").alias("src_cluster")), "src").join(m.select(F.col("id").alias("dst"), F.col("file_id").alias("dst_cluster")), "dst").select("edge_type", "src_cluster", "dst_cluster")


@_add("related_clusters", sql("edg sym", "SELECT src_cluster, dst_cluster, n, pos FROM (SELECT src_cluster, dst_cluster, count(*) AS n, CAST(row_number() OVER (PARTITION BY src_cluster ORDER BY count(*) DESC, dst_cluster) AS INT) AS pos FROM c WHERE src_cluster <> dst_cluster GROUP BY 1, 2) WHERE pos <= 20", f"c AS ({_CLUSTER})"))
def related_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The 20 clusters that each cluster depends on most."""
    n = _cluster_edges(spark, root).where("src_cluster <> dst_cluster").groupBy("src_cluster", "dst_cluster").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("src_cluster").orderBy(F.desc("n"), "dst_cluster")
    return n.withColumn("pos", F.row_number().over(w)).where("pos <= 20")


@_add("cluster_edge_matrix", sql("edg sym", "SELECT src_cluster, dst_cluster, count(*) AS total, count_if(edge_type = 'call') AS calls, count_if(edge_type = 'import') AS imports FROM c GROUP BY 1, 2", f"c AS ({_CLUSTER})"))
def cluster_edge_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Edges between clusters by kind."""
    return _cluster_edges(spark, root).groupBy("src_cluster", "dst_cluster").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("edge_type") == "call").alias("calls"), F.count_if(F.col("edge_type") == "import").alias("imports"))


@_add("intra_cluster_edges", sql("edg sym", "SELECT src, dst, edge_type, confidence FROM (SELECT e.*, row_number() OVER (ORDER BY e.confidence DESC NULLS LAST, e.edge_id) AS pos FROM edg e JOIN sym a ON a.id = e.src JOIN sym b ON b.id = e.dst AND a.file_id = b.file_id WHERE e.confidence >= 0.5 AND e.edge_type IN ('call', 'import')) WHERE pos <= 500"))
def intra_cluster_edges(spark: SparkSession, root: str) -> DataFrame:
    """The 500 surest edges inside clusters."""
    m = G.symbols(spark, root).where("file_id is not null").select("id", "file_id")
    e = G.edges(spark, root).where("confidence >= 0.5 and edge_type in ('call', 'import')")
    j = e.join(m.select(F.col("id").alias("src"), F.col("file_id").alias("fa")), "src").join(m.select(F.col("id").alias("dst"), F.col("file_id").alias("fb")), "dst").where("fa = fb")
    return j.orderBy(F.desc_nulls_last("confidence"), "edge_id").limit(500).select("src", "dst", "edge_type", "confidence")


_STEPS = "steps AS (SELECT l_orderkey AS process_id, l_partkey AS item, min(l_linenumber) AS step FROM lineitem GROUP BY 1, 2)"


def _steps(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as the steps of a process: an item's first line counts."""
    return table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("item")).agg(F.min("l_linenumber").alias("step"))


@_add("steps_after", f"WITH {_STEPS}, s AS (SELECT * FROM steps WHERE item IN (SELECT p_partkey FROM part WHERE p_size = 7)) SELECT s.item AS start, a.item, CAST(min(a.step - s.step) AS INT) AS distance FROM steps a JOIN s ON a.process_id = s.process_id AND a.step > s.step AND a.item <> s.item GROUP BY 1, 2")
def steps_after(spark: SparkSession, root: str) -> DataFrame:
    """Items that come after given items in the same process."""
    starts = table(spark, root, "part").where("p_size = 7").select(F.col("p_partkey").alias("item"))
    return J.later_steps(_steps(spark, root), starts, "process_id", "item", "step")


@_add("process_flow", f"WITH {_STEPS} SELECT process_id, item, CAST(row_number() OVER (PARTITION BY process_id ORDER BY step, item) AS INT) AS pos FROM steps")
def process_flow(spark: SparkSession, root: str) -> DataFrame:
    """Each process as its items in order."""
    w = Window.partitionBy("process_id").orderBy("step", "item")
    return _steps(spark, root).select("process_id", "item", F.row_number().over(w).alias("pos"))


_SPANS = "spans AS (SELECT file_id, symbol_id, range_start_line AS lo, range_end_line AS hi FROM sym WHERE file_id IS NOT NULL AND range_end_line >= range_start_line), probes AS (SELECT DISTINCT f.file_id, c.start_line AS line FROM cal c JOIN fil f ON f.repo_id = c.repo_id AND f.path = split_part(c.caller_node_id, ':', 1))"


def _span_pairs(spark: SparkSession, root: str) -> DataFrame:
    spans = G.symbols(spark, root).where("file_id is not null").select("file_id", "symbol_id", F.col("range_start_line").alias("lo"), F.col("range_end_line").alias("hi"))
    c = G.calls(spark, root).select("repo_id", F.split("caller_node_id", ":")[0].alias("path"), F.col("start_line").alias("line"))
    probes = c.join(G.files(spark, root).select("repo_id", "path", "file_id"), ["repo_id", "path"]).select("file_id", "line").distinct()
    probes = probes.select("file_id", F.col("line").alias("lo"), F.col("line").alias("hi"), F.concat_ws(":", "file_id", "line").alias("probe"))
    return J.overlap_join(spans, probes, "file_id")


@_add("range_overlap", sql("sym fil cal", "SELECT p.file_id, p.line, s.symbol_id, s.hi - s.lo AS width FROM probes p JOIN spans s ON s.file_id = p.file_id AND s.lo <= p.line AND s.hi >= p.line", _SPANS))
def range_overlap(spark: SparkSession, root: str) -> DataFrame:
    """All symbols whose lines contain the line of a call."""
    return _span_pairs(spark, root).select("file_id", F.col("q_lo").alias("line"), F.col("s_symbol_id").alias("symbol_id"), (F.col("s_hi") - F.col("s_lo")).alias("width"))


@_add("containing_symbol", sql("sym fil cal", "SELECT p.file_id, p.line, arg_min(s.symbol_id, struct_pack(w := s.hi - s.lo, i := s.symbol_id)) AS symbol_id FROM probes p JOIN spans s ON s.file_id = p.file_id AND s.lo <= p.line AND s.hi >= p.line GROUP BY 1, 2", _SPANS))
def containing_symbol(spark: SparkSession, root: str) -> DataFrame:
    """The narrowest symbol around the line of a call."""
    return J.narrowest(_span_pairs(spark, root), "q_probe", "s_symbol_id").select("file_id", F.col("q_lo").alias("line"), F.col("s_symbol_id").alias("symbol_id"))


@_add("overlay_rows", "WITH o AS (SELECT o_orderkey, 'draft' AS layer, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 7 = 0) SELECT * FROM o UNION ALL SELECT o_orderkey, 'durable', o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def overlay_rows(spark: SparkSession, root: str) -> DataFrame:
    """Draft rows over durable ones."""
    o = table(spark, root, "orders")
    draft = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("draft").alias("layer"), (F.col("o_totalprice") * 2).alias("price"))
    return J.overlay_rows(o.select("o_orderkey", F.lit("durable").alias("layer"), F.col("o_totalprice").alias("price")), draft, "o_orderkey")


@_add("overlay_edges", sql("edg sym", "SELECT src, dst, edge_type, 'draft' AS layer FROM edg WHERE src IN (SELECT id FROM t) AND edge_type = 'import' UNION ALL SELECT src, dst, edge_type, 'durable' FROM edg WHERE src NOT IN (SELECT id FROM t)", "t AS (SELECT id FROM sym WHERE kind = 'class')"))
def overlay_edges(spark: SparkSession, root: str) -> DataFrame:
    """Draft edges hide durable ones of a touched symbol, even where the draft has none."""
    e = G.edges(spark, root).select("src", "dst", "edge_type")
    touched = G.symbols(spark, root).where("kind = 'class'").select(F.col("id").alias("src"))
    draft = e.where("edge_type = 'import'").join(touched, "src", "left_semi").withColumn("layer", F.lit("draft"))
    return J.overlay_edges(e.withColumn("layer", F.lit("durable")), draft, touched)


@_add("slice_induced_edges", sql("edg sym", "SELECT src, dst, edge_type, max(c) AS confidence, max_by(w, c * 1000 + w) AS weight FROM (SELECT src, dst, edge_type, coalesce(confidence, 0) AS c, coalesce(weight, 0) AS w FROM edg WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) AND edge_type <> 'implements') GROUP BY 1, 2, 3", "k AS (SELECT id FROM sym WHERE kind IN ('class', 'function'))"))
def slice_induced_edges(spark: SparkSession, root: str) -> DataFrame:
    """Best edges between the symbols of a slice."""
    ids = G.symbols(spark, root).where("kind in ('class', 'function')").select("id")
    return J.best_edges(J.induced_edges(G.edges(spark, root).where("edge_type <> 'implements'"), ids))


@_add("confidence_histogram", sql("edg", "SELECT edge_type, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM edg WHERE edge_type IN ('call', 'import', 'config') GROUP BY ALL"))
def confidence_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Edges by kind and confidence, before any filter on their ends."""
    c = F.col("confidence")
    bucket = F.when(c.isNull(), "none").when(c >= 0.9, "high").when(c >= 0.6, "medium").otherwise("low")
    return G.edges(spark, root).where("edge_type in ('call', 'import', 'config')").groupBy("edge_type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_add("edge_dictionary", sql("edg sym", "SELECT a.at AS from_index, b.at AS to_index, e.edge_type FROM edg e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst", "d AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM (SELECT DISTINCT id FROM sym))"))
def edge_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """Edges with ids encoded by their place in order."""
    return J.encode_ids(G.edges(spark, root), G.symbols(spark, root)).select("from_index", "to_index", "edge_type")


@_add("edge_actions", sql("edg cal", "SELECT c.call_id, CASE WHEN c.callee_symbol_id IS NULL THEN 'skip' WHEN e.n IS NULL THEN 'create' WHEN e.exact THEN 'skip' WHEN e.unresolved THEN 'replace' ELSE 'upgrade' END AS action FROM cal c LEFT JOIN (SELECT dst, count(*) AS n, bool_or(coalesce(resolution = 'exact', false)) AS exact, bool_and(coalesce(resolution = 'unresolved', false)) AS unresolved FROM edg GROUP BY 1) e ON e.dst = lower(trim(c.callee_symbol_id))"))
def edge_actions(spark: SparkSession, root: str) -> DataFrame:
    """What a resolved call does to the edges of its target: create, upgrade, replace or skip."""
    same = lambda v: F.coalesce(F.col("resolution") == v, F.lit(False))
    e = G.edges(spark, root).groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.bool_or(same("exact")).alias("exact"), F.bool_and(same("unresolved")).alias("unresolved"))
    c = G.calls(spark, root).select("call_id", "callee_symbol_id", F.lower(F.trim("callee_symbol_id")).alias("dst"))
    action = F.when(F.col("callee_symbol_id").isNull(), "skip").when(F.col("n").isNull(), "create").when(F.col("exact"), "skip").when(F.col("unresolved"), "replace").otherwise("upgrade")
    return c.join(e, "dst", "left").select("call_id", action.alias("action"))


@_add("symbol_cards", sql("sym fil met edg", "SELECT s.symbol_id, s.name, f.path, m.fan_in, m.fan_out, coalesce(d.deps, '') AS deps FROM sym s LEFT JOIN fil f USING (file_id) LEFT JOIN met m USING (id) LEFT JOIN (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) FILTER (WHERE pos <= 10) AS deps FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM (SELECT DISTINCT src, dst FROM edg WHERE edge_type = 'call')) GROUP BY 1) d USING (id) WHERE s.symbol_status = 'real'"))
def symbol_cards(spark: SparkSession, root: str) -> DataFrame:
    """Symbol, file, metrics and the first ten callees in one row."""
    w = Window.partitionBy("src").orderBy("dst")
    d = G.edges(spark, root).where("edge_type = 'call'").select("src", "dst").distinct().withColumn("at", F.row_number().over(w)).where("at <= 10")
    d = d.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("deps"))
    s = G.symbols(spark, root).where("symbol_status = 'real'").select("id", "symbol_id", "name", "file_id")
    return s.join(G.files(spark, root).select("file_id", "path"), "file_id", "left").join(G.metrics(spark, root).select("id", "fan_in", "fan_out"), "id", "left").join(d, "id", "left").select("symbol_id", "name", "path", "fan_in", "fan_out", F.coalesce("deps", F.lit("")).alias("deps"))


@_add("references_to_top", sql("edg sym fil met", "SELECT e.src, f.path, e.confidence FROM edg e JOIN sym s ON s.id = e.src LEFT JOIN fil f USING (file_id) WHERE e.confidence >= 0.8 AND e.dst = (SELECT id FROM met ORDER BY fan_in DESC, id LIMIT 1) ORDER BY e.confidence DESC, e.edge_id LIMIT 1000"))
def references_to_top(spark: SparkSession, root: str) -> DataFrame:
    """Who refers to the symbol with the largest fan-in, surest first."""
    top = G.metrics(spark, root).orderBy(F.desc("fan_in"), "id").limit(1).select(F.col("id").alias("dst"))
    e = G.edges(spark, root).where("confidence >= 0.8").join(F.broadcast(top), "dst", "left_semi")
    s = G.symbols(spark, root).select(F.col("id").alias("src"), "file_id").join(G.files(spark, root).select("file_id", "path"), "file_id", "left")
    return e.join(s, "src").orderBy(F.desc("confidence"), "edge_id").limit(1000).select("src", "path", "confidence")


@_add("test_references", sql("met", "SELECT lower(symbol_id) AS id, ref FROM (SELECT symbol_id, unnest(from_json(test_refs_json, '[\"VARCHAR\"]')) AS ref FROM (SELECT * FROM symbol_metrics QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY updated_at DESC NULLS LAST) = 1) WHERE test_refs_json IS NOT NULL) GROUP BY 1, 2"))
def test_references(spark: SparkSession, root: str) -> DataFrame:
    """Distinct test files that refer to each symbol, from a JSON array."""
    m = G.latest(table(spark, root, "symbol_metrics"), ["symbol_id"], "updated_at")
    return m.select(F.lower("symbol_id").alias("id"), F.explode(F.from_json("test_refs_json", "array<string>")).alias("ref")).distinct()


@_add("resolved_callees", sql("sym cal", "SELECT call_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 OR strict = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM cal LEFT JOIN (SELECT c.call_id, count(*) AS n, count_if(s.repo_id = c.repo_id) AS strict FROM cal c JOIN sym s ON s.name = c.callee_identifier AND s.symbol_status = 'real' GROUP BY 1) USING (call_id)"))
def resolved_callees(spark: SparkSession, root: str) -> DataFrame:
    """Names of callees resolved to symbols: the only match, or the only one of the same repository."""
    c, s = G.calls(spark, root), G.symbols(spark, root).where("symbol_status = 'real'")
    cand = c.select(F.col("call_id").alias("ref_id"), F.col("callee_identifier").alias("name"), F.col("repo_id").alias("r")).join(s.select("name", "id", "repo_id"), "name")
    cand = cand.select("ref_id", "id", (F.col("r") == F.col("repo_id")).alias("strict"), F.lit(0.0).alias("score"))
    return J.resolve_refs(c.select(F.col("call_id").alias("ref_id")), cand).select(F.col("ref_id").alias("call_id"), "status")


@_add("affected_set", sql("edg sym", "SELECT id FROM k UNION SELECT src FROM edg WHERE dst IN (SELECT id FROM k) UNION SELECT dst FROM edg WHERE src IN (SELECT id FROM k)", "k AS (SELECT id FROM sym WHERE kind = 'class')"))
def affected_set(spark: SparkSession, root: str) -> DataFrame:
    """Changed symbols and their direct neighbours either way."""
    k = G.symbols(spark, root).where("kind = 'class'").select("id")
    return k.unionByName(J.one_hop(G.edges(spark, root), k, "both").select(F.col("neighbor").alias("id"))).distinct()


@_add("dependency_frontier", sql("edg sym", "SELECT id FROM k UNION SELECT src FROM edg WHERE edge_type IN ('call', 'import') AND dst IN (SELECT id FROM k)", "k AS (SELECT id FROM sym WHERE kind = 'interface')"))
def dependency_frontier(spark: SparkSession, root: str) -> DataFrame:
    """Touched symbols with their callers and importers."""
    k = G.symbols(spark, root).where("kind = 'interface'").select("id")
    e = G.edges(spark, root).where("edge_type in ('call', 'import')")
    return k.unionByName(J.one_hop(e, k, "in").select(F.col("neighbor").alias("id"))).distinct()


@_add("ordered_union", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def ordered_union(spark: SparkSession, root: str) -> DataFrame:
    """Two ordered id lists as one, those of the first before new ones of the second."""
    a = table(spark, root, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("pos"))
    b = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"))
    return S.merge_ordered(a, b, "k", "pos")


@_add("diagnostics_first", sql("edg cal", "SELECT id, 'diagnostic' AS source FROM d UNION ALL SELECT DISTINCT src, 'graph' FROM edg WHERE edge_type = 'call' AND src NOT IN (SELECT id FROM d)", "d AS (SELECT DISTINCT lower(trim(callee_symbol_id)) AS id FROM cal WHERE NOT is_resolved AND trim(callee_symbol_id) <> '')"))
def diagnostics_first(spark: SparkSession, root: str) -> DataFrame:
    """Diagnostic suspects, then what the graph adds."""
    d = G.calls(spark, root).where("not is_resolved and trim(callee_symbol_id) <> ''").select(F.lower(F.trim("callee_symbol_id")).alias("id")).distinct().withColumn("source", F.lit("diagnostic"))
    g = G.edges(spark, root).where("edge_type = 'call'").select(F.col("src").alias("id")).distinct().withColumn("source", F.lit("graph"))
    return S.without_suspects(d, g, "id")


@_add("orphan_placeholders", sql("sym edg", "SELECT id FROM sym WHERE file_id IS NULL AND id NOT IN (SELECT src FROM edg) AND id NOT IN (SELECT dst FROM edg)"))
def orphan_placeholders(spark: SparkSession, root: str) -> DataFrame:
    """Symbols without a file and without any edge."""
    e = G.edges(spark, root)
    p = G.symbols(spark, root).where("file_id is null").select("id")
    return p.join(e.select(F.col("src").alias("id")), "id", "left_anti").join(e.select(F.col("dst").alias("id")), "id", "left_anti")
