"""The code index as clean tables: one row a symbol, edge, file, call or run.

``SQL`` holds the same tables as common table expressions for the check in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import fold_key
from .tables import table


def latest(df: DataFrame, keys: list[str], by: str, *ties: str) -> DataFrame:
    """Of each key the row with the greatest ``by`` (null is least), then the greatest ties.

    A ranking of which only the first place is asked: each partition keeps one row a key before
    the shuffle, and columns that nobody reads are not scanned. Null keys give no row.
    """
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in (by, *ties)))
    full = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return full.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def norm_path(c: Column) -> Column:
    """One spelling of a path: forward slashes, no ``./`` in front, no doubled slash."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "/+", "/"), r"^(\./)+", "")


def symbols(spark: SparkSession, root: str) -> DataFrame:
    """State of each symbol under its folded ``id``."""
    return latest(table(spark, root, "symbols"), ["symbol_id"], "updated_at").withColumn("id", fold_key(F.col("symbol_id")))


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Each dependency once: edge_id, src, dst, edge_type, weight, confidence, resolution, created_at."""
    e = table(spark, root, "depends_on").select("edge_id", fold_key(F.col("from_symbol_id")).alias("src"), fold_key(F.col("to_symbol_id")).alias("dst"), "edge_type", "weight", "confidence", fold_key(F.col("resolution")).alias("resolution"), "created_at")
    return e.dropDuplicates(["edge_id"]).where("src <> '' and dst <> ''")


def files(spark: SparkSession, root: str) -> DataFrame:
    """Each file once, as indexed last, with its path in one spelling."""
    f = table(spark, root, "source_files").withColumn("path", norm_path(F.col("rel_path"))).select("file_id", "repo_id", "path", "content_hash", "language", "byte_size", "last_indexed_at", "head_text")
    return latest(f, ["file_id"], "last_indexed_at", "path", "content_hash")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """Latest metrics of each symbol under its folded ``id``; NaN and null count as 0."""
    m = latest(table(spark, root, "symbol_metrics").select("symbol_id", "fan_in", "fan_out", "churn30d", "page_rank", "k_core", "updated_at"), ["symbol_id"], "updated_at", "fan_in", "page_rank", "churn30d", "fan_out", "k_core")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "churn30d", "k_core")}
    return m.select(fold_key(F.col("symbol_id")).alias("id"), *zero.values(), F.when(F.col("page_rank").isNull() | F.isnan("page_rank"), 0.0).otherwise(F.col("page_rank")).alias("page_rank"))


def calls(spark: SparkSession, root: str) -> DataFrame:
    """Each expected call once."""
    return table(spark, root, "expected_calls").drop("loaded_at").dropDuplicates(["call_id"])


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Each session record once, variant and category folded, non-measurements null."""
    r = table(spark, root, "session_records").drop("loaded_at").dropDuplicates(["run_id"])
    save = F.col("tokens.savings_percent")
    return r.select("run_id", "session_id", "ts", "agent", fold_key(F.translate("variant", "_", "-")).alias("variant"), fold_key(F.col("category")).alias("category"), "task_id", "repo_id", "status", F.when(F.col("duration_ms") > 0, F.col("duration_ms")).alias("duration_ms"), "wall_ms", F.col("tokens.input_count").alias("input_count"), F.col("tokens.output_count").alias("output_count"), F.col("tokens.total").alias("total"), F.col("tokens.saved").alias("saved"), F.when(~F.isnan(save), save).alias("savings_percent"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The latest delivery of each symbol in each snapshot."""
    v = table(spark, root, "symbol_versions").select("version_id", "symbol_id", "ast_fingerprint", "signature_json", "summary", "ingested_at", "row_id")
    return latest(v, ["version_id", "symbol_id"], "ingested_at", "row_id")


_F = "lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_DASHED = "translate(variant, '_', '-')"
SQL = {
    "sym": f"SELECT *, {_F.format('symbol_id')} AS id FROM symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY updated_at DESC NULLS LAST) = 1",
    "edg": f"SELECT * FROM (SELECT DISTINCT ON (edge_id) edge_id, {_F.format('from_symbol_id')} AS src, {_F.format('to_symbol_id')} AS dst, edge_type, weight, confidence, {_F.format('resolution')} AS resolution, created_at FROM depends_on) WHERE src <> '' AND dst <> ''",
    "fil": "SELECT file_id, repo_id, path, content_hash, language, byte_size, last_indexed_at, head_text FROM (SELECT *, regexp_replace(regexp_replace(translate(trim(rel_path), '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') AS path FROM source_files WHERE file_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY last_indexed_at DESC NULLS LAST, path DESC NULLS LAST, content_hash DESC NULLS LAST) = 1",
    "met": f"SELECT {_F.format('symbol_id')} AS id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(churn30d, 0) AS churn30d, coalesce(k_core, 0) AS k_core, CASE WHEN page_rank IS NULL OR isnan(page_rank) THEN 0 ELSE page_rank END AS page_rank FROM (SELECT * FROM symbol_metrics WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY updated_at DESC NULLS LAST, fan_in DESC NULLS LAST, page_rank DESC NULLS LAST, churn30d DESC NULLS LAST, fan_out DESC NULLS LAST, k_core DESC NULLS LAST) = 1)",
    "cal": "SELECT DISTINCT ON (call_id) * EXCLUDE (loaded_at) FROM expected_calls",
    "run": f"SELECT run_id, session_id, ts, agent, {_F.format(_DASHED)} AS variant, {_F.format('category')} AS category, task_id, repo_id, status, CASE WHEN duration_ms > 0 THEN duration_ms END AS duration_ms, wall_ms, tokens.input_count AS input_count, tokens.output_count AS output_count, tokens.total AS total, tokens.saved AS saved, CASE WHEN NOT isnan(tokens.savings_percent) THEN tokens.savings_percent END AS savings_percent FROM (SELECT DISTINCT ON (run_id) * FROM session_records)",
    "ver": "SELECT version_id, symbol_id, ast_fingerprint, signature_json, summary, ingested_at, row_id FROM symbol_versions WHERE version_id IS NOT NULL AND symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY version_id, symbol_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1",
}


def with_tables(names: str, body: str, more: str = "") -> str:
    """``body`` with the named clean tables (and further expressions) in front."""
    ctes = [f"{n} AS ({SQL[n]})" for n in names.split()] + ([more] if more else [])
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
