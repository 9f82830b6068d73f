"""Queries on references and snapshots of the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import fold_key
from ..operators.orphans import find_orphans
from ..operators.snapshot_diff import snapshot_changes
from ..sources.tables import table
from .registry import Registry

registry = Registry()


def _references(spark: SparkSession, root: str) -> DataFrame:
    """Edges and calls that claim a target, under their folded keys."""
    edges = table(spark, root, "depends_on").where(F.coalesce(fold_key(F.col("resolution")), F.lit("")) != "unresolved")
    calls = table(spark, root, "expected_calls").where(F.col("is_resolved"))
    one = lambda df, name, rid, key, ts: df.select(F.lit(name).alias("ref_table"), F.col(rid).alias("ref_id"), fold_key(F.col(key)).alias("key"), F.col(ts).alias("ref_ts"))
    refs = one(edges, "depends_on", "edge_id", "to_symbol_id", "created_at").unionByName(one(calls, "expected_calls", "call_id", "callee_symbol_id", "recorded_at"))
    return refs.where(F.col("key") != "")


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    parents = table(spark, root, "symbols").select(fold_key(F.col("symbol_id")).alias("key"), F.col("updated_at").alias("version_ts"), F.col("indexed_at").alias("since"), F.col("deleted_at").isNotNull().alias("gone"))
    return find_orphans(_references(spark, root), parents).withColumn("ref_month", F.coalesce(F.date_format("ref_ts", "yyyy-MM"), F.lit("unknown")))


_FOLD = "lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_ORPHANS = f"""
WITH s AS (
  SELECT {_FOLD.format('symbol_id')} AS key, arg_max(deleted_at IS NOT NULL, updated_at) AS gone, arg_max(indexed_at, updated_at) AS since
  FROM symbols GROUP BY 1),
r AS (
  SELECT 'depends_on' AS ref_table, edge_id AS ref_id, {_FOLD.format('to_symbol_id')} AS key, created_at AS ts
  FROM depends_on WHERE coalesce({_FOLD.format('resolution')}, '') <> 'unresolved'
  UNION ALL
  SELECT 'expected_calls', call_id, {_FOLD.format('callee_symbol_id')}, recorded_at FROM expected_calls WHERE is_resolved),
o AS (
  SELECT DISTINCT ref_table, ref_id, coalesce(strftime(ts, '%Y-%m'), 'unknown') AS ref_month,
    CASE WHEN s.key IS NULL THEN 'missing' WHEN s.gone THEN 'deleted' ELSE 'later' END AS reason
  FROM r LEFT JOIN s ON r.key = s.key
  WHERE r.key <> '' AND (s.key IS NULL OR s.gone OR s.since > r.ts))
"""


@registry.add("p1_found", _ORPHANS + "SELECT ref_table, ref_id, ref_month FROM o")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """References without a target, each once."""
    return _orphans(spark, root).select("ref_table", "ref_id", "ref_month").distinct()


@registry.add("p1_report", _ORPHANS + "SELECT ref_table, ref_month, reason, CAST(count(*) AS BIGINT) AS orphans FROM o GROUP BY ALL")
def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans by table, month and reason."""
    misses = _orphans(spark, root).select("ref_table", "ref_id", "ref_month", "reason").distinct()
    return misses.groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("orphans"))


#: Signatures by the fields that they have in these tables; the operator itself compares whole JSON values.
_SIGNATURE = "CASE WHEN json_valid(signature_json) THEN json_object('n', json_extract_string(signature_json, '$.name'), 'r', json_extract_string(signature_json, '$.returns'), 'p', list_zip(json_extract_string(signature_json, '$.params[*].name'), json_extract_string(signature_json, '$.params[*].type')))::VARCHAR ELSE signature_json END"
_CHANGES = f"""
WITH v AS (
  SELECT version_id, symbol_id, lower(ast_fingerprint) AS f, {_SIGNATURE} AS g FROM symbol_versions WHERE symbol_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY version_id, symbol_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1),
c AS (
  SELECT version_id, lag(version_id) OVER (PARTITION BY repo_id ORDER BY created_at, version_id) AS before
  FROM versions WHERE repo_id IS NOT NULL AND version_id IN (SELECT version_id FROM symbol_versions)),
n AS (SELECT c.version_id, symbol_id, f, g FROM c JOIN v USING (version_id) WHERE before IS NOT NULL),
o AS (SELECT c.version_id, symbol_id, f, g FROM c JOIN v ON v.version_id = before),
d AS (
  SELECT coalesce(n.version_id, o.version_id) AS version_id, coalesce(n.symbol_id, o.symbol_id) AS symbol_id,
    CASE WHEN o.version_id IS NULL THEN 'added' WHEN n.version_id IS NULL THEN 'removed'
      WHEN n.f IS DISTINCT FROM o.f OR n.g IS DISTINCT FROM o.g THEN 'modified' END AS change_type
  FROM n FULL JOIN o ON n.version_id = o.version_id AND n.symbol_id = o.symbol_id)
"""


@registry.add("p5_found", _CHANGES + "SELECT * FROM d WHERE change_type IS NOT NULL")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Changes of each snapshot against the one before it in its repository."""
    return snapshot_changes(table(spark, root, "versions"), table(spark, root, "symbol_versions"))


@registry.add("p5_report", _CHANGES + "SELECT version_id, change_type, count(*) AS changes FROM d WHERE change_type IS NOT NULL GROUP BY 1, 2")
def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Number of changes by snapshot and kind."""
    return p5_found(spark, root).groupBy("version_id", "change_type").agg(F.count(F.lit(1)).alias("changes"))
