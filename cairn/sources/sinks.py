"""Writes on plain parquet tables: upserts, edge rules, deletes, snapshots and swaps.

Every function gives the new state as a DataFrame; ``publish`` writes it beside the old one
and swaps, so readers see one or the other and a failed write changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new``, and rows of ``old`` whose key it has not.

    Of several new rows of a key the one with the greatest ``order`` counts; without an order
    the key has to be unique in ``new``. Columns of one side only are null on the other.
    """
    if order is not None:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*new.columns)
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it has not."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge for each (src, dst, edge_type): an exact old one stays unless the new one is surer.

    A refreshed edge keeps its old created_at. Of several new edges of a key the surest counts,
    then the latest.
    """
    keys = ["src", "dst", "edge_type"]
    one = new.groupBy(*keys).agg(F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), "created_at", "confidence", "weight", "resolution")).alias("n"))
    both = old.join(one, keys, "full_outer")
    fresh = F.col("n").isNotNull() & (F.col("created_at").isNull() | (F.coalesce("resolution", F.lit("")) != "exact") | (F.coalesce("confidence", F.lit(-1.0)) < F.col("n.c")))
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, pick("weight"), pick("confidence"), pick("resolution"), F.coalesce("created_at", F.col("n.created_at")).alias("created_at"))


def retarget(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges whose target is replaced where ``moves`` (dst, new_dst) has it; the best of equal ones stays."""
    m = edges.join(moves.groupBy("dst").agg(F.min("new_dst").alias("new_dst")), "dst", "left").withColumn("dst", F.coalesce("new_dst", "dst")).drop("new_dst")
    keys = ["src", "dst", "edge_type"]
    rest = [c for c in m.columns if c not in keys]
    return m.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("confidence", F.lit(-1.0)), *rest)).alias("r")).select(*keys, "r.*")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Every table without rows that name a deleted ``id`` in one of its columns."""
    ids = gone.select("id").distinct()
    out = {}
    for name, df in tables.items():
        for c in columns.get(name, []):
            df = df.join(ids.withColumnRenamed("id", c), c, "left_anti")
        out[name] = df
    return out


def expire(df: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that have not expired; a null time never expires."""
    return df.where(F.col(expires).isNull() | (F.col(expires) >= now))


def with_blob_key(df: DataFrame, payload: str, key: str = "digest") -> DataFrame:
    """Content-addressed rows: sha256 of the payload as key, equal payloads once; null has none."""
    return df.where(F.col(payload).isNotNull()).withColumn(key, F.sha2(payload, 256)).dropDuplicates([key])


def append_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Append under partition folders, such as one for each version."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only those partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by its join keys, so that later joins on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], path: str, checks: dict[str, Column] | None = None) -> str:
    """Write all tables into a new version folder, audit them, then point ``current.json`` at it.

    ``checks``: for a table a condition that every row has to satisfy; a failure removes the
    new version and raises, and the old one stays current.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    home = f"{path}/{version}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{home}/{name}")
            test = (checks or {}).get(name)
            if test is not None and not spark.read.parquet(f"{home}/{name}").where(~F.coalesce(test, F.lit(False))).isEmpty():
                raise ValueError(f"table {name} fails its check")
    except BaseException:
        p, fs = _fs(spark, home)
        fs.delete(p, True)
        raise
    p, fs = _fs(spark, f"{path}/next-{version}.json")
    stream = fs.create(p)
    stream.write(bytearray(json.dumps({"version": version, "schema": 1}).encode()))
    stream.close()
    target, _ = _fs(spark, f"{path}/current.json")
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(p, target)
    return version


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that is current."""
    text = spark.read.text(f"{path}/current.json", wholetext=True).first()[0]
    return spark.read.parquet(f"{path}/{json.loads(text)['version']}/{name}")


def migrate(df: DataFrame, version: int, steps: dict[int, list[tuple[str, str]]]) -> tuple[DataFrame, int]:
    """Apply the schema steps after ``version`` in order; a step lists (column, SQL expression), and may run twice."""
    for v in sorted(steps):
        if v > version:
            for column, expression in steps[v]:
                if column not in df.columns:
                    df = df.withColumn(column, F.expr(expression))
            version = v
    return df, version
