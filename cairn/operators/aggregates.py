"""Aggregations with definitions of their own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def floor_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """Percentiles by floor index: the value at place floor(p * n) of the sorted values.

    Values are counted before they are ordered, so a group of many equal values costs one row
    a value; the order within a group is a running sum over distinct values. Nulls and NaN are
    left out. Result: keys, p, value.
    """
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).count()
    w = Window.partitionBy(*keys)
    ranked = v.withColumn("_to", F.sum("count").over(w.orderBy(value))).withColumn("_n", F.sum("count").over(w))
    at = ranked.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_at", F.least(F.floor(F.col("p") * F.col("_n")), F.col("_n") - 1))
    return at.where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("count"))).select(*keys, "p", F.col(value).alias("value"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, at: str = "pos") -> DataFrame:
    """The first n rows of each group with their place; ``order`` has to be total."""
    return df.withColumn(at, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(at) <= n)


def ordered_digest(df: DataFrame, group: str, key: str, value: str, before: str) -> DataFrame:
    """``group`` and ``digest``: sha256 over the values in key order joined by ``|``, chained to ``before`` (null: ``none``).

    The digest is sequential by definition; a group's rows come sorted and are hashed as they
    stream by, so its size is not bounded by memory. Null values count as empty text.
    """
    kind = dict(df.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h, done = None, None, []
        for b in batches:
            for g, prev, v in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if h is None or g != name:
                    if h is not None:
                        done.append((name, h.hexdigest()))
                    name, h, sep = g, hashlib.sha256(f"{prev or 'none'}:".encode()), b""
                h.update(sep + (v or "").encode())
                sep = b"|"
        if h is not None:
            done.append((name, h.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done)], names=[group, "digest"])

    rows = df.where(F.col(group).isNotNull()).select(group, key, before, F.col(value).cast("string").alias("_v"))
    return rows.repartition(group).sortWithinPartitions(group, key).mapInArrow(run, f"`{group}` {kind}, digest string")


def smoothed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles by interpolation, population deviation, and how many values lie outside 1.5 quartile ranges."""
    s = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.stddev_pop(value).alias("sd"))
    s = s.select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "sd")
    out = (F.col(value) < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col(value) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return df.join(s, keys).groupBy(*keys, "q1", "median", "q3", "sd").agg(F.count_if(out).alias("outliers"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's 1-based place in the order, which has to be total.

    Rows are range-partitioned, counted by partition and numbered within it, so the order of a
    large table is not made in one task.
    """
    # Written once: the bounds of a range partitioning are sampled, so a second run may cut elsewhere.
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    d = d.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = d.groupBy("_p").count().withColumn("_base", F.coalesce(before, F.lit(0))).select("_p", "_base")
    return d.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_i") + 1).drop("_m", "_p", "_i", "_base")
