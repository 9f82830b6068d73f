"""Ordered folds, count-based windows, sessions and transitions over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import numbered


def ewma(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.5, block: int = 1000) -> DataFrame:
    """key, n and ewma: the first value is the seed, each next one moves it by ``alpha``.

    Folded in blocks: each block of ``block`` values of a key gives a pair (factor, sum) that
    says how it changes any state, and the pairs combine in order. Places come from a range
    partitioning by key and order, so a hot key is neither sorted nor folded in one task; only
    its pairs, one for a block, meet. ``order`` has to be total within a key. Null values and
    keys are left out.
    """
    v = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, *order, F.col(value).cast("double").alias("_v"))
    placed = numbered(v, [key, *order], "_at")
    rows = placed.join(placed.groupBy(key).agg(F.min("_at").alias("_first")), key).select(key, (F.col("_at") - F.col("_first") + 1).alias("_n"), "_v")
    rows = rows.withColumn("_b", F.floor((F.col("_n") - 1) / block))
    # Within a block a value of place i weighs alpha * (1 - alpha) ** (size - i); the seed has weight 1 instead of alpha.
    sized = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(key, "_b"))).withColumn("_i", F.col("_n") - F.col("_b") * block)
    weight = F.when(F.col("_n") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), (F.col("_size") - F.col("_i")).cast("double"))
    part = sized.groupBy(key, "_b").agg(F.sum(weight * F.col("_v")).alias("_sum"), F.first("_size").alias("_k"))
    later = F.coalesce(F.sum("_k").over(Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = part.withColumn("_later", later)
    return out.groupBy(key).agg(F.sum("_k").alias("n"), F.sum(F.col("_sum") * F.pow(F.lit(1 - alpha), F.col("_later").cast("double"))).alias("ewma"))


def last_n(order: list, n: int, by: list[str] | None = None):
    """The window of a row and the n - 1 before it."""
    return Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-(n - 1), 0)


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: float, payload: Column, tie: str) -> DataFrame:
    """key, start, end, n and last payload of runs of events whose gaps are below ``gap_seconds``.

    This is a debounce: each event restarts the key's timer and the last payload fires. Null
    times belong to no session.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    d = df.where(F.col(ts).isNotNull()).withColumn("_t", seconds)
    d = d.withColumn("_new", F.when(F.col("_t") - F.lag("_t").over(w) < gap_seconds, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(w))
    return d.groupBy(key, "_s").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), F.max_by(payload, F.struct(ts, tie)).alias("last")).drop("_s")


def transitions(df: DataFrame, key: list[str], order: list[str], item: str, least: int, confidence: float) -> DataFrame:
    """a, b, next, n and total of the most frequent follower of each pair of items, if seen often and surely enough."""
    w = Window.partitionBy(*key).orderBy(*order)
    t = df.select(*key, *order, F.col(item).alias("a")).withColumn("b", F.lead("a", 1).over(w)).withColumn("next", F.lead("a", 2).over(w)).where("next is not null")
    c = t.groupBy("a", "b", "next").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("a", "b").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "next")).alias("x")).select("a", "b", F.col("x.next").alias("next"), (-F.col("x.m")).alias("n"), "total")
    return best.where((F.col("total") >= least) & (F.col("n") / F.col("total") >= confidence))


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """State after version-gated updates in any order: of each key the row with the greatest version.

    An update with a version at or below the current one changes nothing, so of equal versions
    one has to be the first: the caller's ``df`` holds each (key, version) once.
    """
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def first_seen(df: DataFrame, key: list[str], content: Column, order: list[str]) -> DataFrame:
    """``df`` with ``unchanged``: whether the same content came before under the same key."""
    digest = F.sha2(F.coalesce(content, F.lit("")), 256)
    w = Window.partitionBy(*key, "_d").orderBy(*order)
    return df.withColumn("_d", digest).withColumn("unchanged", F.row_number().over(w) > 1).drop("_d")
