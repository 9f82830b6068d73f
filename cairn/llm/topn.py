"""Top N items within every group.

Each partition sorts its items by group and order and keeps the first N of every group. The
last of these, the partition's N-th best, is a lower bound of the group's N-th best, so the
best of a group's bounds over all partitions is a bound too. The bounds are joined, rows worse
than their group's bound go, and the survivors are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut


def local_firsts(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each group in each partition, with their place ``pos`` from 0.

    ``items``: grp, a, b, tie. The partition is sorted outside Python, where it may spill, and
    streamed: one batch of rows is held, whatever the number of groups or their size.
    """
    schema = items.select("grp", "a", "b", "tie").schema.add("pos", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp")
            starts = np.flatnonzero(pc.not_equal(grp.slice(1), grp.slice(0, len(grp) - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], starts])
            sizes = np.diff(np.append(starts, len(grp)))
            pos = np.arange(len(grp)) - np.repeat(starts, sizes)
            if grp[0].as_py() == last:  # the batch goes on with the group of the last one
                pos[: sizes[0]] += seen
            last, seen = grp[-1].as_py(), int(pos[-1]) + 1
            keep = pos < n
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(keep)).columns, pa.array(pos[keep].astype(np.int32))], names=[*batch.schema.names, "pos"])

    return items.select("grp", "a", "b", "tie").sortWithinPartitions("grp", F.desc("a"), F.desc("b"), F.asc_nulls_last("tie")).mapInArrow(run, schema)


def top_n(items: DataFrame, group: str, score: str, second: str, tie: str, n: int) -> DataFrame:
    """The first ``n`` rows of each ``group`` by score and second descending, then tie ascending.

    Result: the four columns and ``rank`` (1..n). Null and NaN score and null second count as
    0; rows with a null group belong to no group; a null tie is last. Rows that agree in all
    columns are told apart by nothing: each takes a rank of its own. Fewer than n rows give all
    of them, an empty table an empty result; other columns are dropped before anything moves.

    At most n rows of a group leave a partition, so a hot group is small before it is shuffled.
    Its partitions' firsts are written once and read twice: for the bounds, one row a group
    combined before their shuffle, and for the join with them.
    """
    clean = items.where(F.col(group).isNotNull()).select(
        F.col(group).alias("grp"),
        F.when(F.col(score).isNull() | F.isnan(F.col(score).cast("double")), 0.0).otherwise(F.col(score).cast("double")).alias("a"),
        F.coalesce(F.col(second).cast("bigint"), F.lit(0)).alias("b"),
        F.col(tie).alias("tie"),
    )
    firsts = cut(local_firsts(clean, n))
    # The best bound is the highest a, then the highest b, then the lowest tie, a null one last.
    key = F.struct((-F.col("a")).alias("a"), F.bitwise_not("b").alias("b"), F.col("tie").isNull().alias("none"), F.col("tie").alias("tie"))
    best = firsts.where(F.col("pos") == n - 1).groupBy("grp").agg(F.min(key).alias("bound"))
    w = Window.partitionBy("grp").orderBy(F.desc("a"), F.desc("b"), F.asc_nulls_last("tie"))
    left = firsts.join(best, "grp", "left").where(F.col("bound").isNull() | (key <= F.col("bound"))).select("grp", "a", "b", "tie")
    ranked = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select(F.col("grp").alias(group), F.col("a").alias(score), F.col("b").alias(second), F.col("tie").alias(tie), "rank")


def symbol_scores(symbols: DataFrame, metrics: DataFrame) -> DataFrame:
    """file_id, symbol_id, page_rank and fan_in of each symbol that has a file and a metrics row.

    One shuffle of both tables, combined before it: the latest metrics row counts (of equal
    updated_at the larger values), a null updated_at is earliest. Symbols without an id, a file
    or metrics give no row.
    """
    s = symbols.where("symbol_id is not null and file_id is not null").select("symbol_id", "file_id", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("double").alias("page_rank"), F.lit(None).cast("bigint").alias("fan_in"), F.lit(0).alias("has"))
    m = metrics.where("symbol_id is not null").select("symbol_id", F.lit(None).cast("string").alias("file_id"), F.col("updated_at").cast("timestamp_ntz").alias("at"), F.col("page_rank").cast("double").alias("page_rank"), F.col("fan_in").cast("bigint").alias("fan_in"), F.lit(1).alias("has"))
    latest = F.max(F.when(F.col("has") == 1, F.struct("at", "page_rank", "fan_in")))
    both = s.unionByName(m).groupBy("symbol_id").agg(F.max("file_id").alias("file_id"), F.max("has").alias("has"), latest.alias("m"))
    return both.where("file_id is not null and has = 1").select("file_id", "symbol_id", F.col("m.page_rank").alias("page_rank"), F.col("m.fan_in").alias("fan_in"))
