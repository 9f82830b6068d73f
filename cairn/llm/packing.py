"""Filling windows of fixed capacity by minimum bin slack.

Texts are measured once. A text longer than a window is cut into full windows and a rest; all
else is whole. Pieces are dealt at random into shards that hold many windows' worth of tokens,
so that shards pack in parallel and what a shard loses on its last window stays small. In a
shard only the number of pieces of each length matters: for each window, the longest piece
left is taken, and a bitset of reachable sums over the other lengths finds the fullest
combination, which is then removed, as often as the pieces last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import FOLDER, count_tokens


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, how often) of pieces whose sum is the largest up to ``room``.

    ``lengths`` are the lengths with a positive count, longest first. Bit s of ``reach`` says
    that some of the pieces seen so far sum to s; counts are split into powers of two.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for n, k, earlier in reversed(steps):
        if not (earlier >> total) & 1:
            total -= n * k
            out[n] = out.get(n, 0) + k
    return list(out.items())


def pack_lengths(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece, from 0; every size lies in 1..capacity."""
    order = np.argsort(-sizes, kind="stable")
    uniq, first, number = np.unique(-sizes[order], return_index=True, return_counts=True)
    lengths = [int(-x) for x in uniq]
    counts, start = dict(zip(lengths, map(int, number))), dict(zip(lengths, map(int, first)))
    window = np.empty(len(sizes), np.int64)
    bins = 0
    while lengths:
        big = lengths[0]
        counts[big] -= 1
        use = {big: 1}
        if room := capacity - big:
            for n, k in fullest([n for n in lengths if counts[n]], counts, room):
                use[n] = use.get(n, 0) + k
        counts[big] += 1
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            at = start[n]
            window[order[at : at + k * times]] = bins + np.arange(k * times) // k
            start[n] += k * times
            counts[n] -= k * times
        bins += times
        lengths = [n for n in lengths if counts[n]]
    return window


_OUT = "window_name string, shard int, bin bigint, doc_id bigint, part int, token_start bigint, n_tokens bigint"


def _pack_shard(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    capacity = int(t["capacity"][0].as_py())
    # The stream's order is not fixed; sorting makes a retried task give the same windows.
    t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
    window = pack_lengths(t["n_tokens"].to_numpy(), capacity)
    cols = [t["window_name"], t["shard"], pa.array(window), t["doc_id"], t["part"], t["token_start"], t["n_tokens"]]
    return pa.table(cols, names=["window_name", "shard", "bin", "doc_id", "part", "token_start", "n_tokens"])


def pack_windows(docs: DataFrame, windows: DataFrame, *, folder: str = FOLDER, shard_windows: int = 1000, shard_pieces: int = 50_000) -> DataFrame:
    """Assign the texts of ``docs`` (doc_id, text) to windows of each kind in ``windows``.

    ``windows``: window_name, tokenizer, capacity_tokens. Result: window_name, window_id,
    doc_id, part, token_start, n_tokens: tokens token_start up to token_start + n_tokens of the
    text lie in that window. No window exceeds its capacity; only a text longer than a whole
    window has more than one part, all but the last of which fill a window each.

    A null, empty text has no token: one row with part 0, n_tokens 0 and a null window_id. A
    kind without a name, tokenizer or positive capacity gives no rows. Repeated rows of a text
    are packed as often as they come; a null doc_id is packed like any other. Extra columns are
    ignored, empty tables give an empty result.

    A shard is meant to hold at least ``shard_windows`` windows' worth of tokens (at most one
    window of a shard is filled badly) and at most about ``shard_pieces`` pieces; where the two
    disagree, the windows win, as long as pieces fit into a task's memory (2 million).
    """
    spark = docs.sparkSession
    kinds = windows.where("window_name is not null and tokenizer is not null and capacity_tokens > 0").select("window_name", "tokenizer", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of windows")
    # 16 bytes a text, written to the shared folder: shards need the totals before the pieces.
    names = sorted({k.tokenizer for k in kinds})
    counted = [count_tokens(docs, tokenizer=n, folder=folder).withColumn("tokenizer", F.lit(n)) for n in names]
    if not counted:
        return spark.createDataFrame([], "window_name string, window_id string, doc_id bigint, part int, token_start bigint, n_tokens bigint")
    sizes = counted[0]
    for more in counted[1:]:
        sizes = sizes.unionByName(more)
    sizes = cut(sizes)
    plan = F.broadcast(spark.createDataFrame([tuple(k) for k in kinds], "window_name string, tokenizer string, capacity bigint"))
    each = sizes.join(plan, "tokenizer")
    full, rest = F.floor(F.col("n_tokens") / F.col("capacity")), F.col("n_tokens") % F.col("capacity")
    totals = each.groupBy("window_name").agg(F.sum(rest).alias("tokens"), F.count_if(rest > 0).alias("pieces")).collect()
    capacity = {k.window_name: k.capacity for k in kinds}
    shards = {}
    for r in totals:
        by_windows = (r.tokens or 0) // (capacity[r.window_name] * shard_windows)
        shards[r.window_name] = int(max(1, min(by_windows, max(1, r.pieces // shard_pieces)), r.pieces // 2_000_000))
    cut_plan = F.broadcast(spark.createDataFrame([*shards.items()] or [("", 1)], "window_name string, shards int"))
    # Full windows of long texts need no packing.
    whole = (
        each.where(full > 0)
        .select("window_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("part"))
        .select("window_name", F.concat_ws(":", F.lit("full"), F.coalesce("doc_id", F.lit(-1)), "part", F.monotonically_increasing_id()).alias("window_id"), "doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"))
    )
    pieces = (
        each.where(rest > 0)
        .join(cut_plan, "window_name")
        .select("window_name", F.pmod(F.xxhash64("window_name", F.monotonically_increasing_id()), "shards").cast("int").alias("shard"), "capacity", "doc_id", full.cast("int").alias("part"), (full * F.col("capacity")).alias("token_start"), rest.alias("n_tokens"))
    )
    packed = pieces.groupBy("window_name", "shard").applyInArrow(_pack_shard, _OUT).select("window_name", F.concat_ws(":", F.lit("s"), "shard", "bin").alias("window_id"), "doc_id", "part", "token_start", "n_tokens")
    none = each.where(F.col("n_tokens") == 0).select("window_name", F.lit(None).cast("string").alias("window_id"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("n_tokens"))
    return packed.unionByName(whole).unionByName(none)


def window_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each kind: windows used, tokens, and the share of capacity that is filled."""
    used = packed.where("window_id is not null").groupBy("window_name").agg(F.countDistinct("window_id").alias("windows"), F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"))
    return used.join(windows.select("window_name", "capacity_tokens"), "window_name").withColumn("filled", F.round(F.col("tokens") / (F.col("windows") * F.col("capacity_tokens")), 6))
