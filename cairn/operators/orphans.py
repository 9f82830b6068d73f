"""References to records that do not exist.

Keys are cut into ranges of the order of their 64-bit digest, which are even without a
sampling pass. The parents of a range travel to one place and become one sorted array; the
references of the range follow them in the same sorted stream, batch after batch, and are
probed by vectorised binary search. A task therefore holds the parents of one range and one
batch of references, whatever the table's size.

A parent's rows are reduced to its latest state before anything else, combined before their
shuffle, so a range holds each of its keys once. A hot key of the references makes one range
hot. Ranges are counted first (map-side combined, one row a range); a range over twice its
share gets as many salts as it needs, its parents are sent to each salt and its references are
spread over them. No task gets more rows of a range than that, however the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_OUT = "ref_table string, ref_id bigint, ref_ts timestamp_ntz, reason string"
_OUT_ARROW = pa.schema(
    [("ref_table", pa.string()), ("ref_id", pa.int64()), ("ref_ts", pa.timestamp("us")), ("reason", pa.string())]
)


def _micros(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.timestamp("us")).cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


class _Parents:
    """The parents of one range as sorted arrays, of each key the state with the latest version."""

    def __init__(self, parts: list[pa.Table]):
        self.size = sum(p.num_rows for p in parts)
        if not self.size:
            return
        t = pa.concat_tables(parts).combine_chunks()
        digest = t["digest"].to_numpy()
        version = _micros(t["ts"].combine_chunks(), _LOW)
        gone = pc.fill_null(t["gone"], False).to_numpy(zero_copy_only=False).astype(bool)
        since = _micros(t["since"].combine_chunks(), _LOW)
        keys = t["key"].combine_chunks()
        order = np.lexsort((gone, since, version, digest))
        digest, keys = digest[order], keys.take(pa.array(order))
        same = np.zeros(len(digest), bool)
        same[1:] = digest[1:] == digest[:-1]
        self.clash: dict[str, tuple[bool, int]] = {}
        if len(digest) > 1:
            equal = pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            for d in np.unique(digest[1:][same[1:] & ~equal]):  # two keys of one digest: kept by key
                for i in np.flatnonzero(digest == d):
                    self.clash[keys[int(i)].as_py()] = (bool(gone[order[i]]), int(since[order[i]]))
        last = np.append(~same[1:], True)
        self.digest, self.keys = digest[last], keys.filter(pa.array(last))
        self.gone, self.since = gone[order][last], since[order][last]

    def probe(self, refs: pa.Table) -> np.ndarray:
        """0 found, 1 missing, 2 deleted, 3 later than the reference."""
        if not self.size:
            return np.ones(refs.num_rows, np.int8)
        digest, at = refs["digest"].to_numpy(), _micros(refs["ts"].combine_chunks(), _HIGH)
        keys = refs["key"].combine_chunks()
        i = np.minimum(np.searchsorted(self.digest, digest), len(self.digest) - 1)
        hit = (self.digest[i] == digest) & pc.equal(keys, self.keys.take(pa.array(i))).to_numpy(zero_copy_only=False).astype(bool)
        out = np.where(~hit, 1, np.where(self.gone[i], 2, np.where(self.since[i] > at, 3, 0))).astype(np.int8)
        if self.clash:
            for j in np.flatnonzero(pc.is_in(keys, pa.array(list(self.clash))).to_numpy(zero_copy_only=False)):
                gone, since = self.clash[keys[int(j)].as_py()]
                out[j] = 2 if gone else 3 if since > at[j] else 0
        return out


_REASONS = pa.array(["", "missing", "deleted", "later"])


def _probe_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, pending, parents = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column("place").to_numpy()
        is_ref = batch.column("is_ref").to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero((place[1:] != place[:-1]) | (is_ref[1:] != is_ref[:-1])) + 1
        edges = [0, *cuts.tolist(), len(place)]
        for a, b in zip(edges, edges[1:]):
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if place[a] != current:
                current, pending, parents = place[a], [], None
            if not is_ref[a]:
                pending.append(part.select(["digest", "key", "ts", "since", "gone"]))
                continue
            if parents is None:
                parents, pending = _Parents(pending), []
            found = parents.probe(part)
            bad = np.flatnonzero(found)
            if len(bad):
                miss = part.take(pa.array(bad)).combine_chunks()
                yield from pa.table(
                    [miss["ref_table"], miss["ref_id"], miss["ts"].cast(pa.timestamp("us")), _REASONS.take(pa.array(found[bad]))],
                    schema=_OUT_ARROW,
                ).to_batches()


def find_orphans(refs: DataFrame, parents: DataFrame, *, rows_per_range: int = 50_000, max_range_bits: int = 20) -> DataFrame:
    """References whose key has no living parent at the time of the reference.

    ``refs``: ref_table, ref_id, key, ref_ts. ``parents``: key, version_ts (of several rows of a
    key the latest counts), since, gone. Keys have to be in normal form; other columns are
    ignored. Result: ref_table, ref_id, ref_ts, reason (``missing``, ``deleted`` or ``later``),
    one row for each reference row.

    A null key in ``refs`` claims nothing and gives no row; a null key in ``parents`` is no
    parent. Null ``ref_ts`` or ``since`` never make a reference too early. Parents of one key
    with the same version_ts: the larger (since, gone) counts. Empty parents make every
    reference an orphan, empty references give an empty result.

    ``rows_per_range`` bounds what a task holds; ranges are a power of two up to
    2**``max_range_bits``.
    """
    refs = refs.where(F.col("key").isNotNull()).select("ref_table", "ref_id", "key", F.col("ref_ts").cast("timestamp_ntz").alias("ts"))
    parents = parents.where(F.col("key").isNotNull()).select(
        "key",
        F.col("version_ts").cast("timestamp_ntz").alias("ts"),
        F.col("since").cast("timestamp_ntz").alias("since"),
        F.col("gone").cast("boolean").alias("gone"),
    )
    place_bits = lambda n: (F.shiftright("digest", 64 - n) + (1 << (n - 1))).cast("int")
    # The latest state of each key; null is less than any value.
    parents = cut(parents.groupBy("key").agg(F.max(F.struct("ts", "since", "gone")).alias("s")).select("key", "s.ts", "s.since", "s.gone"))
    refs, parents = refs.withColumn("digest", F.xxhash64("key")), parents.withColumn("digest", F.xxhash64("key"))
    # One pass over the keys, combined before it moves: at most 2**max_range_bits rows of 12 bytes.
    fine = cut(refs.groupBy(place_bits(max_range_bits).alias("fine")).count())
    total = (fine.agg(F.sum("count")).first()[0] or 0) + parents.count()
    bits = min(max_range_bits, max(5, (total // rows_per_range).bit_length()))
    target = 2 * max(rows_per_range, total >> bits)
    refs, parents = refs.withColumn("rng", place_bits(bits)), parents.withColumn("rng", place_bits(bits))
    # One row for each hot range: at most 2**bits / 2 rows of 12 bytes, by the choice of target.
    counts = fine.groupBy(F.shiftright("fine", max_range_bits - bits).alias("rng")).agg(F.sum("count").alias("count"))
    hot = F.broadcast(counts.where(F.col("count") > target).select("rng", F.ceil(F.col("count") / target).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    place = (F.col("rng").cast("bigint") * (1 << 32)) + F.col("salt")
    refs = (
        refs.join(hot, "rng", "left")
        .withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_id"), salts).cast("bigint"))
        .select(place.alias("place"), F.lit(True).alias("is_ref"), "digest", "key", "ts", F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast("boolean").alias("gone"), "ref_table", F.col("ref_id").cast("bigint").alias("ref_id"))
    )
    parents = (
        parents.join(hot, "rng", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))))
        .select(place.alias("place"), F.lit(False).alias("is_ref"), "digest", "key", "ts", "since", "gone", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("bigint").alias("ref_id"))
    )
    return parents.unionByName(refs).repartition("place").sortWithinPartitions("place", "is_ref").mapInArrow(_probe_stream, _OUT)
