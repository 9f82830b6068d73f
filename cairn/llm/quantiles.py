"""Percentiles of very large numeric columns with bounded error.

A sketch is a hierarchy of compactors: items of level h stand for 2**h values. A full level is
sorted and every other item, from a random start, moves up; so sketches of parts or days merge
level by level. Capacities shrink by ``SHRINK`` from the top level down, which keeps the rank
error of any quantile below ``rank_error(k)`` with probability 0.99.

The start of each compaction is drawn from a sequence seeded by the group and the partition. A
task that runs again over the same rows in the same order gives the same sketch; after a
shuffle the order may differ, and then so does the sketch, within the same bound. Merging
sorts its parts first and depends on them alone.

Groups that fit the lowest level need no compaction: they stay arrays side by side and become
rows without an object of their own, so many small groups cost little more than their values.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Capacity of a level as a share of the one above it, and the smallest capacity.
SHRINK, LEAST = 2 / 3, 8
_WORD = (1 << 64) - 1


def rank_error(k: int) -> float:
    """Bound of the rank error as a share of n, held with probability 0.99 for each quantile."""
    return 3 / k


class Sketch:
    """Compactor hierarchy over float64 values."""

    __slots__ = ("high", "k", "levels", "low", "n", "state")

    def __init__(self, k: int, seed: int):
        self.k, self.n, self.state = k, 0, seed
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.low, self.high = math.inf, -math.inf

    def _coin(self) -> int:
        """A random bit, from a 64-bit counter that is mixed: a few bytes a sketch."""
        self.state = (self.state + 0x9E3779B97F4A7C15) & _WORD
        x = ((self.state ^ (self.state >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WORD
        return (x ^ (x >> 31)) >> 63

    def _capacity(self, level: int) -> int:
        return max(LEAST, math.ceil(self.k * SHRINK ** (len(self.levels) - 1 - level)))

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            x = self.levels[h]
            # A sketch is full when its levels together exceed their capacities; the lowest full level goes.
            if len(x) > self._capacity(h):
                x = np.sort(x)
                odd = x[:0]
                if len(x) % 2:  # the extra item stays; its side is random, so that no end is favoured
                    odd, x = (x[-1:], x[:-1]) if self._coin() else (x[:1], x[1:])
                up = x[self._coin() :: 2]
                self.levels[h] = odd
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
                h = 0 if h + 2 == len(self.levels) else h + 1
            else:
                h += 1

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        step = 8 * self.k
        for i in range(0, len(values), step):
            self.levels[0] = np.concatenate([self.levels[0], values[i : i + step]])
            self._compress()

    def merge(self, n: int, low: float, high: float, *others: list[np.ndarray]) -> None:
        """Take in the levels of other sketches, level by level; n, low and high are those of all of them."""
        self.n, self.low, self.high = self.n + n, min(self.low, low), max(self.high, high)
        for h in range(max(map(len, others))):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
            self.levels[h] = np.concatenate([self.levels[h], *(x[h] for x in others if len(x) > h)])
        self._compress()

    def quantiles(self, ps: list[float]) -> list[float]:
        """The smallest kept value whose estimated rank reaches p * n; the ends are exact."""
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, rank = items[order], np.cumsum(weights[order])
        at = np.searchsorted(rank, np.ceil(np.array(ps) * rank[-1]))
        got = items[np.minimum(at, len(items) - 1)]
        return [self.low if p <= 0 else self.high if p >= 1 else float(x) for p, x in zip(ps, got)]


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


_SKETCH = pa.schema([("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("levels", pa.list_(pa.list_(pa.float64())))])
_SKETCH_SQL = "n bigint, low double, high double, levels array<array<double>>"


#: Rows that a worker holds before it looks at them, and small groups' values that it keeps.
_FOLD, _KEEP = 1 << 18, 1 << 21


def _sketch_batch(schema: pa.Schema, groups: list[tuple], n, low, high, outer, inner, values) -> pa.RecordBatch:
    """Rows of sketches from their levels laid out in one array."""
    levels = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values, pa.float64())))
    keys = [pa.array(c, pa.string()) for c in zip(*groups)] if groups else []
    return pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), levels], schema=schema)


def _batches(schema: pa.Schema, rows: list[tuple[tuple, Sketch]], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows of sketches, some at a time."""
    for i in range(0, len(rows), size):
        part = [s for _, s in rows[i : i + size]]
        lists = [x for s in part for x in s.levels]
        outer, inner = np.cumsum([0, *(len(s.levels) for s in part)]), np.cumsum([0, *map(len, lists)])
        yield _sketch_batch(schema, [g for g, _ in rows[i : i + size]], [s.n for s in part], [s.low for s in part], [s.high for s in part], outer, inner, np.concatenate(lists))


def _row_levels(levels: pa.ListArray):
    """A function that gives the levels of a row, without copies."""
    outer, inner, values = levels.offsets.to_numpy(), levels.values.offsets.to_numpy(), levels.values.values.to_numpy(zero_copy_only=False)
    return lambda i: [values[inner[j] : inner[j + 1]] for j in range(outer[i], outer[i + 1])]


class _Folder:
    """Values of the groups of one partition, small groups as arrays, large ones as sketches."""

    def __init__(self, schema: pa.Schema, k: int, part: int):
        self.schema, self.k, self.part = schema, k, part
        self.ids: dict[tuple, int] = {}
        self.sketches: dict[int, Sketch] = {}
        self.code, self.value, self.held = [], [], 0

    def add(self, names: list[list], code: np.ndarray, value: np.ndarray) -> None:
        """``code`` counts in mixed radix over the ``names`` of the keys."""
        distinct, at = np.unique(code, return_inverse=True)
        ids = []
        for rest in distinct.tolist():
            g = []
            for ns in reversed(names):
                rest, i = divmod(rest, len(ns))
                g.append(ns[i])
            ids.append(self.ids.setdefault(tuple(reversed(g)), len(self.ids)))
        self.code.append(np.array(ids, np.int64)[at])
        self.value.append(value)
        self.held += len(value)

    def fold(self) -> None:
        """Sort what is held by group; what exceeds the lowest level goes into sketches."""
        code, value = np.concatenate(self.code), np.concatenate(self.value)
        order = np.lexsort((value, code))
        code, value = code[order], value[order]
        edges = np.searchsorted(code, np.arange(len(self.ids) + 1))
        large = np.diff(edges) > self.k
        large[list(self.sketches)] = True
        groups = list(self.ids)
        for i in np.flatnonzero(large).tolist():
            if i not in self.sketches:
                self.sketches[i] = Sketch(self.k, _seed(groups[i], self.part))
            self.sketches[i].add(value[edges[i] : edges[i + 1]])
        small = ~large[code]
        self.code, self.value, self.held = [code[small]], [value[small]], int(small.sum())

    def give(self) -> Iterator[pa.RecordBatch]:
        """All sketches, after which the folder is empty."""
        self.fold()
        groups, code, value = list(self.ids), self.code[0], self.value[0]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]) if len(code) else np.zeros(1, int)
        for i in range(0, len(edges) - 1, 2000):
            e = edges[i : i + 2001]
            first, last = e[:-1], e[1:] - 1
            yield _sketch_batch(self.schema, [groups[c] for c in code[first].tolist()], np.diff(e), value[first], value[last], np.arange(len(e)), e - e[0], value[e[0] : e[-1]])
        yield from _batches(self.schema, [(groups[i], s) for i, s in self.sketches.items()])
        self.__init__(self.schema, self.k, self.part)


def sketch_parts(values: DataFrame, keys: list[str], k: int = 400, most_groups: int = 20_000) -> DataFrame:
    """One sketch for each partition and group: ``keys`` (as strings), n, low, high, levels.

    ``values``: the key columns and ``value`` double. Null and NaN values are left out, keys may
    be null. No shuffle; a partition with more than ``most_groups`` groups gives its sketches
    out and starts anew, which costs rows but no accuracy.
    """
    source = values.where("value is not null and not isnan(value)").select(*(F.col(c).cast("string").alias(c) for c in keys), F.col("value").cast("double").alias("value"))
    schema = pa.schema([(c, pa.string()) for c in keys] + list(_SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(schema, k, TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            code, names = np.zeros(batch.num_rows, np.int64), []
            for c in keys:
                d = batch.column(c).dictionary_encode(null_encoding="encode")
                names.append(d.dictionary.to_pylist())
                code = code * len(names[-1]) + d.indices.to_numpy()
            folder.add(names, code, batch.column("value").to_numpy(zero_copy_only=False))
            if folder.held >= _FOLD:
                folder.fold()
            if len(folder.ids) > most_groups or folder.held > _KEEP:
                yield from folder.give()
        if folder.ids:
            yield from folder.give()

    return source.mapInArrow(run, ", ".join(f"`{c}` string" for c in keys) + ", " + _SKETCH_SQL)


def merge_sketches(parts: DataFrame, keys: list[str], k: int = 400, fan_in: int = 64, *, written: bool = False) -> DataFrame:
    """One sketch for each value of ``keys``, merged level by level from the rows of ``parts``.

    ``keys`` may be fewer than those of the parts: days or partitions then add up. The parts are
    written first, unless they are ``written`` already, and counted by group; as long as a group
    has more than ``fan_in`` of them, its parts merge ``fan_in`` to one in rounds. A task streams
    the parts of a group in a fixed order and holds one sketch, however many there are.
    """
    schema = pa.schema([(c, pa.string()) for c in keys] + list(_SKETCH))
    sql = ", ".join(f"`{c}` string" for c in keys) + ", " + _SKETCH_SQL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sketch, done = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            fresh = np.zeros(b.num_rows, bool)
            for c in (*keys, "_fan"):
                d = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                fresh[1:] |= d[1:] != d[:-1]
            edges = [0, *np.flatnonzero(fresh).tolist(), b.num_rows]
            n, low, high = (b.column(c).to_numpy() for c in ("n", "low", "high"))
            levels = _row_levels(b.column("levels"))
            for x, y in zip(edges, edges[1:]):
                g = tuple(b.column(c)[x].as_py() for c in (*keys, "_fan"))
                if g != last:
                    if sketch:
                        done.append((last[:-1], sketch))
                    last, sketch = g, Sketch(k, _seed(g))
                sketch.merge(int(n[x:y].sum()), float(low[x:y].min()), float(high[x:y].max()), *map(levels, range(x, y)))
            if len(done) >= 500:
                yield from _batches(schema, done)
                done = []
        if sketch:
            yield from _batches(schema, [*done, (last[:-1], sketch)])

    def merged(rows: DataFrame) -> DataFrame:
        one = rows.select(*keys, "_fan", "n", "low", "high", "levels").repartition(*keys, "_fan")
        return one.sortWithinPartitions(*keys, "_fan", "n", "low", "high", F.xxhash64("levels")).mapInArrow(run, sql)

    parts = parts.select(*keys, "n", "low", "high", "levels")
    parts = parts if written else cut(parts)
    while True:
        counts = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts"))
        # Groups with more parts than fit one merge: at most one for each fan_in rows.
        hot = counts.where(F.col("_parts") > fan_in).select(*(F.col(c).alias(f"_{c}") for c in keys), F.ceil(F.col("_parts") / fan_in).alias("_fans"))
        if hot.isEmpty():
            return merged(parts.withColumn("_fan", F.lit(0).cast("bigint")))
        same = functools.reduce(lambda a, c: a & c, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys), F.lit(True))
        # Dealt by the place in the written files, which a task that runs again finds unchanged.
        dealt = parts.withColumn("_id", F.monotonically_increasing_id()).join(hot, same, "left")
        parts = cut(merged(dealt.withColumn("_fan", F.pmod("_id", F.coalesce("_fans", F.lit(1))))))


def sketch_quantiles(sketches: DataFrame, keys: list[str], ps: list[float], k: int = 400) -> DataFrame:
    """``keys``, n, p, value and rank_error, one row for each group and p."""
    schema = pa.schema([(c, pa.string()) for c in keys] + [("n", pa.int64()), ("p", pa.float64()), ("value", pa.float64()), ("rank_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            levels, low, high = _row_levels(b.column("levels")), b.column("low").to_numpy(), b.column("high").to_numpy()
            out, error = np.empty((b.num_rows, len(ps))), np.zeros(b.num_rows)
            s = Sketch(k, 0)
            for i in range(b.num_rows):
                s.levels, s.low, s.high = levels(i), low[i], high[i]
                out[i] = s.quantiles(ps)
                error[i] = rank_error(k) if len(s.levels) > 1 else 0.0
            again = pa.array(np.repeat(np.arange(b.num_rows), len(ps)))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(again) for c in (*keys, "n")), pa.array(np.tile(ps, b.num_rows)), pa.array(out.ravel()), pa.array(np.repeat(error, len(ps)))], schema=schema)

    return sketches.mapInArrow(run, ", ".join(f"`{c}` string" for c in keys) + ", n bigint, p double, value double, rank_error double")
