"""What changed between consecutive full snapshots.

Each snapshot becomes one invertible Bloom lookup table per hash bucket of its keys. The table
of a snapshot is subtracted from that of the next one, cell by cell, so that equal (key,
content) pairs cancel; what is left is peeled. A bucket that does not peel is done again with
a table twice as large. Recovered pairs are verified against the rows' digests and classified:
a key on the later side only was added, on the earlier side only removed, on both modified.

One shuffle carries a 16-byte digest of the content instead of the content. It cannot be left
to the tables: rows delivered more than once have to meet before they are added to one. What a
partition holds of them is combined before the shuffle, some 100,000 keys at a time, so that a
key with a large share of the rows leaves each partition in a few rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Entries of a worker's memo of digests; rows and bytes that it holds to combine deliveries.
MEMO, HOLD, HOLD_BYTES = 100_000, 200_000, 128 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _number(text: str):
    value = float(text)
    return int(value) if math.isfinite(value) and value == int(value) else value


def _refuse(text: str):
    raise ValueError(text)


def canonical_json(text: str) -> str:
    """The JSON value of ``text`` in one form: sorted keys, no white space, no optional escapes.

    Text that does not parse stays as it is, marked so that it equals no value.
    """
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_refuse)
        return "j" + json.dumps(value, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return "t" + text


def content_digest(fingerprint: str | None, signature: str | None, canonical=canonical_json) -> bytes:
    """16 bytes over the two compared columns; null is a value of its own."""
    a = b"\0" if fingerprint is None else b"\1" + fingerprint.lower().encode("utf-8", "surrogatepass")
    b = b"\0" if signature is None else b"\1" + canonical(signature).encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(a).to_bytes(8, "little") + a + b, digest_size=16).digest()


_ROW = pa.schema([("version_id", pa.string()), ("symbol_id", pa.string()), ("content", pa.binary()), ("at", pa.timestamp("us")), ("row_id", pa.int64())])


def _latest_rows(t: pa.Table) -> pa.Table:
    """Of each (version, symbol) the row with the latest arrival, then the larger row_id."""
    code = [t[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("version_id", "symbol_id")]
    at = pc.fill_null(t["at"].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((pc.fill_null(t["row_id"], 0).to_numpy(), at, *code))
    new = [c[order[1:]] != c[order[:-1]] for c in code]
    return t.take(pa.array(np.sort(order[np.append(new[0] | new[1], True)])))


def _digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content digests of the latest deliveries; a key comes once for each ``HOLD`` rows held."""
    memo: dict[tuple, bytes] = {}

    def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
        content = []
        for pair in zip(t["ast_fingerprint"].to_pylist(), t["signature_json"].to_pylist()):
            x = memo.get(pair)
            if x is None:
                x = content_digest(*pair)
                if len(memo) < MEMO:
                    memo[pair] = x
            content.append(x)
        yield from pa.table([t["version_id"], t["symbol_id"], pa.array(content, pa.binary()), t["at"].cast(pa.timestamp("us")), t["row_id"]], schema=_ROW).to_batches(max_chunksize=10_000)

    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= HOLD or size >= HOLD_BYTES:
            t = _latest_rows(pa.Table.from_batches(held))
            held, rows, size = t.to_batches(), t.num_rows, t.nbytes
            if rows >= HOLD // 2 or size >= HOLD_BYTES // 2:
                yield from give(t)
                held, rows, size = [], 0, 0
    if held:
        yield from give(_latest_rows(pa.Table.from_batches(held)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _sorted_pairs(table, key, value, sign) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs, and where one differs from the one before it in table, key or value."""
    order = np.lexsort((sign, *value.T, key, table))
    same = (table[order[1:]] == table[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (value[order[1:]] == value[order[:-1]]).all(1)
    return order, np.append(True, ~same) if len(order) else np.zeros(0, bool)


class Iblt:
    """Invertible Bloom lookup tables of many (bucket, snapshot pair) cells, side by side.

    Each pair of ``key`` and ``value`` (words of 64 bits) lies in one cell of each of three
    sub-tables of ``cells`` cells. A cell keeps a signed count and the exclusive or of keys,
    values and checksums; adding the earlier snapshot with sign -1 subtracts its table.
    """

    def __init__(self, tables: int, cells: int, words: int, seed: int = 0):
        self.cells, self.seed = cells, np.uint64(seed * 0x2545F491 + 1)
        n = tables * 3 * cells
        self.count, self.value = np.zeros(n, np.int64), np.zeros((n, words), np.uint64)
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def _places(self, table: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = key * _C[0] + self.seed
            for word in value.T:
                h = _mix(h * _C[1] ^ word)
            h = _mix(h)
            check = _mix(h + _C[1])
            sub = [(_mix(h + np.uint64(j) * _C[0]) % np.uint64(self.cells)).astype(np.int64) + (table * 3 + j) * self.cells for j in range(3)]
        return np.concatenate(sub), check

    def add(self, table: np.ndarray, key: np.ndarray, value: np.ndarray, sign: np.ndarray) -> None:
        at, check = self._places(table, key, value)
        np.add.at(self.count, at, np.tile(sign, 3))
        for cells, x in ((self.key, key), (self.check, check), *((self.value[:, i], x) for i, x in enumerate(value.T))):
            np.bitwise_xor.at(cells, at, np.tile(x, 3))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered table, key, value and sign, and the tables that still hold something."""
        empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, self.value.shape[1]), np.uint64), np.zeros(0, np.int64)
        out = [empty]
        look, turns = np.flatnonzero(self.count), 0
        while len(look) and turns < 1000:
            turns += 1
            look = look[np.abs(self.count[look]) == 1]
            pair = look // (3 * self.cells), self.key[look], self.value[look], self.count[look]
            pure = self._places(*pair[:3])[1] == self.check[look]
            if not pure.any():
                break
            pair = tuple(x[pure] for x in pair)
            order, first = _sorted_pairs(*pair)  # a pair alone in several cells is taken once
            table, key, value, sign = (x[order[first]] for x in pair)
            self.add(table, key, value, -sign)
            out.append((table, key, value, sign))
            look = np.unique(self._places(table, key, value)[0])
        left = np.unique(np.flatnonzero((self.count != 0) | (self.key != 0) | (self.value != 0).any(1)) // (3 * self.cells))
        return *(np.concatenate(x) for x in zip(*out)), left


def _exact(table, key, value, sign):
    """Difference of the pairs by sorting: for tables that did not peel however large."""
    order, first = _sorted_pairs(table, key, value, sign)
    total = np.add.reduceat(sign[order], np.flatnonzero(first)) if len(order) else np.zeros(0, np.int64)
    at = order[first][total != 0]
    return table[at], key[at], value[at], total[total != 0]


def _absent(found: tuple, rows: tuple) -> np.ndarray:
    """Which of the found pairs are no row of their table and side, compared word by word."""
    with np.errstate(over="ignore"):
        code = lambda t, k, v, s: _mix(_mix(k) + t.astype(np.uint64) * _C[0] + (s + 2).astype(np.uint64))
        mine = code(*rows)
        order = np.argsort(mine, kind="stable")
        at = order[np.minimum(np.searchsorted(mine[order], code(*found)), len(order) - 1)]
    return ~((rows[0][at] == found[0]) & (rows[1][at] == found[1]) & (rows[2][at] == found[2]).all(1) & (rows[3][at] == found[3]))


def diff_pairs(table: np.ndarray, key: np.ndarray, value: np.ndarray, sign: np.ndarray, tables: int, cells: int, rounds: int = 10):
    """Differences of all tables: table, key, value and sign of each pair on one side only.

    A key comes at most once on each side of a table; ``value`` has a row of words for each.
    """
    out, todo = [(table[:0], key[:0], value[:0], sign[:0])], np.arange(tables)
    for r in range(rounds):
        if not len(todo):
            break
        new = np.full(tables, -1)
        new[todo] = np.arange(len(todo))
        mine = new[table] >= 0
        rows = new[table[mine]], key[mine], value[mine], sign[mine]
        iblt = Iblt(len(todo), cells << r, value.shape[1], seed=r)
        iblt.add(*rows)
        *found, left = iblt.peel()
        # Verify: each recovered pair is a row of its side, in both words of its digest.
        wrong = np.unique(found[0][_absent(tuple(found), rows)]) if len(found[0]) else found[0]
        failed = np.union1d(left, wrong).astype(np.int64)
        good = ~np.isin(found[0], failed)
        out.append((todo[found[0][good]], *(x[good] for x in found[1:])))
        todo = todo[failed]
    if len(todo):
        mine = np.isin(table, todo)
        out.append(_exact(table[mine], key[mine], value[mine], sign[mine]))
    return tuple(np.concatenate(x) for x in zip(*out))


_CHANGES = "repo_id string, seq int, symbol_id string, change_type string"
_CHANGES_ARROW = pa.schema([("repo_id", pa.string()), ("seq", pa.int32()), ("symbol_id", pa.string()), ("change_type", pa.string())])


def _diff_bucket(share: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        seq, versions = group["seq"].to_numpy().astype(np.int64), int(group["versions"][0].as_py())
        ids = group["symbol_id"].combine_chunks().dictionary_encode()
        names, code = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
        raw = np.frombuffer(b"".join(group["content"].to_pylist()), np.dtype("<u8")).reshape(-1, 2)
        # Latest delivery of each (snapshot, key).
        at = pc.fill_null(group["at"].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        row = pc.fill_null(group["row_id"], 0).to_numpy()
        order = np.lexsort((row, at, code, seq))
        s, c = seq[order], code[order]
        last = order[np.append((s[1:] != s[:-1]) | (c[1:] != c[:-1]), True)]
        seq, code, raw = seq[last], code[last], raw[last]
        # A key is its place in the bucket's sorted key list, spread over 64 bits: exact within the group.
        with np.errstate(over="ignore"):
            key = _mix(code.astype(np.uint64) + _C[0])
        new, old = seq > 0, seq < versions - 1
        table = np.concatenate([seq[new] - 1, seq[old]])
        keys, values = np.concatenate([key[new], key[old]]), np.concatenate([raw[new], raw[old]])
        sign = np.concatenate([np.ones(new.sum(), np.int64), -np.ones(old.sum(), np.int64)])
        cells = max(8, math.ceil(share * len(seq) / max(1, versions)))
        t, k, v, s = diff_pairs(table, keys, values, sign, versions - 1, cells)
        # Classify: both signs of a key in a table mean that its content changed.
        by_key = np.lexsort((s, k, t))
        t, k, s = t[by_key], k[by_key], s[by_key]
        twin = np.zeros(len(t), bool)
        twin[:-1] = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
        second = np.zeros(len(t), bool)
        second[1:] = twin[:-1]
        kind = np.where(twin, 2, np.where(s > 0, 0, 1))[~second]
        t, k = t[~second], k[~second]
        place = {int(x): i for i, x in enumerate(_mix(np.arange(len(names), dtype=np.uint64) + _C[0]))}
        symbol = names.take(pa.array([place[int(x)] for x in k], pa.int64()))
        return pa.table(
            [pa.array([group["repo_id"][0].as_py()] * len(t), pa.string()), pa.array((t + 1).astype(np.int32)), symbol.cast(pa.string()), pa.array(["added", "removed", "modified"]).take(pa.array(kind))],
            schema=_CHANGES_ARROW,
        )

    return run


def snapshot_chain(versions: DataFrame, present: DataFrame) -> DataFrame:
    """The snapshots that have rows: version_id, repo_id, n rows, seq from 0 by created_at, and their number.

    ``present``: version_id and n, one row each.
    """
    w = Window.partitionBy("repo_id")
    return (
        versions.select("version_id", "repo_id", "created_at")
        .where(F.col("repo_id").isNotNull())
        .dropDuplicates(["version_id"])
        .join(present, "version_id")
        .select("version_id", "repo_id", "n", (F.row_number().over(w.orderBy("created_at", "version_id")) - 1).alias("seq"), F.count(F.lit(1)).over(w).cast("int").alias("versions"))
    )


def snapshot_changes(versions: DataFrame, rows: DataFrame, *, rows_per_bucket: int = 100_000, expected_share: float = 0.25, broadcast_rows: int = 500_000) -> DataFrame:
    """Changes of each snapshot against the one before it in its repository.

    ``versions``: version_id, repo_id, created_at. ``rows``: version_id, symbol_id,
    ast_fingerprint, signature_json, ingested_at, row_id. Result: version_id (the later one),
    symbol_id, change_type (``added``, ``removed``, ``modified``), each row once.

    A snapshot without rows is passed over; the first of a repository gives no rows; rows whose
    version is not listed or has no repo_id, and rows without symbol_id, belong to no snapshot. Of several rows
    of a symbol in a snapshot the one with the latest ingested_at counts (null is earliest,
    then the larger row_id). Fingerprints compare without letter case, signatures as JSON
    values, text that does not parse as text; null differs from all but null. Extra columns
    are ignored; empty tables give an empty result.

    ``expected_share``: cells of a sub-table for each row of a bucket's snapshot at first;
    too few only cost another round. The rows are read twice: their version_id alone for the
    chain, and what is compared. The chain of snapshots is broadcast up to
    ``broadcast_rows`` snapshots and joined by shuffle beyond.
    """
    present = rows.where(F.col("version_id").isNotNull()).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    chain = cut(snapshot_chain(versions, present))
    snapshots, total = chain.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = 1 << (total // rows_per_bucket).bit_length()
    small = snapshots <= broadcast_rows
    side = F.broadcast(chain) if small else chain
    digests = rows.where(F.col("symbol_id").isNotNull()).select("version_id", "symbol_id", "ast_fingerprint", "signature_json", F.col("ingested_at").cast("timestamp_ntz").alias("at"), F.col("row_id").cast("bigint").alias("row_id"))
    digests = digests.mapInArrow(_digest_stream, "version_id string, symbol_id string, content binary, at timestamp_ntz, row_id bigint")
    placed = (
        digests.join(side.where(F.col("versions") > 1).drop("n"), "version_id")
        .withColumn("bucket", F.pmod(F.xxhash64("symbol_id"), F.lit(buckets)).cast("int"))
        .select("repo_id", "bucket", "seq", "versions", "symbol_id", "content", "at", "row_id")
    )
    changes = placed.groupBy("repo_id", "bucket").applyInArrow(_diff_bucket(expected_share), _CHANGES)
    ids = chain.select("version_id", "repo_id", "seq")
    return changes.join(F.broadcast(ids) if small else ids, ["repo_id", "seq"]).select("version_id", "symbol_id", "change_type")
