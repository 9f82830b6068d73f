import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators.snapshot_diff import _absent, canonical_json, diff_pairs, snapshot_changes

SF = "/root/testdata/sf0.001"


def brute(versions, rows):
    """The same by dictionaries."""
    have = {r["version_id"] for r in rows}
    state = {}
    for r in rows:
        if r["symbol_id"] is None:
            continue
        k = (r["version_id"], r["symbol_id"])
        at = (r["ingested_at"] or dt.datetime.min, r["row_id"])
        if k not in state or at > state[k][0]:
            f, s = r["ast_fingerprint"], r["signature_json"]
            try:
                s = None if s is None else ("j", json.dumps(json.loads(s), sort_keys=True))
            except ValueError:
                s = ("t", s)
            state[k] = (at, f and f.lower(), s)
    out, repos = set(), {}
    for v in sorted(versions, key=lambda v: (v["created_at"], v["version_id"])):
        if v["version_id"] in have:
            repos.setdefault(v["repo_id"], []).append(v["version_id"])
    by = {}
    for (v, s), x in state.items():
        by.setdefault(v, {})[s] = x[1:]
    for chain in repos.values():
        for a, b in zip(chain, chain[1:]):
            old, new = by.get(a, {}), by.get(b, {})
            out |= {(b, s, "added") for s in new.keys() - old.keys()} | {(b, s, "removed") for s in old.keys() - new.keys()}
            out |= {(b, s, "modified") for s in new.keys() & old.keys() if new[s] != old[s]}
    return out


def got(spark, v, r, **kw):
    rows = [tuple(x) for x in snapshot_changes(v, r, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("rows_per_bucket, share", [(100_000, 0.25), (500, 0.01)])
def test_equals_brute_force(spark, rows_per_bucket, share):
    v, r = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("versions", "symbol_versions"))
    want = brute([x.asDict() for x in v.collect()], [x.asDict() for x in r.collect()])
    assert got(spark, v, r, rows_per_bucket=rows_per_bucket, expected_share=share) == want
    assert want


V = "version_id string, repo_id string, created_at timestamp_ntz"
R = "row_id bigint, version_id string, symbol_id string, ast_fingerprint string, signature_json string, ingested_at timestamp_ntz, bucket int, repo_id string"
T = [dt.datetime(2026, 1, d) for d in range(1, 9)]


def test_cases(spark):
    v = spark.createDataFrame([("v1", "r", T[0]), ("empty", "r", T[1]), ("v2", "r", T[2]), ("w1", "q", T[0]), ("lost", None, T[0])], V)
    rows = [
        ("v1", "same", "AB", '{"a": 1, "b": [1, 2]}', T[0]), ("v2", "same", "ab", '{"b":[1,2],"\\u0061":1.0}', T[0]),
        ("v1", "order", "x", "[1,2]", T[0]), ("v2", "order", "x", "[2,1]", T[0]),
        ("v1", "text", "x", "{bad", T[0]), ("v2", "text", "x", "{bad ", T[0]),
        ("v1", "null", None, None, T[0]), ("v2", "null", None, "null", T[0]),
        ("v1", "nulls", None, None, T[0]), ("v2", "nulls", None, None, T[0]),
        ("v1", "gone", "x", "", T[0]), ("v2", "new", "x", "y" * 100_000, T[0]),
        ("v1", "late", "x", "1", T[1]), ("v2", "late", "x", "1", T[3]), ("v2", "late", "old", "1", T[2]), ("v2", "late", "older", "1", None),
        ("v2", "same", "ab", '{"a":1,"b":[1,2]}', T[0]), ("w1", "alone", "x", "1", T[0]), ("unlisted", "s", "x", "1", T[0]), ("v2", None, "x", "1", T[0]), ("lost", "s", "x", "1", T[0]),
    ]
    r = spark.createDataFrame([(i, *x, 7, "clash") for i, x in enumerate(rows)], R)
    assert got(spark, v, r) == {("v2", "order", "modified"), ("v2", "text", "modified"), ("v2", "null", "modified"), ("v2", "gone", "removed"), ("v2", "new", "added")}
    assert got(spark, v, r.limit(0)) == set() and got(spark, v.limit(0), r) == set()


def test_json_values():
    assert canonical_json('{"a":1,"b":"\\u00e9"}') == canonical_json(' {"b": "é", "a": 1.0}')
    assert len({canonical_json(x) for x in ("1", "true", '"1"', "[1]", "1 x", "NaN", "", "null")}) == 8


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 60), st.integers(0, 3))), st.sets(st.tuples(st.integers(0, 60), st.integers(0, 3))), st.integers(1, 8))
def test_iblt_recovers_any_difference(a, b, cells):
    pairs = [(*x, 1) for x in a] + [(*x, -1) for x in b]
    k, v, s = (np.array(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 3
    t, k, v, s = diff_pairs(np.zeros(len(k), np.int64), k.astype(np.uint64), np.stack([v, v * 0 + 7], 1).astype(np.uint64).reshape(-1, 2), s.astype(np.int64), 1, cells)
    v = v[:, 0]
    assert {(int(x), int(y)) for x, y, z in zip(k, v, s) if z > 0} == a - b
    assert {(int(x), int(y)) for x, y, z in zip(k, v, s) if z < 0} == b - a


def test_both_words_of_a_digest_count():
    key = np.array([1, 1, 2, 2], np.uint64)
    value = np.array([[5, 1], [5, 2], [6, 3], [6, 3]], np.uint64)
    t, k, v, s = diff_pairs(np.zeros(4, np.int64), key, value, np.array([1, -1, 1, -1]), 1, 8)
    assert sorted(zip(k.tolist(), v.tolist(), s.tolist())) == [(1, [5, 1], 1), (1, [5, 2], -1)]
    found = np.array([0]), np.array([1], np.uint64), np.array([[5, 9]], np.uint64), np.array([1])
    assert _absent(found, (np.zeros(4, np.int64), key, value, np.array([1, -1, 1, -1]))).all()


def test_a_symbol_delivered_very_often(spark, monkeypatch):
    """Half of the rows are deliveries of one symbol; a partition passes it on once for each hold."""
    from cairn.operators import snapshot_diff as D

    r = spark.range(20_000).selectExpr("id row_id", "if(id % 40 < 20, 'v1', 'v2') version_id", "if(id % 2 = 0, 'hot', concat('s', id)) symbol_id", "if(id % 40 < 20, 'a', 'b') ast_fingerprint", "string(id % 3) signature_json", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id) ingested_at").coalesce(1)
    v = spark.createDataFrame([("v1", "r", T[0]), ("v2", "r", T[2])], V)
    want = brute([x.asDict() for x in v.collect()], [x.asDict() for x in r.collect()])
    assert got(spark, v, r) == want and len(want) == 10_001
    batches = r.select("version_id", "symbol_id", "ast_fingerprint", "signature_json", F.col("ingested_at").alias("at"), "row_id").toArrow().to_batches(max_chunksize=500)
    for hold, most in ((200_000, 2), (1000, 80)):
        monkeypatch.setattr(D, "HOLD", hold)
        out = pa.Table.from_batches(D._digest_stream(iter(batches)))
        assert sum(x == "hot" for x in out["symbol_id"].to_pylist()) <= most and out.num_rows >= 10_002
