import datetime as dt

import pyarrow as pa

from cairn.operators.orphans import _Parents, find_orphans

T = [dt.datetime(2026, 1, d) for d in range(1, 9)]
R = "ref_table string, ref_id bigint, key string, ref_ts timestamp_ntz, place string, gone int"
P = "key string, version_ts timestamp_ntz, since timestamp_ntz, gone boolean, digest string"


def got(refs, parents, **kw):
    return sorted((r.ref_table, r.ref_id, r.reason) for r in find_orphans(refs, parents, **kw).collect())


def test_cases(spark):
    parents = spark.createDataFrame(
        [("a", T[0], T[0], True, "x"), ("a", T[1], T[0], False, "x"), ("b", T[0], T[0], True, "x"), ("c", T[0], T[4], False, "x"), ("d", None, None, None, "x"), (None, T[0], T[0], False, "x"), ("a", T[1], T[0], False, "x")], P
    )
    refs = [("a", T[1]), ("a", T[1]), ("b", T[1]), ("c", T[3]), ("c", T[4]), ("c", None), ("d", T[0]), ("zz", None), (None, T[0]), ("", T[0]), ("k" * 50_000, T[0])]
    refs = spark.createDataFrame([("t", i, *x, "clash", 1) for i, x in enumerate(refs)], R)
    want = [("t", 2, "deleted"), ("t", 3, "later"), ("t", 7, "missing"), ("t", 9, "missing"), ("t", 10, "missing")]
    assert got(refs, parents) == want
    assert got(refs, parents.limit(0)) == [("t", i, "missing") for i in (0, 1, 2, 3, 4, 5, 6, 7, 9, 10)]
    assert got(refs.limit(0), parents) == []


def test_hot_key_is_salted(spark):
    parents = spark.range(50).selectExpr("concat('k', id) key", "timestamp_ntz'2026-01-01' version_ts", "timestamp_ntz'2026-01-01' since", "id % 5 = 0 gone", "'' digest")
    refs = spark.range(6000).selectExpr("'t' ref_table", "id ref_id", "if(id % 3 = 0, 'k0', concat('k', id % 70)) key", "cast(null as timestamp_ntz) ref_ts", "'' place", "1 gone")
    rows = find_orphans(refs, parents, rows_per_range=50).collect()
    want = {i for i in range(6000) if i % 3 == 0 or i % 70 >= 50 or i % 70 % 5 == 0}
    assert len(rows) == len(want) and {r.ref_id for r in rows} == want


def test_parent_with_many_states(spark):
    """A third of the parents' rows are states of one key; its latest one counts, here the living one."""
    parents = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 400)) key", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id) version_ts", "timestamp_ntz'2026-01-01' since", "id < 29000 and id % 3 = 0 gone", "'' digest")
    refs = spark.createDataFrame([("t", 1, "hot", T[2], "", 1), ("t", 2, "k1", T[2], "", 1), ("t", 3, "none", T[2], "", 1)], R)
    assert got(refs, parents) == [("t", 3, "missing")]


def test_salts_bound_the_largest_task(spark):
    """The rows of a place stay within twice its share at three sizes, though half of them name one key."""
    from cairn.operators import orphans

    largest = []
    seen = orphans._probe_stream
    try:
        orphans._probe_stream = lambda batches: (pa.RecordBatch.from_arrays([pa.array(["p"] * n), b["place"].value_counts().field(1).cast(pa.int64()), pa.nulls(n, pa.timestamp("us")), pa.array([""] * n)], schema=orphans._OUT_ARROW) for b in batches for n in [len(b["place"].value_counts())])
        for n in (4_000, 40_000, 400_000):
            parents = spark.range(n // 10).selectExpr("concat('k', id) key", "timestamp_ntz'2026-01-01' version_ts", "timestamp_ntz'2026-01-01' since", "false gone")
            refs = spark.range(n).selectExpr("'t' ref_table", "id ref_id", f"if(id % 2 = 0, 'k0', concat('k', id % {n // 8})) key", "timestamp_ntz'2026-01-02' ref_ts")
            largest.append(find_orphans(refs, parents, rows_per_range=1000).agg({"ref_id": "max"}).first()[0])
    finally:
        orphans._probe_stream = seen
    assert max(largest) <= 2 * 1000 * 1.6 and largest[2] <= 1.2 * largest[1]


def test_two_keys_of_one_digest():
    t = pa.table({"digest": [5, 5, 7], "key": ["a", "b", "c"], "ts": pa.array([0, 0, 0], pa.timestamp("us")), "since": pa.array([0, 9, 0], pa.timestamp("us")), "gone": [False, False, False]})
    refs = pa.table({"digest": [5, 5, 5, 7, 8], "key": ["a", "b", "x", "c", "c"], "ts": pa.array([1, 1, 1, 1, 1], pa.timestamp("us"))})
    assert _Parents([t]).probe(refs).tolist() == [0, 3, 1, 0, 1]
