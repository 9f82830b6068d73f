import random

import pytest

from cairn.llm.topn import local_firsts, symbol_scores, top_n

SCHEMA = "f string, s double, i bigint, id string, rank string"


def brute(rows, n):
    by = {}
    for f, s, i, x, _ in rows:
        if f is not None:
            s = 0.0 if s is None or s != s else s
            by.setdefault(f, []).append((-s, -(i or 0), x is None, x or "", x))
    return sorted((f, *map(str, (r[4],))) for f, v in by.items() for r in sorted(v)[:n])


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_sorting(spark, parts):
    r = random.Random(parts)
    nan = float("nan")
    rows = [(r.choice(["hot", "hot", None, *"abcdefgh"]), r.choice([None, nan, 0.0, 0.5, r.random()]), r.choice([None, 0, 3, r.randrange(9)]), f"x{k:04d}", "clash") for k in range(4000)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = top_n(d, "f", "s", "i", "id", 5).collect()
    assert sorted((x.f, x.id) for x in got) == brute(rows, 5)
    assert {x["rank"] for x in got} == {1, 2, 3, 4, 5}


def test_repeats_ties_and_null_ids(spark):
    rows = [("a", 1.0, 1, "x", ""), ("a", 1.0, 1, "x", ""), ("a", 1.0, 1, None, ""), ("b", None, None, "y", "")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((x.f, x["rank"], x.id) for x in top_n(d, "f", "s", "i", "id", 2).collect()))
    assert got == [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")]
    assert top_n(d.limit(0), "f", "s", "i", "id", 2).isEmpty()


def test_bounds_of_every_group(spark):
    d = spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', concat('g', id % 5000)) grp", "double(id) a", "id b", "string(id) tie").coalesce(1)
    rows = local_firsts(d, 3).where("pos = 2").collect()
    assert len(rows) == 2501 and max(r.a for r in rows) == 39_994 and next(r for r in rows if r.grp == "hot").a == 39_994


def test_extreme_seconds_and_null_groups(spark):
    low, high = -(2**63), 2**63 - 1
    d = spark.createDataFrame([("a", 0.0, low, "x", ""), ("a", -0.0, high, None, ""), ("a", 0.0, high, "y", ""), (None, 9.0, 1, "z", "")], SCHEMA)
    assert [(r.f, r.i, r.id) for r in sorted(top_n(d, "f", "s", "i", "id", 2).collect(), key=lambda r: r["rank"])] == [("a", high, "y"), ("a", high, None)]


def test_scores(spark):
    import datetime as dt

    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    s = spark.createDataFrame([("a", "f", t[0]), ("a", "f", t[1]), ("b", None, t[0]), ("c", "f", t[0]), (None, "f", t[0])], "symbol_id string, file_id string, updated_at timestamp_ntz")
    m = spark.createDataFrame([("a", 0.1, 1, t[0]), ("a", 0.9, 2, None), ("b", 0.5, 1, t[0]), ("d", 0.5, 1, t[0])], "symbol_id string, page_rank double, fan_in bigint, updated_at timestamp_ntz")
    assert [tuple(r) for r in symbol_scores(s, m).collect()] == [("f", "a", 0.1, 1)]
