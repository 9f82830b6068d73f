import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import aggregates as A
from cairn.operators import excerpts as X


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_line_delta_rebuilds_the_new_text(spark, a, b):
    old, new = "\n".join(a), "\n".join(b)
    r = spark.createDataFrame([(old, new)], "o string, n string").select(X.line_delta(F.col("o"), F.col("n")).alias("d")).first().d
    lines = old.split("\n")
    assert lines[: r.line - 1] + r.added + lines[r.line - 1 + len(r.removed) :] == new.split("\n")
    assert lines[r.line - 1 : r.line - 1 + len(r.removed)] == r.removed
    if old == new:
        assert r.added == r.removed == []


def test_null_texts(spark):
    r = spark.createDataFrame([(None, "a\nb"), (None, None)], "o string, n string").select(X.line_delta(F.col("o"), F.col("n")).alias("d")).collect()
    assert (r[0].d.added, r[0].d.removed) == (["a", "b"], []) and r[1].d.added == r[1].d.removed == []


def test_excerpts(spark):
    text = "\n".join(f"line {i}" + (" Token" if i in (3, 4, 20) else "") for i in range(1, 31))
    d = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k int, t string")
    got = [(r.k, r["first"], r["last"]) for r in X.excerpts(d, "k", "t", ["token"], around=2).collect()]
    assert got == [(1, 1, 6), (1, 18, 22)]
    tight = [(r["first"], r["last"]) for r in X.excerpts(d, "k", "t", ["token"], around=2, most_lines=4).collect()]
    assert tight == [(2, 4), (20, 20)]
    assert X.excerpts(d.limit(0), "k", "t", ["x"]).isEmpty()


def test_excerpts_pass_over_what_does_not_fit(spark):
    long = "token " * 20
    d = spark.createDataFrame([(1, "\n".join([long, "a", "b", "token", "c", long, "token"])), (2, long), (3, f"{long}\nx")], "k int, t string")
    got = [(r.k, r["first"], r["last"]) for r in X.excerpts(d, "k", "t", ["token"], around=1, most_tokens=10).collect()]
    assert got == [(1, 2, 5), (1, 7, 7), (3, 2, 2)]


def test_windows_and_truncation(spark):
    d = spark.createDataFrame([("1\n2\n3\n4\n5\n6", 1), ("1\n2", 2)], "t string, c int")
    assert [r.x for r in d.select(X.line_window(F.col("t"), F.col("c"), 3).alias("x")).collect()] == ["1\n2\n3", "1\n2"]
    s = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    for keep, want in (("start", [0, 1, 2]), ("end", [7, 8, 9]), ("both", [0, 1, 9])):
        assert sorted(r.i for r in X.truncated(s, ["g"], ["i"], 3, keep).collect()) == want


def test_packed_rows_round_trip(spark):
    d = spark.createDataFrame([(1, 'a "b", c', None), (2, "", 1.5), (3, None, -0.25)], "k int, t string, v double")
    back = X.unpack_rows(X.pack_rows(d, d.columns), "k int, t string, v double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))


@pytest.mark.parametrize(
    "text, want",
    [
        ("npm pkg lib 1.2 src/`a.ts`/f().", ("npm", "pkg", "lib", "1.2", "src/`a.ts`/f().", "method")),
        ("npm pkg my  lib 1.2 A#", ("npm", "pkg", "my lib", "1.2", "A#", "type")),
        ("local 7", ("local", None, None, None, "7", "local")),
        ("broken", None),
        (None, None),
    ],
)
def test_symbols(spark, text, want):
    r = spark.createDataFrame([(text,)], "c string").select(X.parse_symbol(F.col("c")).alias("x")).first().x
    assert (tuple(r) if r else None) == want


def test_test_cases(spark):
    rows = spark.createDataFrame([('{"name":" n ","suite":"","line":3}',), ('{"suite":"s"}',), ("bad",), (None,)], "c string").select(X.test_case(F.col("c")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in rows] == [("n", None, 3), None, None, None]


def test_numbers_follow_the_order(spark):
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 k").repartition(5)
    assert all(r.n == r.k + 1 for r in A.numbered(d, ["k"], "n").collect())


def test_digest_of_a_group_is_the_joined_one(spark):
    import hashlib

    rows = [("v1", f"s{i:03d}", f"f{i}" if i % 5 else None, "p") for i in range(50)] + [("v2", "a", "x", None)]
    got = {r.v: r.digest for r in A.ordered_digest(spark.createDataFrame(rows, "v string, k string, f string, b string").repartition(3), "v", "k", "f", "b").collect()}
    joined = "|".join(f"f{i}" if i % 5 else "" for i in range(50))
    assert got == {"v1": hashlib.sha256(f"p:{joined}".encode()).hexdigest(), "v2": hashlib.sha256(b"none:x").hexdigest()}
