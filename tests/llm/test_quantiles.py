import random

import numpy as np
import pytest

from cairn.llm import quantiles as K

PS = [0.01, 0.25, 0.5, 0.9, 0.99]


def errors(sketch, values):
    values = np.sort(values)
    out = []
    for p, v in zip(PS, sketch.quantiles(PS)):
        low, high = np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)
        out.append(max(0, low - p, p - high))
    return out


@pytest.mark.parametrize("shape", ["uniform", "sorted", "tail", "ties"])
def test_rank_error_is_bounded(shape):
    r = np.random.default_rng(4)
    bad = 0
    for seed in range(60):
        x = r.random(20_000) if shape != "tail" else r.pareto(1, 20_000)
        x = np.sort(x) if shape == "sorted" else np.round(x * 5) if shape == "ties" else x
        s = K.Sketch(100, seed)
        s.add(x)
        bad += max(errors(s, x)) > K.rank_error(100)
        assert s.n == len(x) and sum(len(v) << h for h, v in enumerate(s.levels)) == len(x) and sum(map(len, s.levels)) < 600
    assert bad <= 3  # of 60 sketches with five percentiles each


def test_merging_keeps_the_bound():
    r, bad = np.random.default_rng(5), 0
    for seed in range(40):
        x = r.normal(size=24_000)
        total = K.Sketch(100, seed)
        for i, part in enumerate(np.split(np.sort(x), 24)):  # days that do not overlap
            s = K.Sketch(100, 1000 * seed + i)
            s.add(part)
            total.merge(s.n, s.low, s.high, s.levels)
        bad += max(errors(total, x)) > K.rank_error(100)
        assert total.n == len(x) and total.quantiles([0.0, 1.0]) == [x.min(), x.max()]
    assert bad <= 2


def test_small_groups_are_exact():
    s = K.Sketch(400, 1)
    s.add(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0, 0.5, 0.34, 1]) == [1.0, 2.0, 2.0, 3.0]


def result(spark, d, keys, **kw):
    return {(*(r[k] for k in keys), r.p): (r.n, r.value) for r in K.sketch_quantiles(K.merge_sketches(K.sketch_parts(d, keys, **kw), keys), keys, [0.5]).collect()}


def test_cases(spark):
    nan = float("nan")
    d = spark.createDataFrame([("a", None, 1.0, 9), ("a", None, nan, 9), ("a", None, None, 9), ("a", "x", 5.0, 9), ("a", "x", 7.0, 9), ("a", "x", 5.0, 9), ("b", "x", nan, 9)], "g string, h string, value double, n int")
    want = {("a", None, 0.5): (1, 1.0), ("a", "x", 0.5): (3, 5.0)}
    assert result(spark, d, ["g", "h"]) == want and result(spark, d, ["g", "h"], most_groups=0) == want
    assert result(spark, d.limit(0), ["g", "h"]) == {}


def test_hot_group_and_days(spark):
    r = random.Random(2)
    d = spark.createDataFrame([(str(i % 7), "hot" if i % 3 else f"g{i % 11}", r.gauss(0, 1)) for i in range(30_000)], "day string, g string, value double").repartition(9)
    days = K.merge_sketches(K.sketch_parts(d, ["day", "g"]), ["day", "g"], fan_in=2)
    got = {x.g: (x.n, x.value) for x in K.sketch_quantiles(K.merge_sketches(days, ["g"], fan_in=2), ["g"], [0.5]).collect()}
    assert got["hot"][0] == 20_000 and abs(got["hot"][1]) < 0.05
    again = {x.g: (x.n, x.value) for x in K.sketch_quantiles(K.merge_sketches(days, ["g"], fan_in=2), ["g"], [0.5]).collect()}
    assert got == again


def test_many_parts_merge_in_rounds(spark, monkeypatch):
    """A group with far more parts than shuffle partitions, as a scan of many splits gives."""
    r = np.random.default_rng(7)
    x = r.normal(size=60_000)
    parts = spark.createDataFrame([(None if i % 2 else "g", float(v)) for i, v in enumerate(x)], "g string, value double").repartition(40)
    rows = K.sketch_parts(parts, ["g"], k=50, most_groups=0)
    assert rows.count() > 60
    rounds, cut = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df: rounds.append(1) or cut(df))
    got = {v.g: v for v in K.sketch_quantiles(K.merge_sketches(rows, ["g"], k=50, fan_in=4), ["g"], [0.0, 0.5, 1.0], k=50).where("p = 0.5").collect()}
    assert len(rounds) >= 3 and set(got) == {None, "g"}
    for g, part in ((None, x[1::2]), ("g", x[::2])):
        assert got[g].n == 30_000 and abs((part <= got[g].value).mean() - 0.5) < K.rank_error(50)


def test_small_and_large_groups_in_one_partition(spark):
    d = spark.range(300_000).selectExpr("concat('g', if(id % 3 = 0, 0, id % 9000)) g", "cast(id as double) value").coalesce(1)
    got = {x.g: (x.n, x.value) for x in K.sketch_quantiles(K.sketch_parts(d, ["g"], most_groups=100_000), ["g"], [0.5]).collect()}
    assert len(got) == 6001 and got["g0"][0] == 100_000 and abs(got["g0"][1] / 300_000 - 0.5) < K.rank_error(400)
    assert got["g1"] == (34, float(1 + 9000 * 16))
