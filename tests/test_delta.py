import random

import pytest

from cairn.operators import delta as D

S = "file_id string, id string, name string, kind string, lo int, hi int"


def brute(old, new):
    """Names alone on both sides first, then all pairs in order of overlap."""
    out, keys = set(), {(x[0], x[2], x[3]) for x in old} & {(x[0], x[2], x[3]) for x in new}
    for k in keys:
        a, b = ([x for x in side if (x[0], x[2], x[3]) == k] for side in (old, new))
        how = "name" if len(a) == len(b) == 1 else "overlap"
        pairs = sorted((-max(0, min(x[5], y[5]) - max(x[4], y[4]) + 1), abs(x[4] - y[4]), x[1], y[1]) for x in a for y in b)
        while pairs:
            _, _, i, j = pairs[0]
            out.add((i, j, how))
            pairs = [p for p in pairs if p[2] != i and p[3] != j]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_taking_the_best_pair_again_and_again(spark, seed):
    r = random.Random(seed)

    def side(p):
        out = []
        for i in range(120):
            lo = r.randrange(60)
            out.append((r.choice("fg"), f"{p}{i:03}", r.choice(["a", "b", "c", "d", f"u{i}"]), r.choice(["function", "class"]), lo, lo + r.randrange(9)))
        return out

    old, new = side("o"), side("n")
    got = {tuple(x) for x in D.match_symbols(spark.createDataFrame(old, S), spark.createDataFrame(new, S)).collect()}
    assert got == brute(old, new) and {h for *_, h in got} == {"name", "overlap"}


def test_matching_refuses_rather_than_cuts(spark):
    d = spark.createDataFrame([("f", str(i), "a", "class", 1, 2) for i in range(4)], S)
    assert D.match_symbols(d, d.limit(0)).isEmpty()
    with pytest.raises(ValueError, match="4 and 4 times"):
        D.match_symbols(d, d, most_pairs=15)


def test_index_symbols(spark):
    sym = spark.createDataFrame(
        [("f", "1", "load", "function", 1, 9), ("f", "2", "load", "method", 20, 29), ("f", "3", "load", "method", 40, 49), ("f", "4", "Box", "class", 60, 90), ("g", "5", "load", "method", 1, 9), ("f", "6", "size", "variable", 1, 1), (None, "7", "load", "method", 1, 1)], S
    )
    p = "scip-x npm pkg 1.0 src/a.ts/"
    rows = [
        ("f", p + "Box#load().", "method", 41, 43), ("f", p + "Box#", "class", 60, 60), ("f", p + "Box#size.", "class", 1, 1), ("f", p + "load().", "type", 2, 3),
        ("g", p + "load().", "method", 1, 1), ("f", p + "none().", "method", 1, 1), ("f", "local 3", "method", 1, 1), ("f", "odd", "method", 1, 1), ("f", p + "Box#load().", "method", 45, 46), (None, p + "load().", "method", 1, 1), ("f", "", "method", 1, 1),
    ]
    d = spark.createDataFrame(rows, "file_id string, index_symbol string, kind string, lo int, hi int")
    got = {(r.file_id, r.index_symbol.removeprefix(p), r.id, r.how) for r in D.match_index_symbols(d, sym).collect()}
    assert got == {("f", "Box#load().", "3", "exact"), ("f", "Box#", "4", "exact"), ("f", "Box#size.", "6", "nameOnly"), ("f", "load().", "1", "nameOnly"), ("g", "load().", "5", "exact")}
    assert D.match_index_symbols(d.limit(0), sym).isEmpty()
