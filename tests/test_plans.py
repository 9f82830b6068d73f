import random
from datetime import datetime

import pytest

from cairn.plans import graphs as Q

AT = datetime(2024, 1, 1)


def index(spark, root, edges, deleted=(), alone=()):
    """A code index of one repository: ``edges`` of src, dst, type."""
    ids = sorted({x for e in edges for x in e[:2]} | set(alone))
    spark.createDataFrame([(x, "r", x, AT, AT if x in deleted else None) for x in ids], "symbol_id string, repo_id string, name string, updated_at timestamp, deleted_at timestamp").write.parquet(f"{root}/symbols.parquet")
    spark.createDataFrame([(f"e{i}", a, b, t, 1.0, 1.0, "exact", AT) for i, (a, b, t) in enumerate(edges)], "edge_id string, from_symbol_id string, to_symbol_id string, edge_type string, weight double, confidence double, resolution string, created_at timestamp").write.parquet(f"{root}/depends_on.parquet")
    return str(root)


def brute_distance(pairs, start):
    out, at, d = {start: 0}, {start}, 0
    while at:
        d += 1
        at = {b for a, b in pairs if a in at} - out.keys()
        out |= dict.fromkeys(at, d)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_go_twelve_hops_and_name_their_nodes(spark, tmp_path, seed):
    r = random.Random(seed)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)]
    pairs = [*chain, *((f"n{a:02}", f"n{a - r.randrange(1, 9):02}") for a in range(9, 15)), ("n00", "m"), ("m", "n02")]
    targets = {f"n{i:02}" for i in range(15)} | {"off"}
    root = index(spark, tmp_path, [(a, b, "call") for a, b in pairs], targets, ["off"])
    far = brute_distance(pairs, "m")
    got = {x.b: x for x in Q.shortest_paths(spark, root).collect()}
    assert got.keys() == targets and {x.a for x in got.values()} == {"m"}
    for b, x in got.items():
        assert x.n == (far[b] if far.get(b, 99) <= 12 else None)
        if x.n is None:
            assert x.path is None
        else:
            way = x.path.split(">")
            assert (way[0], way[-1], len(way)) == ("m", b, x.n + 1) and set(zip(way, way[1:])) <= set(pairs)
    assert max(x.n or 0 for x in got.values()) == 12


def test_components_follow_calls(spark, tmp_path):
    r = random.Random(3)
    edges = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}", r.choice(["call", "call", "implements", "import"])) for _ in range(45)]
    nodes = [f"n{i:02}" for i in range(42)]
    near = {x: {x} for x in nodes}
    for a, b, t in edges:
        if t == "call":
            near[a].add(b)
            near[b].add(a)
    want = {x: min(brute_distance([(a, b) for a in near for b in near[a]], x)) for x in nodes}
    assert {x.id: x.component for x in Q.call_components(spark, index(spark, tmp_path, edges, alone=nodes)).collect()} == want
