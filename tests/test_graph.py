import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import budget as B
from cairn.operators import graph as G
from cairn.operators import joins as J


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(x,) for x in names], "id string")


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "x"), ("a", "b"), (None, "a")]


def test_reach_and_paths(spark):
    e = edges(spark, DIAMOND)
    out = {r.id: r.distance for r in G.reachable(e, ids(spark, ["a", "a", None]), 5, direction="out").collect()}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 2}
    back = {r.id: r.path for r in G.impact_paths(e, ids(spark, ["d"]), 2).collect()}
    assert back == {"d": ["d"], "b": ["d", "b"], "c": ["d", "c"], "a": ["d", "b", "a"]}
    assert G.reachable(e.limit(0), ids(spark, ["a"]), 3).count() == 1 and G.reachable(e, ids(spark, []), 3).isEmpty()
    pairs = spark.createDataFrame([("a", "d"), ("d", "c"), ("a", "x"), ("a", "a")], "a string, b string")
    assert {(r.a, r.b): r.n for r in G.shortest_lengths(e, pairs, 4).collect()} == {("a", "d"): 2, ("d", "c"): 2, ("a", "x"): None, ("a", "a"): 0}


def test_page_rank(spark):
    e, n = edges(spark, DIAMOND), ids(spark, ["a", "b", "c", "d", "x", "alone"])
    got = {r.id: r.score for r in G.page_rank(n, e, 7).collect()}
    out = {k: [b for a, b in DIAMOND if a == k] for k in got}
    want = dict.fromkeys(got, 1 / 6)
    for _ in range(7):
        new = dict.fromkeys(want, 0.15 / 6)
        for k, v in want.items():
            for t in out[k] or list(want):
                new[t] += 0.85 * v / (len(out[k]) or 6)
        want = new
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(want)
    assert G.page_rank(n.limit(0), e).isEmpty()


def brute_core(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        x = min(near, key=lambda v: (len(near[v]), v))
        k = max(k, len(near[x]))
        core[x] = k
        for y in near.pop(x):
            near[y].discard(x)
    return core


@pytest.mark.parametrize("seed", [1, 2])
def test_coreness_and_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)]
    nodes = [f"n{i}" for i in range(42)]
    got = {x.id: x.coreness for x in G.k_core(ids(spark, nodes), edges(spark, pairs)).collect()}
    assert got == {n: brute_core(pairs).get(n, 0) for n in nodes}
    sparse = pairs[:25]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sparse:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {x.id: x.component for x in G.components(edges(spark, sparse)).collect()} == {n: find(n) for n in {y for p in sparse for y in p}}


def test_label_propagation():
    one = [("a", "b"), ("b", "c"), ("a", "c")]
    two = [("x", "y"), ("y", "z"), ("x", "z")]
    got = G.propagate_labels([*one, *two])
    assert {got[x] for x in "abc"} == {"a"} and {got[x] for x in "xyz"} == {"x"}


def test_traces_are_preorder(spark):
    e = spark.createDataFrame([("r", a, b) for a, b in DIAMOND if a], "p string, src string, dst string")
    t = G.trace_flows(e, spark.createDataFrame([("r", "a")], "p string, id string"), "p", 20)
    assert [(x.id, x.step, x.depth) for x in t.orderBy("step").collect()] == [("a", 0, 0), ("b", 1, 1), ("d", 2, 2), ("c", 3, 1)]


def test_nearest_seed(spark):
    e = spark.createDataFrame([("t", "a", 1.0), ("a", "b", 2.0), ("t", "b", 4.0), ("u", "b", 3.0), ("b", "far", 20.0), ("far", "out", 1.0)], "src string, dst string, cost double")
    got = {r.id: (r.distance, r.seed) for r in G.nearest_seed(e, ids(spark, ["t", "u"]), 12.0, 6).collect()}
    assert got == {"t": (0.0, "t"), "u": (0.0, "u"), "a": (1.0, "t"), "b": (3.0, "t"), "far": (23.0, "t")}


def test_walk_mass(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 1.0)], "id string, weight double")
    got = {r.id: r.score for r in G.personal_rank(e, seeds, 0.5, 6).collect()}
    assert got["a"] > got["c"] > 0 and sum(got.values()) <= 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_budget_equals_the_loop(spark, seed):
    r = random.Random(seed)
    items = [(r.randrange(3), i, r.choice([None, -1, 0, 5, 30, 70, 200])) for i in range(300)]
    df = spark.createDataFrame(items, "p int, i int, size int")
    got = {x.i for x in B.greedy_budget(df, ["p", "i"], "size", 12, 150).where("kept").collect()}
    used, want = 0, set()
    for _, i, n in sorted(items):
        n = 50 if n is None else max(0, n)
        if len(want) < 12 and used + n <= 150:
            want.add(i)
            used += n
    assert got == want


def test_overlaps(spark):
    r = random.Random(5)
    spans = [("f", f"s{i}", a, a + r.randrange(700)) for i, a in enumerate(r.choices(range(1500), k=40))] + [("f", "bad", 9, 3), ("f", "null", None, 4)]
    probes = [("f", f"p{i}", a, a + r.randrange(40)) for i, a in enumerate(r.choices(range(1500), k=30))]
    s, p = spark.createDataFrame(spans, "f string, id string, lo int, hi int"), spark.createDataFrame(probes, "f string, id string, lo int, hi int")
    got = [(x.s_id, x.q_id) for x in J.overlap_join(s, p, "f").collect()]
    want = {(a[1], b[1]) for a in spans[:40] for b in probes if a[2] <= b[3] and b[2] <= a[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_dense_ids(spark):
    e = edges(spark, [("b", "a"), ("c", "b")])
    got = {(x.from_index, x.to_index) for x in J.encode_ids(e, ids(spark, ["c", "a", "b", "a"])).collect()}
    assert got == {(1, 0), (2, 1)}


def test_local_clusters_refuse_rather_than_cut(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c")], "p string, src string, dst string")
    with pytest.raises(Exception, match="spread_labels"):
        G.local_clusters(e, "p", most_edges=1).collect()
    assert G.spread_labels(e).select(F.countDistinct("label")).first()[0] >= 1


N = lambda score=1.0, tokens=50, signal=0.0, boost=0.0, external=False: (score, signal, boost, tokens, external)
CALLS = lambda *ys: [(y, "call", 1.0) for y in ys]


def took(out, nodes, starts, **limits):
    return [x for x, _ in B.best_first(out, nodes, starts, **limits)]


def test_slice_from_several_starts_shares_one_frontier():
    nodes = {x: N(0.9 if x == "b1" else 0.5) for x in ("a", "b", "a1", "b1")}
    assert took({"a": CALLS("a1"), "b": CALLS("b1")}, nodes, [("a", "entrySymbol"), ("b", "stackTrace"), ("lost", "entrySymbol"), ("a", "taskText")]) == ["a", "b", "b1", "a1"]
    assert took({"a": CALLS("a1")}, nodes, [("b", "taskText"), ("a", "editedFile")]) == ["a", "b", "a1"]


def test_slice_takes_the_card_back_that_exceeds_the_tokens():
    nodes = {"s": N(), "a": N(0.9, 100), "b": N(0.5, 10)}
    assert took({"s": CALLS("a", "b")}, nodes, [("s", "entrySymbol")], max_tokens=120) == ["s"]
    assert took({"s": CALLS("a", "b")}, nodes, [("s", "entrySymbol")], max_tokens=150) == ["s", "a"]


def test_slice_asks_for_more_confidence_as_tokens_go():
    out = {"s": [("a", "call", 0.6), ("b", "call", 0.4)], "a": [("c", "call", 0.7), ("d", "call", 0.85)]}
    nodes = dict.fromkeys("sabcd", N())
    assert took(out, nodes, [("s", "entrySymbol")]) == ["s", "a", "d", "c"]
    assert took(out, nodes | {"s": N(tokens=701)}, [("s", "entrySymbol")], max_tokens=1000) == ["s", "a", "d"]
    # A neighbour is looked at once: a weak edge hides it from a better one.
    assert took({"s": [("a", "call", 0.9), ("b", "call", 0.1)], "a": CALLS("b")}, nodes, [("s", "entrySymbol")]) == ["s", "a"]


def test_slice_ends_after_five_below_the_threshold():
    nodes = {f"t{i}": N() for i in range(9)} | {"x": N()}
    starts = [(f"t{i}", "taskText") for i in range(9)]
    assert took({}, nodes, starts, threshold=0.7) == []
    assert took({}, nodes, [*starts, ("x", "editedFile")], threshold=2.0) == ["x"]


def test_slice_strengths_boosts_imports_and_leaves():
    out = {"s": [("a", "import", 1.0), ("b", "implements", 1.0), ("c", "odd", 1.0), ("d", "import", 1.0), ("e", "call", 1.0)], "e": CALLS("f")}
    nodes = {"s": N(), "a": N(0.5), "b": N(0.5), "c": N(0.3), "d": N(0.1), "e": N(external=True), "f": N()}
    got = dict(B.best_first(out, nodes, [("s", "entrySymbol")]))
    assert got == pytest.approx({"s": 1.4, "e": 0.0, "b": 0.45, "a": 0.3, "d": 0.2})
    assert "d" not in took(out, nodes, [("s", "stackTrace")])
    near = {"s": N(), "a": N(0.5), "b": N(0.5, signal=1.0), "c": N(0.4, boost=0.15)}
    assert took({"s": CALLS("a", "b", "c")}, near, [("s", "entrySymbol")]) == ["s", "c", "b", "a"]


def test_slice_cap_tightens_after_a_drop():
    nodes = {x: N(0.9) for x in "sabcdef"} | {"g": N(0.25)}
    assert took({"s": CALLS(*"abcdefg")}, nodes, [("s", "entrySymbol")]) == ["s", *"abcdef", "g"]  # seen only while cards are expanded
    assert took({"s": CALLS(*"abcde", "g"), "e": CALLS("f")}, nodes | {"f": N(0.21)}, [("s", "entrySymbol")]) == ["s", *"abcde"]
    assert took({"s": CALLS(*"abcdefg")}, nodes, [("s", "entrySymbol")], max_cards=3) == ["s", "a", "b"]


def plain_slice(out, nodes, starts, most, frontier):
    """The same by sorting all that is open in every step, without the tightened cap's short cuts."""
    entries, left, seen, taken, used, n, low, cap = {x for x, s in starts if s == "entrySymbol"}, [], set(), [], 0, 0, 0, 60
    for x, s in starts:
        if x not in seen:
            left.append((-B.START_WORTH[s], 0, n, x))
            seen.add(x)
            n += 1
    while left and len(taken) < cap:
        left.sort()
        need = B.adaptive_confidence(0.5, used, most)
        worth, _, _, x = left.pop(0)
        if -worth < 0.2:
            low += 1
            if low == 5:
                break
            continue
        low, used = 0, used + nodes[x][3]
        if used > most:
            break
        taken.append((x, -worth))
        fresh = {y: (k, c) for y, k, c in out.get(x, []) if y not in seen}
        for y, (k, c) in fresh.items():
            seen.add(y)
            v = nodes[y][0] * B.EDGE_STRENGTH.get(k, 0.5) * c + nodes[y][2] + 0.001 * nodes[y][1]
            v = max(v, 0.2) if k == "import" and x in entries else v
            if c >= need and v >= 0.2:
                left = sorted([*left, (-v, 10, n, y)])[:frontier]
                n += 1
        if fresh and left and len(taken) >= max(6, len(entries) + 2):
            v = [t[1] for t in taken]
            if sum(t >= 0.4 for t in v) >= 0.6 * len(v) and len(entries & {t[0] for t in taken}) >= 0.9 * len(entries) and -min(left)[0] < max(0.28, 0.67 * sum(v[-6:]) / len(v[-6:])):
                cap = len(taken)
    return taken


@pytest.mark.parametrize("seed", range(30))
def test_slices_equal_a_plain_scan(seed):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(60)]
    out = {x: sorted((y, r.choice(["call", "import", "config", "odd"]), r.choice([0.3, 0.6, 0.85, 1.0])) for y in r.sample(names, r.randrange(9))) for x in names}
    nodes = {x: N(r.random(), r.randrange(50, 300), r.random(), r.choice([0.0, 0.05, 0.15])) for x in names}
    starts = [(x, r.choice(["entrySymbol", "stackTrace", "taskText"])) for x in r.sample(names, 4)]
    short = lambda cards: [(x, round(v, 9)) for x, v in cards]
    assert short(B.best_first(out, nodes, starts, max_tokens=4000, frontier=7)) == short(plain_slice(out, nodes, starts, 4000, 7))


def test_slices_of_tables(spark):
    e = spark.createDataFrame([("r", "s", "a", "call", None), ("r", "s", "b", "call", float("nan")), ("q", "x", "y", "call", 1.0)], "p string, src string, dst string, edge_type string, confidence double")
    n = spark.createDataFrame([("r", "s", 1.0), ("r", "a", 0.5), ("r", "b", 0.9), ("q", "x", 1.0), ("r", "idle", None)], "p string, id string, score double").selectExpr("*", "cast(null as double) signal", "0.0 boost", "cast(null as int) tokens", "false external")
    s = spark.createDataFrame([("r", "s", "entrySymbol"), ("r", "s", "taskText"), (None, "s", "taskText"), ("r", None, "taskText")], "p string, id string, source string")
    assert [(r.p, r.id, r.pos) for r in B.beam_slices(e, s, n, "p").orderBy("pos").collect()] == [("r", "s", 0), ("r", "b", 1), ("r", "a", 2)]
    assert B.beam_slices(e, s.limit(0), n, "p").isEmpty()
    with pytest.raises(ValueError, match="more than 1"):
        B.beam_slices(e, s, n, "p", most_edges=1)


def test_nearest_seed_goes_on_until_nothing_improves(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(14)]
    e = spark.createDataFrame(chain, "src string, dst string, cost double")
    got = {r.id: r.distance for r in G.nearest_seed(e, ids(spark, ["n00"]), 12.0).collect()}
    assert got == {f"n{i:02}": float(i) for i in range(13)}


def test_hot_nodes_are_spread(spark):
    """Half of the edges end in one node: its partition is not larger than the others, and nothing is lost."""
    from pyspark.sql import functions as F

    from cairn.session import held

    e = spark.range(8000).selectExpr("concat('s', id) src", "if(id % 2 = 0, 'hub', concat('d', id % 1500)) dst")
    side = e.select("dst").distinct().withColumn("x", F.length("dst"))
    with held(e, "dst", least=50) as placed:
        sizes = [r["count"] for r in placed.rows.groupBy(F.spark_partition_id()).count().collect()]
        got = placed.meet(side)
        assert got.count() == 8000 and got.agg(F.sum("x")).first()[0] == e.select(F.sum(F.length("dst"))).first()[0]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    with held(e, "dst", least=10_000) as placed:
        assert placed.meet(side).count() == 8000


def plain_modularity(edges, label):
    m = sum(w for _, _, w in edges)
    tot, inside = {}, 0.0
    for a, b, w in edges:
        inside += w * (label[a] == label[b])
        for x in (a, b):
            tot[label[x]] = tot.get(label[x], 0.0) + w
    return inside / m - sum(v * v for v in tot.values()) / (4 * m * m)


def test_communities_raise_modularity(spark):
    r = random.Random(4)
    names = [f"{g}{i:02}" for g in "abcd" for i in range(12)]
    edges = [(x, y, 1.0) for i, x in enumerate(names) for y in names[:i] if r.random() < (0.6 if x[0] == y[0] else 0.03)]
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    got = {x.id: x.label for x in G.communities(df).collect()}
    planted = {x: x[0] for x in got}
    assert G.modularity(df, spark.createDataFrame(list(got.items()), "id string, label string")) == pytest.approx(plain_modularity(edges, got))
    assert plain_modularity(edges, got) >= plain_modularity(edges, planted) - 0.02 and 3 <= len(set(got.values())) <= 6
    assert all(got[v] == v for v in got.values()) and got == {x.id: x.label for x in G.communities(df.repartition(7)).collect()}


def test_communities_of_small_graphs(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x"), ("a", "b"), ("s", "s"), (None, "a")]
    df = spark.createDataFrame([(*p, 1.0) for p in pairs] + [("a", "z", 0.0), ("a", "z", None)], "src string, dst string, w double")
    got = {x.id: x.label for x in G.communities(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "s": "s"}
    assert G.communities(df.limit(0)).isEmpty() and G.modularity(df.limit(0), spark.createDataFrame([], "id string, label string")) == 0
