"""Graph algorithms as loops of joins, and the order-dependent ones on bounded groups.

Edges are DataFrames of src and dst. A loop's state is cut by a checkpoint in the shared
folder every round, so plans stay short and a lost executor costs one round. Frontiers are
distinct before each join, partial sums are combined before each shuffle, and edges that a
loop keeps placed spread a hot node over salts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, held, refuse_large


def reachable(edges: DataFrame, seeds: DataFrame, hops: int, *, direction: str = "in") -> DataFrame:
    """``id`` and least ``distance`` (0 for seeds) of nodes within ``hops`` against (``in``) or along (``out``) edges.

    Null ends are no edges; duplicate edges and seeds count once; a cycle is walked once.
    """
    near, far = {"in": ("dst", "src"), "out": ("src", "dst")}[direction]
    step = edges.select(F.col(near).alias("id"), F.col(far).alias("next")).where("id is not null and next is not null").distinct()
    seen = cut(seeds.select("id").where("id is not null").distinct().withColumn("distance", F.lit(0)))
    frontier = seen.select("id")
    step = cut(step)
    for d in range(1, hops + 1):
        found = step.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        found = cut(found.withColumn("distance", F.lit(d)))
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        frontier = found.select("id")
    return seen


def impact_paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``id``, ``distance`` and ``path`` from a seed to each dependent, the smallest of the shortest ones.

    A node's path extends the path of its smallest predecessor, so only one row a node moves.
    """
    step = cut(edges.select(F.col("dst").alias("at"), F.col("src").alias("id")).where("at is not null and id is not null").distinct())
    seen = cut(seeds.select("id").where("id is not null").distinct().withColumn("distance", F.lit(0)).withColumn("path", F.array("id")))
    frontier = seen
    for d in range(1, hops + 1):
        via = step.join(frontier.select(F.col("id").alias("at"), "path"), "at").join(seen.select("id"), "id", "left_anti")
        found = cut(via.groupBy("id").agg(F.min_by("path", "at").alias("p")).select("id", F.lit(d).alias("distance"), F.concat("p", F.array("id")).alias("path")))
        if found.isEmpty():
            break
        seen, frontier = seen.unionByName(found), found
    return seen


def shortest_lengths(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """``a``, ``b`` and the least number of edges from a to b (null beyond ``hops``).

    All pairs walk together: the frontier holds distinct (a, node).
    """
    step = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("src is not null and dst is not null").distinct())
    want = pairs.select("a", "b").distinct()
    seen = cut(want.select("a", F.col("a").alias("node"), F.lit(0).alias("n")).distinct())
    frontier = seen
    for d in range(1, hops + 1):
        found = step.join(frontier.select("a", "node"), "node").select("a", F.col("next").alias("node")).distinct().join(seen, ["a", "node"], "left_anti")
        frontier = cut(found.withColumn("n", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return want.join(seen.select("a", F.col("node").alias("b"), "n"), ["a", "b"], "left")


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 12) -> DataFrame:
    """``a``, ``b``, the least number ``n`` of edges from a to b and the nodes of one such ``path`` (null beyond ``hops``).

    Walks like ``shortest_lengths``; a node's path extends that of its smallest predecessor, so
    only one row a pair of start and node moves.
    """
    step = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).where("src is not null and dst is not null").distinct())
    want = pairs.select("a", "b").distinct()
    seen = cut(want.select("a", F.col("a").alias("node"), F.lit(0).alias("n"), F.array("a").alias("path")).distinct())
    frontier = seen
    for d in range(1, hops + 1):
        via = step.join(frontier.select("a", F.col("node").alias("at"), "path"), "at").join(seen.select("a", "node"), ["a", "node"], "left_anti")
        frontier = cut(via.groupBy("a", "node").agg(F.min_by("path", "at").alias("p")).select("a", "node", F.lit(d).alias("n"), F.concat("p", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return want.join(seen.select("a", F.col("node").alias("b"), "n", "path"), ["a", "b"], "left")


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """``id`` and ``score`` after a fixed number of rounds; scores sum to 1.

    Repeated edges count, edges with an end outside ``nodes`` do not, and what ends in nodes
    without outgoing edges is spread over all. A round shuffles the scores, not the edges.
    """
    nodes = cut(nodes.select("id").where("id is not null").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    inner = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    counted = inner.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    out = counted.groupBy("src").agg(F.sum("k").alias("out"))
    share = cut(counted.join(out, "src").select(F.col("src").alias("id"), "dst", (F.col("k") / F.col("out")).alias("share")))
    # Only nodes with edges are told apart: all others have the score of a node that nobody sends to.
    senders = cut(out.select(F.col("src").alias("id")))
    state, rest = senders.withColumn("score", F.lit(1.0 / n)), 0.0
    with held(share, "id") as share:
        for _ in range(iterations):
            got = cut(share.meet(state).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got")))
            # What the senders sent arrived; the rest of the total of 1 lay in dangling nodes.
            rest = (1 - damping + damping * (1 - (got.agg(F.sum("got")).first()[0] or 0.0))) / n
            state = senders.join(got, "id", "left").select("id", (rest + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
    if not iterations:
        return nodes.withColumn("score", F.lit(1.0 / n))
    return nodes.join(got, "id", "left").select("id", (rest + damping * F.coalesce("got", F.lit(0.0))).alias("score"))


def k_core(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """``id`` and ``coreness`` on the undirected simple graph of the nodes.

    Each node keeps an upper bound, at first its degree, and lowers it to the largest h such
    that h neighbours have a bound of h or more. All nodes move together; the bounds end at the
    coreness, usually after a few rounds. ``most`` rounds is a guard that raises if it is hit.
    """
    nodes = nodes.select("id").where("id is not null").distinct()
    inner = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").where("src <> dst")
    both = cut(inner.select("src", "dst").unionByName(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    state = cut(both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("h")))
    before = state.agg(F.sum("h")).first()[0]
    zero = F.lit(0).cast("bigint")
    with held(both, "dst") as both:
        for _ in range(most):
            # A node needs only the histogram of its neighbours' bounds.
            near = both.meet(state.select(F.col("id").alias("dst"), F.col("h").alias("b"))).groupBy("src", "b").agg(F.count(F.lit(1)).alias("c"))
            hist = near.groupBy(F.col("src").alias("id")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("b", "c")))).alias("hist"))
            # Walked downwards: the largest b that at least b neighbours reach. It never rises.
            best = F.aggregate("hist", F.struct(zero.alias("seen"), zero.alias("best")), lambda acc, x: F.struct((acc["seen"] + x["c"]).alias("seen"), F.greatest(acc["best"], F.least(x["b"], acc["seen"] + x["c"])).alias("best")))
            state = cut(hist.select("id", best["best"].alias("h")))
            after = state.agg(F.sum("h")).first()[0]
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"coreness did not settle in {most} rounds")
    return nodes.join(state, "id", "left").select("id", F.coalesce("h", F.lit(0)).alias("coreness"))


def personal_rank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, iterations: int = 10) -> DataFrame:
    """``id`` and ``score`` of a walk that restarts at the seeds with probability ``alpha``.

    ``edges``: src, dst, w; rows are normalised by source. ``seeds``: id, weight (sum 1). Fixed
    rounds of power iteration; the walk of a node without outgoing edges ends there.
    """
    e = edges.where("w > 0 and src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    share = cut(e.join(total, "src").select(F.col("src").alias("id"), "dst", (F.col("w") / F.col("t")).alias("share")))
    mass = cut(seeds.groupBy("id").agg(F.sum("weight").alias("r")))
    kept = mass
    with held(share, "id") as share:
        for _ in range(iterations - 1):
            mass = cut(share.meet(mass).groupBy(F.col("dst").alias("id")).agg(F.sum((1 - alpha) * F.col("r") * F.col("share")).alias("r")))
            kept = kept.unionByName(mass)
    return kept.groupBy("id").agg(F.sum(alpha * F.col("r")).alias("score"))


def weighted_adjacency(edges: DataFrame, reverse: float = 0.5) -> DataFrame:
    """src, dst, w: strengths (weight at least 0 times confidence in 0..1) summed, the way back at ``reverse``; no loops."""
    w = F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(1.0))) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(1.0))))
    e = edges.where("src <> dst").select("src", "dst", w.alias("w"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") * reverse).alias("w")))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0")


def nearest_seed(edges: DataFrame, seeds: DataFrame, cap: float, rounds: int | None = None) -> DataFrame:
    """``id``, ``distance`` and ``seed`` of the cheapest way from a seed along ``src, dst, cost``, both ways.

    Bounded relaxation: nodes at ``cap`` or beyond do not go on, at most ``rounds`` edges are
    walked, or as many as improve anything, and of equal costs the smaller seed counts.
    """
    both = edges.select("src", "dst", "cost").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    both = cut(both.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    state = cut(seeds.select("id").distinct().select("id", F.struct(F.lit(0.0).alias("d"), F.col("id").alias("seed")).alias("s")))
    frontier = state
    for _ in itertools.count() if rounds is None else range(rounds):
        way = both.join(frontier.where(F.col("s.d") < cap).select(F.col("id").alias("src"), "s"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("s.d") + F.col("cost")).alias("d"), F.col("s.seed").alias("seed"))).alias("t"))
        better = cut(way.join(state, "id", "left").where(F.col("s").isNull() | (F.col("t") < F.col("s"))).select("id", F.col("t").alias("s")))
        if better.isEmpty():
            break
        state = cut(better.unionByName(state.join(better.select("id"), "id", "left_anti")))
        frontier = better
    return state.select("id", F.col("s.d").alias("distance"), F.col("s.seed").alias("seed"))


def components(edges: DataFrame, most: int = 1000) -> DataFrame:
    """``id`` and ``component`` (the smallest id in it) by alternating large and small stars.

    Each round a node links to the least of its neighbourhood; rounds grow with the logarithm
    of the size and no neighbourhood is collected. The links have settled when a round gives
    the same number of them with the same hashes; ``most`` rounds is a guard that raises.
    """
    e = edges.where("src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    ids = e.select(F.col("u").alias("id")).unionByName(e.select(F.col("v").alias("id"))).distinct()
    e = cut(e.where("u <> v"))
    look = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    before = look(e)
    for _ in range(most):
        # Large star: neighbours larger than a node link to the least of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        after = look(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return ids.join(e.select(F.col("u").alias("id"), "v"), "id", "left").groupBy("id").agg(F.coalesce(F.min("v"), F.col("id")).alias("component"))


def propagate_labels(pairs: Iterable[tuple[str, str]], rounds: int = 100) -> dict[str, str]:
    """Sequential label propagation: nodes in id order take the smallest of their own label and the most frequent ones around them."""
    around: dict[str, set[str]] = {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    label = {x: x for x in around}
    for _ in range(rounds):
        moved = False
        for x in sorted(around):
            count: dict[str, int] = {}
            for y in around[x]:
                count[label[y]] = count.get(label[y], 0) + 1
            top = max(count.values())
            best = min([label[x], *(k for k, c in count.items() if c == top)])
            if best != label[x]:
                label[x], moved = best, True
        if not moved:
            break
    return label


def local_clusters(edges: DataFrame, part: str, most_edges: int = 2_000_000) -> DataFrame:
    """``part``, ``id`` and ``label`` by sequential label propagation within each part (such as a repository).

    The order of nodes matters, so a part runs in one task; a part over ``most_edges`` distinct
    edges is refused by an error that names it rather than cut. Use ``spread_labels`` for those.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label = propagate_labels(zip(pdf["src"], pdf["dst"]))
        return pd.DataFrame({part: key[0], "id": list(label), "label": list(label.values())}, columns=[part, "id", "label"])

    one = edges.select(part, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    refuse_large(one, part, most_edges, "; use spread_labels")
    return one.groupBy(part).applyInPandas(run, f"`{part}` string, id string, label string")


def spread_labels(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``id`` and ``label`` by rounds in which all nodes move together; fixed rounds, ties to the smallest label.

    Differs from the sequential form in that a round sees the labels of the last one only.
    """
    e = edges.where("src <> dst").select("src", "dst")
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    state = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    with held(both, "dst") as both:
        for _ in range(rounds):
            votes = both.meet(state.select(F.col("id").alias("dst"), "label")).groupBy("src", "label").agg(F.count(F.lit(1)).alias("c"))
            state = cut(votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("m")).select("id", F.col("m.label").alias("label")))
        return state


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of ``labels`` (id, label) on the undirected graph of ``edges`` (src, dst, w); 0 without edges."""
    e = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    ends = e.select(F.col("a").alias("c"), "w", (F.col("a") == F.col("b")).alias("same")).unionByName(e.select(F.col("b").alias("c"), "w", (F.col("a") == F.col("b")).alias("same")))
    by = ends.groupBy("c").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("inside"))
    inside, squares, m = by.agg(F.sum("inside"), F.sum(F.col("total") * F.col("total")), F.sum("total")).first()
    return inside / m - squares / (m * m) if m else 0.0


def communities(edges: DataFrame, *, resolution: float = 1.0, levels: int = 5, rounds: int = 8) -> DataFrame:
    """``id`` and ``label`` (the smallest id) of communities that raise modularity, level by level.

    ``edges``: src, dst, w above 0, taken both ways; repeated ones add up and loops count. A node
    moves to the community around it that gains most (of equal ones the smallest) and only if
    that is more than staying gains. All nodes move together, in each round those whose hash
    with the round is even, so that neighbours do not swap for ever. When a level has settled,
    or after ``rounds``, its communities become the nodes of the next; ``levels`` bounds these.
    A node without edges is in no community.
    """
    e = edges.where("src is not null and dst is not null and w > 0").select("src", "dst", F.col("w").cast("double").alias("w"))
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    label = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    double_m = both.agg(F.sum("w")).first()[0]
    for level in range(levels if double_m else 0):
        degree = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        state, moved_once = degree.select("id", F.col("id").alias("c"), "k"), False
        with held(both.where("src <> dst"), "dst") as placed:
            for turn in range(rounds):
                total = state.groupBy("c").agg(F.sum("k").alias("tot"))
                near = placed.meet(state.select(F.col("id").alias("dst"), "c")).groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("in"))
                near = near.unionByName(state.select("id", "c", F.lit(0.0).alias("in")))  # staying is always open
                ways = near.groupBy("id", "c").agg(F.sum("in").alias("in")).join(state.select("id", F.col("c").alias("own"), "k"), "id").join(total, "c")
                gain = F.round(F.col("in") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / double_m, 9)
                # The best way, and staying before any other of the same gain.
                best = ways.groupBy("id", "own", "k").agg(F.min(F.struct((-gain).alias("g"), (F.col("c") != F.col("own")).alias("away"), F.col("c").alias("c"))).alias("b"))
                free = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
                new = cut(best.select("id", F.when(free, F.col("b.c")).otherwise(F.col("own")).alias("c"), "k", (F.col("b.c") != F.col("own")).alias("open"), "own"))
                moved, left = new.agg(F.count_if(F.col("c") != F.col("own")), F.count_if("open")).first()
                state, moved_once = new.select("id", "c", "k"), moved_once or moved > 0
                if not left:
                    break
        if not moved_once:
            break
        label = cut(label.join(state.select(F.col("id").alias("label"), "c"), "label").select("id", F.col("c").alias("label")))
        to = lambda c: state.select(F.col("id").alias(c), F.col("c").alias(f"{c}_c"))
        both = cut(both.join(to("src"), "src").join(to("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")))
    return label.join(label.groupBy("label").agg(F.min("id").alias("least")), "label").select("id", F.col("least").alias("label"))


def trace_flows(edges: DataFrame, entries: DataFrame, part: str, max_depth: int = 20, most_edges: int = 2_000_000) -> DataFrame:
    """Depth-first preorder from each entry over sorted callees, within its part: entry, id, step, depth.

    The order depends on what was visited before, so a part's adjacency lies in one task; a
    part over ``most_edges`` distinct edges is refused by an error that names it.
    """

    def run(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(e["src"], e["dst"]))):
            out.setdefault(a, []).append(b)
        rows = []
        for entry in sorted(set(s["id"])):
            seen: set[str] = set()
            stack = [(entry, 0)]
            while stack:
                x, d = stack.pop()
                if d > max_depth or x in seen:
                    continue
                rows.append((entry, x, len(seen), d))
                seen.add(x)
                stack.extend((y, d + 1) for y in reversed(out.get(x, ())))
        return pd.DataFrame(rows, columns=["entry", "id", "step", "depth"])

    distinct = edges.select(part, "src", "dst").distinct()
    refuse_large(distinct, part, most_edges)
    return distinct.groupBy(part).cogroup(entries.select(part, "id").groupBy(part)).applyInPandas(run, "entry string, id string, step int, depth int")
