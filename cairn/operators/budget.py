"""Selection under budgets."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import refuse_large


def greedy_budget(items: DataFrame, order: list[str], size: str, max_items: int, max_total: int) -> DataFrame:
    """``items`` with ``kept``: taken in ascending order if they still fit, else passed over.

    ``order`` has to be total. Null sizes count as 50, negative ones as 0. Once an item of some
    size does not fit, none of that size fits later, so the kept ones of a size are its first
    ones. Only the first ``max_items`` of each size can matter, at most ``max_items *
    max_total`` rows however large the table; they are folded in order, all others are passed
    over.
    """
    s = F.greatest(F.coalesce(F.col(size), F.lit(50)), F.lit(0)).cast("bigint")
    sized = items.withColumn("_s", s)
    first = sized.where(F.col("_s") <= max_total).withColumn("_at", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).where(F.col("_at") <= max_items).select(*order, "_s")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        used = taken = 0
        kept = []
        for n in pdf["_s"]:
            ok = taken < max_items and used + n <= max_total
            used, taken = used + n * ok, taken + ok
            kept.append(ok)
        return pdf[kept][order]

    types = dict(items.dtypes)
    kept = first.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(fold, ", ".join(f"`{c}` {types[c]}" for c in order)).withColumn("kept", F.lit(True))
    cond = None
    for c in order:
        same = items[c].eqNullSafe(kept[c])
        cond = same if cond is None else cond & same
    return items.join(kept, cond, "left").select(*(items[c] for c in items.columns), F.coalesce(kept["kept"], F.lit(False)).alias("kept"))


def token_prefix(items: DataFrame, group: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows of each group up to the first that would exceed the budget, with the running ``used``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def adaptive_confidence(least: float, used: float, budget: float) -> float:
    """The confidence an edge needs: ``least``, but .8 beyond seven tenths of the budget and .95 beyond nine."""
    ratio = used / budget if budget > 0 else 0.0
    return max(least, 0.95) if ratio > 0.9 else max(least, 0.8) if ratio > 0.7 else max(0.0, min(1.0, least))


#: Strength of an edge by its type (.5 for others), and worth of a start by what named it, the first ones first.
EDGE_STRENGTH = {"call": 1.0, "import": 0.6, "config": 0.8, "implements": 0.9}
START_WORTH = {"entrySymbol": 1.4, "entrySibling": 1.22, "entryFirstHop": 1.18, "stackTrace": 1.2, "failingTestPath": 1.1, "editedFile": 1.0, "taskText": 0.6}


def best_first(out: dict, nodes: dict, starts: list[tuple[str, str]], *, max_cards: int = 60, max_tokens: float = 12_000, min_confidence: float = 0.5, threshold: float = 0.2, frontier: int = 1000, patience: int = 5) -> list[tuple[str, float]]:
    """The cards of one slice with their scores, in the order in which they were taken.

    ``out``: of each node its edges (target, type, confidence), of several to one target the last
    counts; ``nodes``: of each node (score, signal, boost, tokens, external); ``starts``: (node,
    source) in their order. All starts share one frontier, which keeps the ``frontier`` best. A
    neighbour is looked at once: its worth is its score times the edge's strength and confidence,
    plus its boost and a thousandth of its signal; an edge below the confidence that
    ``adaptive_confidence`` asks for at the tokens used, or a worth below the threshold, drops it,
    but a direct import of an entry is worth the threshold at least. External nodes are taken
    as leaves. A slice ends at the card cap, with the card that exceeds the tokens (which is
    taken back), after ``patience`` cards in a row below the threshold (edited files are exempt
    and passed over ones do not count as cards), or when its cap tightens: enough cards, six
    tenths of them .2 above the threshold, nine tenths of the entries covered, and a clear drop
    to what comes next.
    """
    entries = {x for x, source in starts if source == "entrySymbol"}
    forced = {x for x, source in starts if source == "editedFile"}
    enough = max(min(max_cards, 6), min(max_cards, len(entries) + 2 if entries else 6))
    heap, seen, turn = [], set(), 0
    for x, source in starts:
        if x in nodes and x not in seen:
            heapq.heappush(heap, (-START_WORTH[source], 0, turn, x))
            seen.add(x)
            turn += 1
    taken: dict[str, float] = {}
    recent: list[float] = []
    used, low, cap = 0.0, 0, max_cards
    while heap and len(taken) < cap:
        need = adaptive_confidence(min_confidence, used, max_tokens)
        worth, _, _, x = heapq.heappop(heap)
        worth = -worth
        if worth < threshold and x not in forced:
            low += 1
            if low >= patience:
                break
            continue
        low = 0
        used += nodes[x][3]
        if used > max_tokens:
            break
        taken[x] = worth
        recent = [*recent, worth][-6:]
        targets = {y: (kind, sure) for y, kind, sure in out.get(x, ()) if y not in seen and y not in taken and y in nodes}
        for y, (kind, sure) in targets.items():
            seen.add(y)
            score, signal, boost, _, external = nodes[y]
            if external:
                taken[y] = 0.0
                recent = [*recent, 0.0][-6:]
                continue
            if sure < need:
                continue
            value = score * EDGE_STRENGTH.get(kind, 0.5) * sure + boost + 0.001 * max(0.0, min(signal, 1.0))
            if kind == "import" and x in entries:
                value = max(value, threshold)
            if value < threshold:
                continue
            item = (-value, 10, turn, y)
            turn += 1
            if len(heap) < frontier:
                heapq.heappush(heap, item)
            elif item < (worst := max(heap)):
                heap[heap.index(worst)] = item
                heapq.heapify(heap)
        if targets and heap and recent and len(taken) >= enough:
            sure_cards = sum(v >= threshold + 0.2 for v in taken.values())
            covered = not entries or len(entries & taken.keys()) >= 0.9 * len(entries)
            if sure_cards >= 0.6 * len(taken) and covered and -heap[0][0] < max(threshold + 0.08, 0.67 * sum(recent) / len(recent)):
                cap = min(cap, len(taken))
    return list(taken.items())


def beam_slices(edges: DataFrame, starts: DataFrame, nodes: DataFrame, part: str, *, most_edges: int = 2_000_000, **limits) -> DataFrame:
    """One best-first slice of each part (such as a repository) that has starts: part, id, pos, score.

    ``edges``: part, src, dst, edge_type, confidence (0..1, null or NaN is 1); ``starts``: part,
    id, source; ``nodes``: part, id, score, signal, boost, tokens, external, of which null counts
    as 0, 50 tokens and not external. Neighbours come in the order of their id; ``limits`` are
    those of ``best_first``. The order depends on what was taken before, so the adjacency of a
    part lies in one task; a part over ``most_edges`` edges is refused before anything moves, by
    an error that names it. Parts without starts do not move.
    """
    mine = starts.select(part).where(F.col(part).isNotNull()).distinct()
    e = edges.select(part, "src", "dst", "edge_type", "confidence").join(mine, part, "left_semi")
    refuse_large(e, part, most_edges)
    sure = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    order = list(START_WORTH)

    def run(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[tuple[str, str, float]]] = {}
        for a, b, kind, c in sorted(zip(e["src"], e["dst"], e["edge_type"].fillna(""), e["confidence"])):
            out.setdefault(a, []).append((b, kind, c))
        known = {i: x for i, *x in zip(s["id"], s["score"], s["signal"], s["boost"], s["tokens"], s["external"])}
        first = sorted((order.index(x), i) for i, xs in zip(s["id"], s["sources"]) if xs is not None for x in xs)
        rows = best_first(out, known, [(i, order[x]) for x, i in first], **limits)
        return pd.DataFrame({part: [key[0]] * len(rows), "id": [x for x, _ in rows], "pos": range(len(rows)), "score": [v for _, v in rows]})

    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    said = starts.where(F.col("id").isNotNull()).groupBy(part, "id").agg(F.collect_set("source").alias("sources"))  # of seven sources
    known = nodes.join(mine, part, "left_semi").select(part, "id", zero("score"), zero("signal"), zero("boost"), F.coalesce(F.col("tokens").cast("double"), F.lit(50.0)).alias("tokens"), F.coalesce("external", F.lit(False)).alias("external")).join(said, [part, "id"], "left")
    kind = dict(nodes.dtypes)[part]
    return e.select(part, "src", "dst", "edge_type", sure.alias("confidence")).groupBy(part).cogroup(known.groupBy(part)).applyInPandas(run, f"`{part}` {kind}, id string, pos int, score double")
