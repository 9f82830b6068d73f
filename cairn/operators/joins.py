"""Joins over nodes, edges, intervals and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import numbered


def one_hop(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (id, neighbor) of the ids along edges ``out``, ``in`` or ``both`` ways."""
    out = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
    back = edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def min_call_confidence(least: float) -> Column:
    """Constrains calls only; null confidence of a call does not pass."""
    return (F.col("edge_type") != "call") | (F.col("confidence") >= least)


def fan_in_out(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in and fan_out over every edge that touches it; 0 where there is none."""
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    got = ids.select("id").distinct().join(ins, "id", "left").join(outs, "id", "left")
    return got.select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    one = ids.select("id").distinct()
    return edges.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi")


def best_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, edge_type): the highest confidence, then weight."""
    best = F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("weight", F.lit(0.0)).alias("weight"))).alias("b")
    return edges.groupBy("src", "dst", "edge_type").agg(best).select("src", "dst", "edge_type", "b.confidence", "b.weight")


def overlap_join(spans: DataFrame, probes: DataFrame, on: str, *, cell: int = 256) -> DataFrame:
    """Pairs of spans and probes of one ``on`` whose closed intervals (lo, hi) meet.

    Both sides are dealt into cells of ``cell`` units and joined on (on, cell): an equi join,
    so a large group neither meets in one task nor forms a cross product. A pair is given in
    the first cell that both touch, hence once. Null or reversed intervals meet nothing.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        ok = df.where("lo is not null and hi >= lo").select(on, *(F.col(c).alias(p + c) for c in df.columns if c != on))
        return ok.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(p + "lo") / cell), F.floor(F.col(p + "hi") / cell))))

    s, q = dealt(spans, "s_"), dealt(probes, "q_")
    met = s.join(q, [on, "_cell"]).where("s_lo <= q_hi and q_lo <= s_hi")
    return met.where(F.col("_cell") == F.floor(F.greatest("s_lo", "q_lo") / cell)).drop("_cell")


def narrowest(pairs: DataFrame, probe: str, tie: str) -> DataFrame:
    """For each probe the span that contains it and is shortest; ties by the smaller ``tie``."""
    inside = pairs.where("s_lo <= q_lo and q_hi <= s_hi")
    rest = [c for c in inside.columns if c != probe]
    return inside.groupBy(probe).agg(F.min_by(F.struct(*rest), F.struct((F.col("s_hi") - F.col("s_lo")), tie)).alias("r")).select(probe, "r.*")


def later_steps(steps: DataFrame, starts: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """Distinct (start, item, distance) of items that come after a start item in the same group."""
    s = steps.join(starts.select(item).distinct(), item, "left_semi").groupBy(group, item).agg(F.min(order).alias("_o")).select(group, F.col(item).alias("start"), "_o")
    after = steps.join(s, group).where(F.col(order) > F.col("_o"))
    return after.groupBy("start", item).agg(F.min(F.col(order) - F.col("_o")).alias("distance")).where(F.col(item) != F.col("start"))


def overlay_rows(durable: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Overlay rows, and durable rows whose key has none."""
    return overlay.unionByName(durable.join(overlay.select(key).distinct(), key, "left_anti"))


def overlay_edges(durable: DataFrame, overlay: DataFrame, touched: DataFrame, key: str = "src") -> DataFrame:
    """Overlay edges; a touched key hides its durable edges even if it has no overlay edge."""
    return overlay.unionByName(durable.join(touched.select(key).distinct(), key, "left_anti"))


def encode_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with ends replaced by the 0-based place of their id in sorted order.

    Places are given without bringing all ids to one task; null ends have none.
    """
    place = numbered(ids.select("id").where("id is not null").distinct(), ["id"], "at").select("id", (F.col("at") - 1).alias("at"))
    a, b = place.select(F.col("id").alias("src"), F.col("at").alias("from_index")), place.select(F.col("id").alias("dst"), F.col("at").alias("to_index"))
    return edges.join(a, "src").join(b, "dst")


def resolve_refs(refs: DataFrame, candidates: DataFrame, gap: float = 0.5) -> DataFrame:
    """Each ref_id with its only strict match, or the best candidate that leads by ``gap``.

    ``candidates``: ref_id, id, strict (boolean), score. Result: ref_id, status (``resolved``,
    ``ambiguous``, ``not_found``), id.
    """
    w = Window.partitionBy("ref_id").orderBy(F.desc("strict"), F.desc("score"), "id")
    c = candidates.withColumn("at", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("next_strict", F.lead("strict").over(w))
    first = c.where("at = 1")
    sure = (F.col("strict") & ~F.coalesce("next_strict", F.lit(False))) | F.col("next").isNull() | (F.col("score") - F.col("next") >= gap)
    got = first.select("ref_id", F.when(sure, "resolved").otherwise("ambiguous").alias("status"), F.when(sure, F.col("id")).alias("id"))
    return refs.select("ref_id").distinct().join(got, "ref_id", "left").select("ref_id", F.coalesce("status", F.lit("not_found")).alias("status"), "id")
