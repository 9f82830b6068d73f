"""Differences of two snapshots, what they break, and how risky that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import half_up, staleness_risk
from .excerpts import parse_symbol


def normal_signature(c: Column) -> Column:
    """A signature's JSON in one form: keys in order, no white space; text that does not parse stays."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def version_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol_id, change_type and what differs, of symbols that were added, removed or modified.

    ``old`` and ``new``: symbol_id, ast_fingerprint, signature_json, summary, one row a symbol.
    Modified means another fingerprint, or another summary together with another signature;
    neither alone of the latter two. Null equals null.
    """
    side = lambda df, p: df.select("symbol_id", F.col("ast_fingerprint").alias(p + "f"), normal_signature(F.col("signature_json")).alias(p + "g"), F.col("summary").alias(p + "s"), F.lit(True).alias(p))
    both = side(old, "o").join(side(new, "n"), "symbol_id", "full_outer")
    same = {x: F.col("o" + x).eqNullSafe(F.col("n" + x)) for x in "fgs"}
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same["f"] | (~same["s"] & ~same["g"]), "modified")
    here = F.col("o").isNotNull() & F.col("n").isNotNull()
    return both.select("symbol_id", kind.alias("change_type"), (here & same["g"]).alias("interface_stable"), (here & same["f"] & same["s"]).alias("behavior_stable"), here.alias("effects_stable")).where("change_type is not null")


def with_risk(delta: DataFrame) -> DataFrame:
    """``delta`` with its risk: 100 less the points of what is stable."""
    return delta.withColumn("risk", staleness_risk(F.col("interface_stable"), F.col("behavior_stable"), F.col("effects_stable")))


def array_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """Items of JSON string arrays that were added and removed, sorted; text that does not parse is empty."""
    a, b = (F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in (old, new))
    return F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def findings(delta: DataFrame, dependents: DataFrame) -> DataFrame:
    """finding, severity and count of each rule that applies; dependents: id, distance."""
    d = delta.agg(
        F.count_if(F.col("risk") >= 70).alias("high-risk-changes"),
        F.count_if(~F.col("interface_stable") & (F.col("change_type") == "modified")).alias("interface-breaking-changes"),
        F.count_if(F.col("change_type") == "removed").alias("removed-symbols"),
        F.count_if(F.col("change_type") == "added").alias("new-symbols"),
    )
    severity = {"high-risk-changes": "high", "interface-breaking-changes": "high", "removed-symbols": "medium", "new-symbols": "low"}
    rows = d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("finding"), F.lit(v).alias("severity"), F.col(f"`{k}`").alias("n")) for k, v in severity.items()))).alias("r")).select("r.*").where("n > 0")
    wide = dependents.where("distance = 1").agg(F.count(F.lit(1)).alias("n")).where("n > 10").select(F.lit("large-impact-radius").alias("finding"), F.lit("medium").alias("severity"), "n")
    return rows.unionByName(wide)


def change_risk(delta: DataFrame, impact: DataFrame) -> DataFrame:
    """One row with the risk of a change in 0..100; impact: rank in 0..1, signal in 0..1.

    Four tenths the mean risk of the changed symbols, three the reach, two the share of broken
    interfaces, one that of changed effects; parts without rows do not count.
    """
    d = delta.agg(F.count(F.lit(1)).alias("n"), F.avg(F.least("risk", F.lit(100))).alias("risk"), F.count_if(~F.col("interface_stable")).alias("bad"), F.count_if(~F.col("effects_stable")).alias("eff"))
    i = impact.agg(F.count(F.lit(1)).alias("m"), F.avg(100 * F.least("rank", F.lit(1.0)) * (1 + 0.25 * F.least(F.coalesce("signal", F.lit(0.0)), F.lit(1.0)))).alias("reach"))
    both = d.crossJoin(i)
    some, reach = F.col("n") > 0, F.col("m") > 0
    total = F.when(some, 0.4 * F.col("risk") + 0.2 * 100 * F.col("bad") / F.col("n") + 0.1 * 100 * F.col("eff") / F.col("n")).otherwise(0.0) + F.when(reach, 0.3 * F.least(F.lit(100.0), F.col("reach"))).otherwise(0.0)
    weight = F.when(some, 0.7).otherwise(0.0) + F.when(reach, 0.3).otherwise(0.0)
    return both.select(F.when(weight > 0, F.least(F.lit(100.0), half_up(total / weight))).otherwise(0.0).cast("bigint").alias("risk"))


def match_symbols(old: DataFrame, new: DataFrame, most_pairs: int = 4_000_000) -> DataFrame:
    """old_id, new_id, how (``name`` or ``overlap``) of symbols that are the same before and after an edit.

    Both: id, file_id, name, kind, lo, hi. A name and kind that is alone on both sides matches;
    of ambiguous ones the pairs match in order of overlap (then distance, then ids), each
    symbol once. The sequential part runs for each (file, name, kind) on its own; one with more
    than ``most_pairs`` pairs is refused by an error that names it.
    """
    import pandas as pd

    key = ["file_id", "name", "kind"]
    a = old.select(*key, F.col("id").alias("old_id"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    b = new.select(*key, F.col("id").alias("new_id"), F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))

    sizes = a.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key)
    large = sizes.where(F.col("n") * F.col("m") > most_pairs).limit(1).collect()
    if large:
        raise ValueError(f"{large[0]['name']} is in file {large[0].file_id} {large[0].n} and {large[0].m} times")

    def match(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        how = "name" if len(p) == len(q) == 1 else "overlap"
        pairs = sorted((-max(0, min(x.ohi, y.nhi) - max(x.olo, y.nlo) + 1), abs(x.olo - y.nlo), x.old_id, y.new_id) for x in p.itertuples() for y in q.itertuples())
        used, got, rows = set(), set(), []
        for _, _, x, y in pairs:
            if x not in used and y not in got:
                used.add(x)
                got.add(y)
                rows.append((x, y, how))
        return pd.DataFrame(rows, columns=["old_id", "new_id", "how"])

    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(match, "old_id string, new_id string, how string")


def descriptor_name(c: Column) -> Column:
    """The name at the end of an index symbol's descriptor: without its suffix, after the last ``/`` or ``#``."""
    bare = F.when(F.endswith(c, F.lit("().")), F.regexp_replace(c, r"\(\)\.$", "")).otherwise(F.regexp_replace(c, r"[#./(\[)!:]$", ""))
    return F.regexp_extract(bare, r"([^/#]*)$", 1)


def match_index_symbols(definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, index_symbol, id and how (``exact``, or ``nameOnly`` if the kind differs) of index symbols found among symbols.

    ``definitions``: file_id, index_symbol, kind, lo, hi, a row for each place that defines one;
    ``symbols``: file_id, id, name, kind, lo, hi. A symbol of the file with the name of the
    descriptor matches, one of the same kind before others, then the one whose lines overlap
    most, then the first. Of several definitions the first that matches counts. Local symbols,
    symbols in another format and null files match nothing. One equi join, whose rows are
    combined before they move.
    """
    d = definitions.where(~F.startswith("index_symbol", F.lit("local ")))
    d = d.select("file_id", "index_symbol", F.col("kind").alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), descriptor_name(parse_symbol(F.col("index_symbol"))["descriptor"]).alias("name")).where("name <> ''")
    both = d.join(symbols.select("file_id", "name", "id", "kind", "lo", "hi"), ["file_id", "name"])
    over = F.greatest(F.lit(0), F.least("hi", "_hi") - F.greatest("lo", "_lo") + 1)
    order = F.struct("_lo", "_hi", (~F.col("kind").eqNullSafe(F.col("_k"))).alias("other"), (-over).alias("over"), "lo", "id")
    best = both.groupBy("file_id", "index_symbol").agg(F.min(order).alias("b"))
    return best.select("file_id", "index_symbol", F.col("b.id").alias("id"), F.when(F.col("b.other"), "nameOnly").otherwise("exact").alias("how"))
