"""Scans, lookups and set operations on node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows after a key, in the key's order; ``after`` None starts at the first."""
    page = df if after is None else df.where(F.col(key) > F.lit(after))
    return page.orderBy(key).limit(size)


def lookup(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ``ids`` (same column name), each once; null keys match nothing."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def missing(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The ids that have no row; a null id has none."""
    return ids.join(df.select(key).distinct(), key, "left_anti")


def prefix_scan(df: DataFrame, column: str, prefix: str, *, exclude: DataFrame | None = None, key: str = "", limit: int = 200) -> DataFrame:
    """Rows whose column starts with ``prefix``, without excluded keys, first ``limit`` in order."""
    found = df.where(F.col(column).startswith(prefix))
    if exclude is not None:
        found = found.join(exclude.select(key).distinct(), key, "left_anti")
    return found.orderBy(column, *([key] if key else [])).limit(min(limit, 200))


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is ``scope`` or lies below it, without letter case; ``.`` is everything."""
    s = scope.strip("/").lower()
    return F.lit(True) if s in ("", ".") else (F.lower(path) == s) | F.lower(path).startswith(s + "/")


def classify_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key`` and ``change`` (added, removed, changed, same) between two states of a table.

    A null digest on either side counts as changed, since nothing tells that it is the same.
    """
    o, n = old.select(key, F.col(digest).alias("_o"), F.lit(1).alias("_in_o")), new.select(key, F.col(digest).alias("_n"), F.lit(1).alias("_in_n"))
    change = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def drop_compiled(df: DataFrame, path: str) -> DataFrame:
    """Without scripts whose typed source of the same stem is there too (``.js`` beside ``.ts``)."""
    ext = F.lower(F.regexp_extract(path, r"\.([cm]?[jt]sx?)$", 1))
    stem = F.regexp_replace(path, r"\.[cm]?[jt]sx?$", "")
    kind = F.translate(ext, "j", "t")
    typed = df.select(stem.alias("_stem"), kind.alias("_kind"), ext.alias("_ext")).where("_ext rlike '^[cm]?tsx?$'").select("_stem", "_kind").distinct()
    compiled = df.withColumn("_stem", stem).withColumn("_kind", F.when(ext.rlike("^[cm]?jsx?$"), kind))
    return compiled.join(typed, ["_stem", "_kind"], "left_anti").drop("_stem", "_kind")


def merge_ordered(first: DataFrame, second: DataFrame, key: str, position: str, limit: int | None = None) -> DataFrame:
    """Union of two ordered id lists: those of ``first`` before new ones of ``second``, each once."""
    both = first.select(key, F.lit(0).alias("_side"), position).unionByName(second.select(key, F.lit(1).alias("_side"), position))
    one = both.groupBy(key).agg(F.min(F.struct("_side", position)).alias("_at")).orderBy("_at", key)
    return (one.limit(limit) if limit is not None else one).select(key)


def without_suspects(strong: DataFrame, weak: DataFrame, key: str) -> DataFrame:
    """All rows of ``strong`` and those of ``weak`` whose key is not in ``strong``."""
    return strong.unionByName(weak.join(strong.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
