"""Scores of symbols, edges, changes and repositories as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` within its bounds; null and NaN become the lower one."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double"))))


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole`` within 0..1, ``empty`` where the whole is not positive or null."""
    return F.when(whole > 0, clamp(part.cast("double") / whole)).otherwise(F.lit(empty))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding whose halves go up, also below zero."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def log_norm(c: Column, top: int) -> Column:
    """Logarithm of a count as a share of that of ``top``, at most 1."""
    return F.when(c > 0, F.least(F.log(c + 1.0) / math.log(top + 1), F.lit(1.0))).otherwise(F.lit(0.0))


def hotness(fan_in: Column, fan_out: Column, churn: Column) -> Column:
    """Half fan-in, three tenths fan-out, a fifth churn."""
    return 0.5 * log_norm(fan_in, 100) + 0.3 * log_norm(fan_out, 50) + 0.2 * F.least(churn / 20.0, F.lit(1.0))


def centrality(page_rank: Column, k_core: Column, top_rank: Column, top_core: Column) -> Column:
    """Page rank and coreness as shares of their maxima, six to four."""
    return 0.6 * F.when(top_rank > 0, page_rank / top_rank).otherwise(0.0) + 0.4 * F.when(top_core > 0, k_core / top_core).otherwise(0.0)


def with_tiebreak(score: Column, signal: Column) -> Column:
    """A score nudged by at most a thousandth."""
    return score + 0.001 * F.least(F.coalesce(signal, F.lit(0.0)), F.lit(1.0))


def cohesion(cluster: Column, entry: Column, related: Column) -> Column:
    """Boost of symbols in an entry cluster or in one related to it."""
    return F.when(cluster.isNull(), 0.0).when(entry, 0.15).when(related, 0.05).otherwise(0.0)


#: How specific a kind of symbol is.
KIND_WEIGHT = {"class": 1.0, "function": 0.98, "method": 0.95, "interface": 0.9, "type": 0.88, "constructor": 0.8, "module": 0.7}
#: Order of kinds in lexical ranking.
KIND_ORDER = ["class", "function", "interface", "type", "method", "constructor", "module"]


def kind_specificity(kind: Column) -> Column:
    """Weight of a kind; unknown ones count as variables."""
    out = None
    for k, v in KIND_WEIGHT.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(0.55)


def kind_rank(kind: Column) -> Column:
    """Place of a kind in lexical ranking."""
    at = F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(KIND_ORDER))).cast("int")


def path_specificity(path: Column) -> Column:
    """How much a path looks like the place of source: tests, output, vendored and index files less."""
    p = F.lower(path)
    factors = [(r"/tests/|^tests/|dist-tests/|\.test\.|\.spec\.", 0.55), (r"^dist/|/dist/|^dist-tests/", 0.6), (r"^scripts/", 0.75), (r"(^|/)(target|vendor)/", 0.3), (r"\.min\.(js|css)$", 0.2), (r"(^|/)(index|tools|types|main|mod|util|utils)\.[^./]+$", 0.72)]
    out = F.lit(1.0)
    for pattern, factor in factors:
        out = out * F.when(p.rlike(pattern), factor).otherwise(1.0)
    return F.when(path.isNull() | (path == ""), 0.8).otherwise(F.greatest(F.lit(0.15), F.least(F.lit(1.0), out)))


def confidence_of(strategy: Column) -> Column:
    """Default confidence of a way of resolving."""
    return F.when(strategy == "exact", 0.92).when(strategy == "heuristic", 0.72).when(strategy == "unresolved", 0.2).otherwise(0.5)


def calibrated(base: Column, candidates: Column) -> Column:
    """Confidence less what several candidates cost, at most .35."""
    return clamp(base - F.when(candidates > 1, F.least(F.lit(0.35), candidates * 0.04)).otherwise(0.0))


def prefetch_score(offered: Column, used: Column, accepted: Column, wasted: Column, suppressed: Column, saved_ms: Column) -> Column:
    """Worth of a prefetch strategy in -1..1 from its counts."""
    n = F.greatest(F.lit(1.0), offered.cast("double"))
    return clamp(0.45 * used / n + 0.25 * accepted / n + 0.2 * clamp(saved_ms / (n * 100)) - 0.5 * wasted / n - 0.1 * suppressed / n, -1.0, 1.0)


def staleness_risk(interface: Column, behavior: Column, effects: Column) -> Column:
    """100 less the points of what is stable."""
    points = F.when(interface, 33).otherwise(0) + F.when(behavior, 33).otherwise(0) + F.when(effects, 34).otherwise(0)
    return F.lit(100) - points


def symbol_risk(risk: Column, fan_in: Column, fan_out: Column, diagnostics: Column) -> Column:
    """Risk of a change with its reach, at most 100."""
    return F.least(F.lit(100), risk + F.least(fan_in * 2, F.lit(20)) + F.least(fan_out, F.lit(10)) + F.when(diagnostics, 15).otherwise(0))


def health(freshness: Column, coverage: Column, no_error: Column, edge_quality: Column) -> Column:
    """Health of an index in 0..100."""
    return half_up(clamp(0.25 * clamp(freshness) + 0.35 * clamp(coverage) + 0.2 * clamp(no_error) + 0.2 * clamp(edge_quality)) * 100)


def impact_rank(distance: Column, hops: int, fan_in: Column, is_test: Column) -> Column:
    """Rank of a dependent: near, much used, a test."""
    near = F.greatest(F.lit(0.0), 1 - distance / float(hops))
    return clamp(0.6 * near + 0.3 * F.least(F.lit(1.0), F.log(fan_in + 1.0) / math.log(100)) + 0.1 * F.when(is_test, 1.0).otherwise(0.0))


def adaptive_confidence(least: Column, used: Column) -> Column:
    """The least confidence of an edge, raised to .8 and .95 as more than .7 and .9 of a budget is used."""
    return F.when(used > 0.9, F.greatest(least, F.lit(0.95))).when(used > 0.7, F.greatest(least, F.lit(0.8))).otherwise(least)
