"""Windows, excerpts, truncation and line differences of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncated(df: DataFrame, group: list[str], order: list[str], n: int, keep: str = "start") -> DataFrame:
    """At most n rows of each group from its ``start``, ``end`` or ``both`` ends, with ``pos`` from 1; ``order`` is total."""
    w = Window.partitionBy(*group)
    d = df.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("_back", F.row_number().over(w.orderBy(*(F.desc(c) for c in order))))
    head, tail = {"start": (n, 0), "end": (0, n), "both": (n - n // 2, n // 2)}[keep]
    return d.where((F.col("pos") <= head) | (F.col("_back") <= tail)).drop("_back")


def line_window(text: Column, center: Column, lines: int) -> Column:
    """The lines of a text around a 1-based line, ``lines`` in all, shifted inside the text."""
    all_ = F.split(text, "\n")
    first = F.greatest(F.lit(1), F.least(center - lines // 2, F.size(all_) - lines + 1))
    return F.array_join(F.slice(all_, first.cast("int"), F.lit(lines)), "\n")


def line_delta(old: Column, new: Column) -> Column:
    """One hunk between two texts: first changed line, lines removed and lines added, after common ends are cut.

    Equal texts give no lines on either side. A null text counts as one without lines.
    """
    a, b = (F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "\n")) for c in (old, new))
    short = F.least(F.size(a), F.size(b))

    def same(x: Column, y: Column) -> Column:
        eq = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        first = F.array_position(eq, False)
        return F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y)))

    head = same(a, b)
    tail = F.least(same(F.reverse(a), F.reverse(b)), short - head)
    cutout = lambda x: F.slice(x, (head + 1).cast("int"), F.greatest(F.lit(0), F.size(x) - head - tail).cast("int"))
    return F.struct((head + 1).cast("int").alias("line"), cutout(a).alias("removed"), cutout(b).alias("added"))


def excerpts(df: DataFrame, key: str, text: str, words: list[str], *, around: int = 2, most_lines: int = 40, most_tokens: int = 400) -> DataFrame:
    """key, first, last and lines of the ranges around lines that hold a word.

    Hit lines are taken first, in order, then lines at distance 1, 2, ... up to ``around``,
    until the lines are used up; a line that does not fit what is left of the tokens (four
    characters each) is passed over. Neighbouring lines form one range. Words compare without
    letter case. Only a text without a hit, or of which no wanted line fits, gives no row.
    """
    low = [w.lower() for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = (t or "").split("\n")
                hits = [i for i, x in enumerate(lines) if any(w in x.lower() for w in low)]
                wanted = dict.fromkeys(hits)
                for d in range(1, around + 1):
                    wanted.update(dict.fromkeys(j for i in hits for j in (i - d, i + d) if 0 <= j < len(lines)))
                taken, used = [], 0
                for i in wanted:
                    cost = -(-len(lines[i]) // 4)
                    if len(taken) == most_lines:
                        break
                    if used + cost > most_tokens:
                        continue
                    taken.append(i)
                    used += cost
                taken.sort()
                start = 0
                for j in range(1, len(taken) + 1):
                    if j == len(taken) or taken[j] != taken[j - 1] + 1:
                        rows.append((k, taken[start] + 1, taken[j - 1] + 1, "\n".join(lines[taken[start] : taken[j - 1] + 1])))
                        start = j
            if rows:
                k, first, last, lines = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field(0).type), pa.array(first), pa.array(last), pa.array(lines)], names=[key, "first", "last", "lines"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, first bigint, last bigint, lines string")


_CSV = {"nullValue": "\\N"}


def pack_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    r"""Each row as one line of CSV; null is ``\N``, which no text may be, and empty text is quoted."""
    return df.select(F.to_csv(F.struct(*columns), {**_CSV, "emptyValue": '""', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("line"))


def unpack_rows(df: DataFrame, schema: str) -> DataFrame:
    """The rows of ``pack_rows``."""
    return df.select(F.from_csv("line", schema, {**_CSV, "emptyValue": "", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("r")).select("r.*")


def parse_symbol(c: Column) -> Column:
    """scheme, manager, package, version and descriptor of a symbol in the public index format, kind by its suffix.

    Fields are separated by one space (two stand for one inside a field); ``local`` symbols
    have only a descriptor. Anything else gives null.
    """
    t = F.regexp_replace(c, "  ", "\u0001")
    p = F.transform(F.split(t, " ", 5), lambda x: F.translate(x, "\u0001", " "))
    d = F.get(p, F.lit(4))
    kind = F.when(d.rlike(r"\(.*\)\.$"), "method").when(d.rlike(r"#$"), "type").when(d.rlike(r"/$"), "namespace").when(d.rlike(r"!$"), "macro").when(d.rlike(r":$"), "meta").when(d.rlike(r"\.$"), "term").otherwise("other")
    full = F.struct(F.get(p, F.lit(0)).alias("scheme"), F.get(p, F.lit(1)).alias("manager"), F.get(p, F.lit(2)).alias("package"), F.get(p, F.lit(3)).alias("version"), d.alias("descriptor"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    local = F.struct(F.lit("local").alias("scheme"), none.alias("manager"), none.alias("package"), none.alias("version"), F.regexp_replace(c, "^local ", "").alias("descriptor"), F.lit("local").alias("kind"))
    return F.when(F.startswith(c, F.lit("local ")), local).when(F.size(p) == 5, full)


def test_case(c: Column, longest: int = 200) -> Column:
    """name, suite and line of a test case in JSON, texts trimmed and bounded; null if it has no name."""
    p = F.from_json(c, "name string, suite string, line int")
    clean = lambda x: F.nullif(F.substring(F.trim(x), 1, longest), F.lit(""))
    return F.when(clean(p["name"]).isNotNull(), F.struct(clean(p["name"]).alias("name"), clean(p["suite"]).alias("suite"), F.when(p["line"] > 0, p["line"]).alias("line")))
