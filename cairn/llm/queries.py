"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions.keys import fold_key
from ..plans.registry import Registry
from ..session import cut
from ..sources.tables import table
from .bpe import count_tokens, encode_corpus
from .handwritten import classify_files
from .language import label_findings, language_segments
from .packing import pack_windows, window_report
from .quantiles import merge_sketches, sketch_parts, sketch_quantiles
from .topn import symbol_scores, top_n

registry = Registry()


@registry.add("p2_found")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that are not hand-written source."""
    return p2_kinds(spark, root).select("file_id").distinct()


@registry.add("p2_kinds")
def p2_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Files that are not hand-written source, with what they are."""
    return classify_files(table(spark, root, "source_files"), table(spark, root, "third_party_hashes"))


@registry.add("p2_handwritten")
def p2_handwritten(spark: SparkSession, root: str) -> DataFrame:
    """The files that remain."""
    return table(spark, root, "source_files").select("file_id").distinct().join(p2_found(spark, root), "file_id", "left_anti")


def _measures(spark: SparkSession, root: str) -> DataFrame:
    """Both measures of each run once, as measure and value, with day, variant and category.

    Runs delivered twice differ in loaded_at only. Variants compare without letter case and
    white space, ``_`` as ``-``. A duration of 0 or less stands for no measurement.
    """
    runs = table(spark, root, "session_records").select("run_id", "ts", fold_key(F.translate("variant", "_", "-")).alias("variant"), fold_key(F.col("category")).alias("category"), F.when(F.col("duration_ms") > 0, F.col("duration_ms").cast("double")).alias("duration_ms"), F.col("tokens.savings_percent").alias("savings_percent"))
    one = runs.dropDuplicates(["run_id"]).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return one.select("day", "variant", "category", F.explode(F.array(F.struct(F.lit("duration_ms").alias("measure"), F.col("duration_ms").alias("value")), F.struct(F.lit("savings_percent").alias("measure"), F.col("savings_percent").alias("value")))).alias("m")).select("day", "variant", "category", "m.measure", "m.value")


_PS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@registry.add("p3_quantiles")
def p3_quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of both measures for each variant and category, of each day and of all days.

    A day's sketch is made from that day alone; those of all days (day null) are combined from them.
    """
    keys = ["variant", "category", "measure"]
    days = cut(merge_sketches(sketch_parts(_measures(spark, root), ["day", *keys]), ["day", *keys]))
    every = merge_sketches(days, keys, written=True).select(F.lit(None).cast("string").alias("day"), *keys, "n", "low", "high", "levels")
    return sketch_quantiles(days.unionByName(every), ["day", *keys], _PS)


@registry.add("p3_totals")
def p3_totals(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles over all days, from sketches of partitions."""
    keys = ["variant", "category", "measure"]
    return sketch_quantiles(merge_sketches(sketch_parts(_measures(spark, root), keys), keys), keys, _PS)


_TOP5 = """
WITH m AS (SELECT symbol_id, arg_max(struct_pack(p := page_rank, f := fan_in), updated_at) AS m FROM symbol_metrics GROUP BY 1),
s AS (SELECT symbol_id, max(file_id) AS file_id FROM symbols WHERE file_id IS NOT NULL GROUP BY 1),
r AS (SELECT file_id, symbol_id, CASE WHEN m.p IS NULL OR isnan(m.p) THEN 0 ELSE m.p END AS page_rank, coalesce(m.f, 0) AS fan_in FROM s JOIN m USING (symbol_id)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY page_rank DESC, fan_in DESC, symbol_id) AS INT) AS rank FROM r)
"""


@registry.add("p4_found", _TOP5 + "SELECT file_id, symbol_id FROM k WHERE rank <= 5")
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The five first symbols of every file."""
    return p4_ranked(spark, root).select("file_id", "symbol_id")


@registry.add("p4_ranked", _TOP5 + "SELECT file_id, page_rank, fan_in, symbol_id, rank FROM k WHERE rank <= 5")
def p4_ranked(spark: SparkSession, root: str) -> DataFrame:
    """The five first symbols of every file with their scores and places."""
    return top_n(symbol_scores(table(spark, root, "symbols"), table(spark, root, "symbol_metrics")), "file_id", "page_rank", "fan_in", "symbol_id", 5)


@registry.add("p6_ids")
def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every text by byte_bpe_50k."""
    return encode_corpus(table(spark, root, "documents"))


@registry.add("p6_counts")
def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of tokens of every text."""
    return count_tokens(table(spark, root, "documents"))


@registry.add("p7_windows")
def p7_windows(spark: SparkSession, root: str) -> DataFrame:
    """Every text in windows of each kind."""
    return pack_windows(table(spark, root, "documents"), table(spark, root, "context_windows"))


@registry.add("p7_report")
def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """How full the windows of each kind are."""
    return window_report(p7_windows(spark, root), table(spark, root, "context_windows"))


@registry.add("p8_found")
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Languages of documents that their labels do not name."""
    return label_findings(table(spark, root, "documents")).select("doc_id", "lang").distinct()


@registry.add("p8_segments")
def p8_segments(spark: SparkSession, root: str) -> DataFrame:
    """Every stretch of prose with its language and confidence."""
    return language_segments(table(spark, root, "documents"))
