"""File sources: discovery, front-matter notes, JSON artifacts and occurrence indexes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import compile_glob

#: Files above this many bytes are not listed.
MAX_BYTES = 2_000_000


def discover(spark: SparkSession, root: str, *, glob: str = "*", ignore: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (below ``root``), size and mtime of the files under a folder, without reading them.

    ``ignore``: globs of paths to leave out. An empty folder gives an empty result.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    out = files.select(F.regexp_replace("path", f"^.*?{_escape(base)}/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    for g in ignore or []:
        out = out.where(~F.col("path").rlike(compile_glob(g)))
    return out.where(F.col("size") <= max_bytes)


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes with front matter: path, fields (map of text) and body.

    A file without front matter has an empty map; lines of it without a colon are ignored.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    pairs = F.transform(F.filter(F.split(head, r"\r?\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.split(x, ":")[0]).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda p: p["k"] != "")
    # Of repeated keys the first counts.
    keys = F.array_distinct(F.transform(first, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.get(F.filter(first, lambda p: p["k"] == k), F.lit(0))["v"])
    return t.select(F.input_file_name().alias("path"), F.map_from_arrays(keys, values).alias("fields"), F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))


def write_notes(notes: DataFrame, root: str) -> None:
    """One markdown file for each row of name, fields (map of text) and body, written by the tasks.

    A name may hold letters, digits, ``.``, ``_`` and ``-`` only; fields are written in key order.
    """
    lines = F.array_join(F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.col("fields")[k], F.lit("")))), "\n")
    text = F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    ok = notes.where(F.col("name").rlike("^[A-Za-z0-9._-]+$")).select(F.col("name").alias("note"), text.alias("value"))
    ok.write.mode("overwrite").option("lineSep", "\0").partitionBy("note").text(root)


def read_written_notes(spark: SparkSession, root: str) -> DataFrame:
    """name, fields and body of notes that ``write_notes`` wrote."""
    t = spark.read.schema("value string, note string").option("lineSep", "\0").text(root)
    head = F.split(F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1), "\n")
    pairs = F.transform(F.filter(head, lambda x: F.contains(x, F.lit(": "))), lambda x: F.struct(F.regexp_extract(x, "^(.*?): ", 1).alias("k"), F.regexp_replace(x, "^.*?: ", "").alias("v")))
    return t.select(F.col("note").alias("name"), F.map_from_entries(pairs).alias("fields"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def export_artifact(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write tables as gzipped JSON lines with a manifest: table, rows, digest, columns.

    The digest is the sum of the rows' 64-bit hashes, so it does not depend on their order or
    files and is computed in one pass.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{root}/{name}")
        rows.append((name, *_digest(df), df.schema.json()))
    manifest = spark.createDataFrame(rows, "table string, rows bigint, digest string, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/_manifest")
    return manifest


def _digest(df: DataFrame) -> tuple[int, str]:
    h = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return h["n"], hashlib.sha256(f"{h['n']}:{int(h['s'])}".encode()).hexdigest()


def import_artifact(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of an artifact; raises if one does not match its manifest."""
    out = {}
    for m in spark.read.json(f"{root}/_manifest").collect():
        df = spark.read.schema(T.StructType.fromJson(json.loads(m["columns"]))).json(f"{root}/{m['table']}")
        if _digest(df) != (m["rows"], m["digest"]):
            raise ValueError(f"table {m['table']} does not match its manifest")
        out[m["table"]] = df
    return out


def _varint(data: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[i]
        out |= (b & 127) << shift
        i, shift = i + 1, shift + 7
        if b < 128:
            return out, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message; 32- and 64-bit values come as bytes."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def _packed(data: bytes) -> list[int]:
    out, i = [], 0
    while i < len(data):
        v, i = _varint(data, i)
        out.append(v)
    return out


def read_occurrences(spark: SparkSession, root: str) -> DataFrame:
    """Occurrences in protobuf code indexes: file, path, language, symbol, roles, line, col, end_line, end_col.

    The public index format: documents are field 2 of the index (path 1, occurrences 2,
    language 4), an occurrence has a packed range 1, a symbol 2 and roles 3. A range of three
    numbers lies on one line. Each index is decoded where it is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    names = ["file", "path", "language", "symbol", "roles", "line", "col", "end_line", "end_col"]
    schema = pa.schema([(n, pa.string()) for n in names[:4]] + [(n, pa.int32()) for n in names[4:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for number, doc in _fields(content or b""):
                    if number != 2:
                        continue
                    parts = list(_fields(doc))
                    text = {n: v.decode("utf-8", "replace") for n, v in parts if n in (1, 4)}
                    rows = []
                    for n, occ in parts:
                        if n == 2:
                            o = dict(_fields(occ))
                            r = _packed(o.get(1, b""))
                            line, col, end_line, end_col = (r[0], r[1], r[0], r[2]) if len(r) == 3 else (r + [0] * 4)[:4]
                            rows.append((file, text.get(1), text.get(4), o.get(2, b"").decode("utf-8", "replace"), int(o.get(3, 0)), line, col, end_line, end_col))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, "file string, path string, language string, symbol string, roles int, line int, col int, end_line int, end_col int")
