import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from cairn.functions.globs import compile_glob, risky, safe_pattern
from cairn.sources import files as S
from cairn.sources import sinks as K

T = [dt.datetime(2026, 1, d) for d in range(1, 9)]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


def test_discover(spark, tmp_path):
    for p, n in (("src/a.ts", 3), ("src/deep/b.ts", 5), ("node_modules/x/c.ts", 1), ("big.ts", 100)):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * n)
    got = S.discover(spark, str(tmp_path), glob="*.ts", ignore=["node_modules/**"], max_bytes=50)
    assert rows(got, "path", "size") == [("src/a.ts", 3), ("src/deep/b.ts", 5)]


def test_notes_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("n1", {"title": "a: b", "kind": "x"}, "Text\nmore"), ("n2", {}, ""), ("bad/name", {}, "")], "name string, fields map<string,string>, body string")
    S.write_notes(d, str(tmp_path / "notes"))
    assert rows(S.read_written_notes(spark, str(tmp_path / "notes")).where("name = 'n1'"), "fields", "body") == [({"title": "a: b", "kind": "x"}, "Text\nmore")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.md").write_text("---\ntitle: T\ntitle: second\nno colon\n---\nBody\n")
    (tmp_path / "m/b.md").write_text("plain")
    assert rows(S.read_notes(spark, str(tmp_path / "m")), "fields", "body") == [({"title": "T"}, "Body\n"), ({}, "plain")]


def test_artifact_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "id int, t string, v array<double>")
    S.export_artifact({"t": d, "none": d.limit(0)}, str(tmp_path))
    back = S.import_artifact(spark, str(tmp_path))
    assert rows(back["t"]) == rows(d) and back["none"].isEmpty()
    part = next(p for p in os.listdir(tmp_path / "t") if p.endswith(".gz"))
    with gzip.open(tmp_path / "t" / part, "at") as f:
        f.write('{"id":9,"t":"x","v":null}\n')
    for p in os.listdir(tmp_path / "t"):
        if p.endswith(".crc"):
            os.remove(tmp_path / "t" / p)
    with pytest.raises(ValueError, match="manifest"):
        S.import_artifact(spark, str(tmp_path))


def _field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_occurrence_index(spark, tmp_path):
    occ = _field(1, bytes([3, 1, 9])) + _field(2, b"pkg f().") + _field(3, 1)
    wide = _field(1, bytes([0xAC, 2, 1, 0xAD, 2, 4])) + _field(2, b"pkg g().")
    doc = _field(1, b"src/a.ts") + _field(4, b"typescript") + _field(2, occ) + _field(2, wide) + _field(9, 7)
    (tmp_path / "index.bin").write_bytes(_field(1, b"meta") + _field(2, doc))
    got = S.read_occurrences(spark, str(tmp_path))
    assert rows(got, "path", "language", "symbol", "roles", "line", "col", "end_line", "end_col") == [("src/a.ts", "typescript", "pkg f().", 1, 3, 1, 3, 9), ("src/a.ts", "typescript", "pkg g().", 0, 300, 1, 301, 4)]


def test_globs():
    import re

    for g, yes, no in (("src/**/*.ts", ["src/a.ts", "src/x/y/b.ts"], ["src/a.js", "lib/a.ts"]), ("*.{js,ts}", ["a.js", "a.ts"], ["a/b.ts", "a.py"]), ("a?c", ["abc"], ["a/c", "abbc"])):
        p = re.compile(compile_glob(g))
        assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)
    assert risky("(a+)+$") and risky("(a|aa)*") and risky("x" * 600) and not risky(r"\bfoo(bar)?\d{2,4}")
    for bad in ("(a+)+", "("):
        with pytest.raises(ValueError):
            safe_pattern(bad)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert rows(K.upsert(old, new, ["k"], "at")) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert rows(K.upsert(old, new.limit(0), ["k"])) == rows(old)
    assert rows(K.insert_missing(old, new, ["k"]), "k") == [(1,), (2,), (3,)]


def test_edge_rules(spark):
    c = "src string, dst string, edge_type string, weight double, confidence double, resolution string, created_at timestamp_ntz"
    old = spark.createDataFrame([("a", "b", "call", 1.0, 0.9, "exact", T[0]), ("a", "c", "call", 1.0, 0.5, "heuristic", T[0]), ("a", "e", "call", 1.0, 0.5, "exact", T[0])], c)
    new = spark.createDataFrame([("a", "b", "call", 2.0, 0.8, "heuristic", T[2]), ("a", "c", "call", 2.0, 0.4, "exact", T[2]), ("a", "e", "call", 2.0, 0.6, "heuristic", T[2]), ("a", "d", "call", 2.0, 0.1, "exact", T[2]), ("a", "d", "call", 3.0, 0.3, "exact", T[1])], c)
    got = {r.dst: (r.weight, r.confidence, r.created_at) for r in K.upsert_edges(old, new).collect()}
    assert got == {"b": (1.0, 0.9, T[0]), "c": (2.0, 0.4, T[0]), "e": (2.0, 0.6, T[0]), "d": (3.0, 0.3, T[1])}
    moves = spark.createDataFrame([("c", "b")], "dst string, new_dst string")
    assert {(r.dst, r.confidence) for r in K.retarget(old, moves).collect()} == {("b", 0.9), ("e", 0.5)}


def test_deletes_and_blobs(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "b"), (None, "b")], "src string, dst string")
    out = K.cascade_delete({"n": n, "e": e}, n.where("id = 'a'"), {"n": ["id"], "e": ["src", "dst"]})
    assert rows(out["n"]) == [("b",)] and len(rows(out["e"])) == 2
    d = spark.createDataFrame([(1, T[0]), (2, T[2]), (3, None)], "k int, until timestamp_ntz")
    assert rows(K.expire(d, "until", F.lit(T[1]).cast("timestamp_ntz")), "k") == [(2,), (3,)]
    assert K.with_blob_key(spark.createDataFrame([("x",), ("x",), (None,)], "p string"), "p").count() == 1


def test_publish_is_all_or_nothing(spark, tmp_path):
    home = str(tmp_path / "db")
    d = spark.createDataFrame([(1,), (2,)], "k int")
    K.publish({"t": d}, home)
    with pytest.raises(ValueError):
        K.publish({"t": d.withColumn("k", F.lit(-1))}, home, {"t": F.col("k") > 0})
    assert rows(K.current(spark, home, "t")) == [(1,), (2,)]
    K.publish({"t": d.where("k = 2")}, home, {"t": F.col("k") > 0})
    assert rows(K.current(spark, home, "t")) == [(2,)]
    assert len([x for x in os.listdir(home) if len(x) == 32]) == 2


def test_partitions_and_migrations(spark, tmp_path):
    p = str(tmp_path / "p")
    d = spark.createDataFrame([("v1", 1), ("v2", 2)], "v string, k int")
    K.append_partitioned(d, p, ["v"])
    K.replace_partitions(d.where("v = 'v2'").withColumn("k", F.lit(9)), p, ["v"])
    assert rows(spark.read.parquet(p), "v", "k") == [("v1", 1), ("v2", 9)]
    m, v = K.migrate(d, 1, {1: [("old", "1")], 2: [("kind", "'x'")], 3: [("double_k", "k * 2"), ("kind", "'y'")]})
    assert v == 3 and rows(m, "kind", "double_k") == [("x", 2), ("x", 4)] and "old" not in m.columns
