import time

import pytest
from pyspark.sql import functions as F

from cairn.llm.handwritten import classify_files, file_kind, notice_automaton

A = notice_automaton()
MIN = "!function(e,t){var n=e.a||{};t.b=n}(this,x);" * 6
MADE = [
    ("src/a.ts", 900, "// Code generated by thing v3. DO NOT EDIT.\nexport {}"),
    ("src/a.kt", 900, "// @generated by gen from x.schema\n// @checksum 1\npackage a"),
    ("a/b.cs", 900, "// <auto-generated>\n//  Changes to this file will be lost.\n"),
    ("a/b.py", 900, "# Autogenerated bindings - regenerate with `make x`.\nimport os"),
    ("a/b.py", 900, "# ------\n# Machine-made from x.yaml. Do not change by hand!\nimport os"),
    ("a/b.c", 900, "/*\n   Generated from x.y by tool\n*/\nint a;"), ("x/y_pb2.py", 900, None), ("x/y.pb.go", 900, None), ("x\\__generated__\\Q.ts", 900, None), ("x/yarn.lock", 9, ""), ("x/moc_win.c", 9, None), ("x/parse.tab.c", 9, None),
]
HAND = [
    ("src/codegen/emit.ts", 900, "// Writes the generated client. Edit the templates here, not the output.\nimport x"),
    ("src/a.py", 900, "# Lists files marked as auto-generated so that the build can skip them.\nimport os"),
    ("src/a.py", 900, "# Turns the spec into generated code; a test checks that nobody edits the output by hand.\n"),
    ("src/minify.js", 900, "// Minified input is refused here: lines above 18000 characters are dropped.\n"),
    ("vendor_portal/a.ts", 900, "import x from 'y';\n"), ("src/vendors/pay.ts", 900, "import x\n"), ("src/external_id/a.py", 900, "import x\n"), ("distribution/a.js", 900, "import x\n"),
    ("src/gen.ts", 900, "const TEXT = '// Code generated by me. DO NOT EDIT.';\n"), ("src/all.ts", 190_000, "// Central list of handlers.\nimport a\n"), ("a.c", 9, "/* x */\nGenerated from x\n"), (None, None, None), ("", 5, ""), ("deps/mine/a.go", 9, "package a\n"),
]


@pytest.mark.parametrize("path, size, head", MADE)
def test_made(path, size, head):
    assert file_kind(path, size, head, A) == "generated"


@pytest.mark.parametrize("path, size, head", HAND)
def test_hand(path, size, head):
    assert file_kind(path, size, head, A) is None


@pytest.mark.parametrize(
    "kind, path, size, head",
    [
        ("minified", "src/a.js", 90_000, MIN), ("minified", "src/a.min.js", None, None), ("minified", "x/public/a.0123abcd.js", 5, None), ("minified", "x/dist/a.js", 5, None), ("minified", "a.js", 5, "/* lib 2.1 | (c) authors */\n" + MIN),
        ("third_party", "Vendor/lib/a.ts", 5, "import x\n"), ("third_party", "./web/node_modules/l/a.js", 5, MIN), ("third_party", "contrib/lib-2.4/a.c", 5, ""),
        ("data", "a.py", 70_000, "X = [" + ",".join(map(str, range(100)))), ("data", "a.ts", 70_000, 'export const X = "' + "QUJD" * 60), ("data", "a.go", 5_000_000, "package a\n\nvar T = []any[\n" + '  ["c1", -70.05, -45.1],\n' * 8), ("data", "a.java", 3_000_000, None),
    ],
)
def test_other_kinds(kind, path, size, head):
    assert file_kind(path, size, head, A) == kind


def test_table(spark):
    f = spark.createDataFrame([("1", "src/a.ts", 5, "H1 ", "import x", "z"), ("1", "src/a.ts", 5, "H1", "import x", "z"), ("2", "src/b.ts", 5, None, None, "z"), ("2", "src/b.ts", 5, None, "// @generated by x", "z"), ("3", "src/c.ts", 5, "", "x" * 100_000, "z"), (None, "a.min.js", 5, None, None, "z")], "file_id string, rel_path string, byte_size bigint, content_hash string, head_text string, kind string").withColumn("language", F.lit("go"))
    t = spark.createDataFrame([("h1", "p"), (" ", "p"), (None, "p")], "content_hash string, package_name string")
    assert sorted(map(tuple, classify_files(f, t).collect())) == [("1", "third_party"), ("2", "generated")]
    assert classify_files(f.limit(0), t).isEmpty() and sorted(r.file_id for r in classify_files(f, t.limit(0)).collect()) == ["2"]


@pytest.mark.parametrize(
    "head",
    [
        "a\n" + "1" * 10_000 + " # text\nb\nc", "a\n    0x" + "0123456789abcdef" * 100 + " done\nb\nc", "1 " * 100_000 + "x", "1," * 11 + " " * 100_000 + "x", "'" * 100_000,
        "/*" * 50_000 + "generated by " * 20_000, "// x generated by " * 20_000, '"' + "A" * 99 + '"' * 50_000, "-1" * 100_000, "1e" * 100_000, "a" * 300_000, "\\x0" * 100_000,
    ],
)
def test_linear_time(head):
    began = time.perf_counter()
    file_kind("a/b.py", 5, head, A)
    file_kind("lib/" + head.replace("\n", ""), 5, None, A)
    assert time.perf_counter() - began < 1


def test_language_speaks_for_names_without_suffix():
    assert file_kind("web/dist/app", 5, None, A, " JavaScript") == "minified"
    assert file_kind("web/dist/app", 5, None, A, "go") is None and file_kind("web/dist/app.go", 5, None, A, "javascript") is None
    assert file_kind("a.py", 100, "", A, None, data_bytes=100) == "data" and file_kind("a.py", 100, "", A) is None
