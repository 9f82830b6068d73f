import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import scores as C
from cairn.functions import text as T
from cairn.operators import aggregates as A
from cairn.operators import search as S
from cairn.operators import sequences as Q
from cairn.operators import transforms as X


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("x")).first().x


def test_text(spark):
    assert one(spark, "Hello, World-Wide foo.bar!", T.tokens) == ["hello", "world-wide", "foo.bar"]
    assert one(spark, None, T.tokens) == [] and one(spark, None, T.token_estimate) == 0
    assert one(spark, '{"a":1}', T.token_estimate) == 6
    assert one(spark, "parseHTTPResponse2_fast", T.subwords) == ["parse", "http", "response", "fast"]
    assert one(spark, "Map<string, List<int>>", T.plain_type) == "Map"
    assert [one(spark, x, T.fnv1a32) for x in ("", "a", "foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert [one(spark, x, T.duration_text, "bigint") for x in (900, 61_000, 3_660_000, 90_000_000)] == ["0s", "1m 1s", "1h 1m", "1d 1h"]
    assert one(spark, "see Foo.bar and load_all plus parseIt now", T.identifiers) == ["Foo.bar", "load_all", "parseIt"]
    assert one(spark, "mergeFrame70", lambda c: T.decode_target("unresolved:call:", T.encode_target("unresolved:call:", c))) == "mergeFrame70"
    assert one(spark, "other:bWVy", lambda c: T.decode_target("unresolved:call:", c)) is None


def test_redaction(spark):
    key = "akia" + "A" * 20
    text = (
        f"k={key} mail a.b@example.org password: hunter2hunter2 postgres://me:pw@host:5/db API_KEY_MAIN = 'abcdefghij0123456789'\n"
        "-----BEGIN RSA PRIVATE KEY-----\nMAX_BUFFER = 1234567890123456789 eyJabcdefghij.abcdefghijk.abcdefghijk"
    )
    got = one(spark, text, T.redacted)
    names = ["aws-access-key", "password", "connection-string", "env-variable", "private-key", "jwt-token"]
    assert all(f"[REDACTED:{x}]" in got for x in names) and got.count("[REDACTED:") == len(names)
    assert key not in got and "hunter2" not in got and "pw@host" not in got and "a.b@example.org" in got and "1234567890123456789" in got
    assert "example.org" not in one(spark, text, lambda c: T.redacted(c, [T.MAIL, *T.SECRETS])) and one(spark, None, T.redacted) is None
    assert one(spark, "\u00e9AKIA" + "B" * 16, T.redacted) == "\u00e9[REDACTED:aws-access-key]"


def test_secret_paths(spark):
    yes = [".env", "a/b.key", "deploy\\credentials.json", "home/.aws/credentials", "x/secrets.yml", "prod.env"]
    no = ["env", "a.keys", "credentials", "CREDENTIALS.JSON", "secrets.json", ""]
    d = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert [r.p for r in d.where(T.may_hold_secrets(F.col("p"))).collect()] == yes


def test_relevance(spark):
    cases = {
        ("splitBatch", "splitBatch"): 1.0, ("splitBatchNow", "splitBatch"): 0.85, ("reSplitBatch", "splitBatch"): 0.7, ("batchOfSplit", "splitBatch"): 0.8, ("xyz", "splitBatch"): 0.05,
        ("buildGraphSlice", "build*Slice"): 0.9, ("rebuildGraphSlices", "build*Slice"): 0.75, ("a.b", "a?b"): 0.9, ("axb", "a.*"): 0.05, ("evaluate", "evaluatePolicy"): 0.65,
        ("ledger", "load the ledger"): 0.4, ("ledger", "myledgerfile"): 0.5, ("ledgers", "keep ledger now"): 0.3 + 0.3 / 3, ("buildSlice", "buildGraphSlice"): 0.7,
    }
    d = spark.createDataFrame([(*k, v) for k, v in cases.items()], "name string, query string, want double")
    for r in d.withColumn("got", T.relevance(F.col("name"), F.col("query"))).collect():
        assert r.got == pytest.approx(r.want), r


def test_seed_tokens_and_joined_names(spark):
    assert one(spark, "Please fix the retryPolicy in src/net.retry_loop and 12345 x-9 zz Backoff", T.seed_tokens) == ["x-9", "net.retry_loop", "retrypolicy", "backoff", "fix", "src"]
    words = spark.createDataFrame([("Load the ledger rows twice",)], "t string").select(T.join_words(F.col("t")).alias("w"))
    assert words.select(T.compounds(F.col("w")).alias("x")).first().x == ["loadLedger", "LoadLedger", "load_ledger", "ledgerRows", "LedgerRows", "ledger_rows", "rowsTwice", "RowsTwice", "rows_twice", "loadLedgerRows", "LoadLedgerRows", "ledgerRowsTwice", "LedgerRowsTwice"]
    many = spark.createDataFrame([(" ".join(chr(97 + i) * 3 for i in range(26)),), ("one",), ("",), (None,)], "t string").select(T.join_words(F.col("t")).alias("w"))
    assert [len(r.x) for r in many.select(T.compounds(F.col("w")).alias("x")).collect()] == [40, 0, 0, 0]


def test_scores(spark):
    assert one(spark, -2.5, C.half_up, "double") == -2.0 and one(spark, float("nan"), C.clamp, "double") == 0
    assert one(spark, 1, lambda c: C.rate(c, F.lit(0)), "int") == 0
    assert one(spark, None, lambda c: C.path_specificity(c)) == 0.8
    assert one(spark, "class", C.kind_rank) == 0 and one(spark, None, C.kind_rank) == 7


def test_paths_and_clauses(spark):
    d = spark.createDataFrame([(1, [("a", 2)], '{"x": {"y": [5, 6]}}', {"k": "v"})], "id int, items array<struct<n:string,q:int>>, j string, m map<string,string>")
    get = lambda p: d.select(X.path(d, p, ["j"]).alias("x")).first().x
    assert [get(p) for p in ("items[0].n", "items.0.q", "items[4].n", "items.length", "j.x.y[1]", "j.x.y.length", "m.k", "none", "id.x")] == ["a", 2, None, 1, "6", 2, "v", None, None]
    with pytest.raises(ValueError):
        get("m.__proto__")
    e = spark.createDataFrame([("10", 5.0, ["aB"]), (None, float("nan"), None), ("abc", None, [])], "s string, n double, a array<string>")
    for c, want in ((("s", "gt", 9), [True, False, False]), (("n", "lte", "5"), [True, False, False]), (("s", "eq", None), [False, True, False]), (("s", "ne", "10"), [False, True, True]), (("a", "contains", "aB"), [True, False, False]), (("a", "icontains", "ab"), [True, False, False]), (("s", "in", ["abc"]), [False, False, True]), (("n", "exists"), [True, True, False])):
        assert [r.x for r in e.select(X.clause(e, *c).alias("x")).collect()] == want, c
    assert X.data_filter(e, []).count() == 3 and X.data_filter(e, [("s", "eq", "10"), ("s", "eq", "abc")], "any").count() == 2


def test_workflow(spark):
    w = X.Workflow(most_rows=2).step("a", lambda: spark.range(5).toDF("k")).step("b", lambda a: a.where("k > 0"), "a")
    assert w.run()["b"].count() == 1
    with pytest.raises(ValueError):
        w.step("c", lambda x: x, "later")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_floor_percentiles(spark, xs):
    d = spark.createDataFrame([("g", x) for x in xs] + [("g", None)], "g string, v int")
    got = {r.p: r.value for r in A.floor_percentiles(d, ["g"], "v", [0.0, 0.5, 0.99]).collect()}
    assert got == {p: sorted(xs)[min(int(p * len(xs)), len(xs) - 1)] for p in (0.0, 0.5, 0.99) if xs}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ewma_in_blocks(spark, block):
    r = random.Random(block)
    xs = [r.random() for _ in range(17)]
    d = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)] + [("k", 99, None)], "k string, i int, v double")
    want = xs[0]
    for x in xs[1:]:
        want = want * 0.5 + x * 0.5
    got = Q.ewma(d, "k", ["i"], "v", block=block).first()
    assert got.n == 17 and got.ewma == pytest.approx(want)


def test_fusion_does_not_depend_on_order(spark):
    rows = [("fts", "fts", "a", 1), ("fts", "fts", "b", 2), ("vector", "m1", "b", 5), ("vector", "m2", "b", 1), ("vector", "m1", "c", 1)]
    make = lambda xs: S.rrf(spark.createDataFrame(xs, "lane string, source string, id string, rank int"), [], ["id"], pinned=spark.createDataFrame([("c",)], "id string"))
    a, b = ([(r.id, round(r.score, 9), r.source, r.pos) for r in make(x).orderBy("pos").collect()] for x in (rows, rows[::-1]))
    assert a == b and a[0][0] == "c" and a[1] == ("b", round(0.5 / 62 + 0.5 / 61, 9), "m2", 2)


def test_vector_blocks(spark):
    r = random.Random(1)
    v = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(v, "id bigint, v array<double>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("query"), "v")
    small, large = ({(x.query, x.id, x["rank"]) for x in S.vector_neighbors(df, q, 5, block=b).collect()} for b in (7, 5000))
    assert small == large and len(small) == 15


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common other"), (4, None), (5, "")], "doc_id bigint, text string")
    i = S.postings(d, "doc_id", "text")
    got = S.bm25(i, S.corpus_size(i), spark.createDataFrame([("q", "common rare")], "query string, text string"))
    top = S.ranked(got, "query", "score", "doc", 5)
    assert [r.doc for r in top.orderBy("rank").collect()][0] == 1 and top.count() == 3
    q = spark.createDataFrame([("q", "common rare")], "query string, text string")
    again = S.bm25(*S.hits(d, "doc_id", "text", q), q)
    assert {(r.doc, round(r.score, 9)) for r in again.collect()} == {(r.doc, round(r.score, 9)) for r in got.collect()}
    with pytest.raises(ValueError):
        S.hits(d, "doc_id", "text", q, most_terms=1)


def test_whole_words_stand_before_parts(spark):
    rows = [("a", "x", "type", "p", "resplit it"), ("b", "x", "type", "p", "we split it"), ("c", "x", "type", "p", "split"), ("d", "x", "class", "p", "unsplit"), ("e", "x", "type", "tests/p", "Split early")]
    d = spark.createDataFrame(rows, "id string, name string, kind string, path string, text string")
    got = S.lexical(d, spark.createDataFrame([("split",)], "query string"), 9).orderBy("pos").collect()
    assert [r.id for r in got] == ["b", "e", "d", "a", "c"]


def test_vector_index_recall(spark):
    """Against brute force over all vectors, in clusters and without any; a hot cell is cut into blocks."""
    r = random.Random(3)
    centers = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in centers[0 if i % 3 == 0 else i % 40]]) for i in range(4000)] + [(4000, [0.0] * 16), (4001, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("query"), "v")
    want = {(x.query, x.id) for x in S.vector_neighbors(df, q, 10).collect()}
    got = {(x.query, x.id) for x in S.indexed_neighbors(df, q, 10, cells=32, probes=6, sample=1000, block=100).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert S.indexed_neighbors(df.limit(0), q, 10).isEmpty()


def test_test_files(spark):
    yes = ["a.test.ts", "src/a.spec.js", "tests/a.ts", "pkg/tests/deep/a.mjs", "__tests__/a.jsx", "src/__tests__/a.tsx", "tests/a.py"]
    no = ["src/a.ts", "tests/fixtures/a.test.ts", "src/mocks/a.spec.js", "mytests/a.ts", "a.test.tsx", "contest.ts"]
    d = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert [r.p for r in d.where(T.is_test_file(F.col("p"))).collect()] == yes


def test_nested_repeats_are_risky():
    from cairn.functions.globs import risky

    assert all(map(risky, ["(a+)+", "((a+))+", "(?:(a|b))*", "((a*)b){2,}", "(?:x(?:y+)z)+", "(a|a)+", ".*.*.*", "a" * 501]))
    assert not any(map(risky, ["a+b*", "(abc)+", "[(+]+x", r"\(a+\)+", "(a|b)c", "(a+)?", "", "[]+(]", "(ab)?(c+)"]))


def test_value_hash(spark):
    import hashlib

    forms = {
        '{"b": 1.0, "a": [true, null, "\\u00e9"]}': '{"a":[true,null,"\u00e9"],"b":1}', '{"10": 1, "2": 2, "a": 3, "01": 4}': '{"2":2,"10":1,"01":4,"a":3}', " 3 ": "3", "1e21": "1e+21", "0.0000001": "1e-7", "0.00001": "0.00001",
        "123456789012345680000": "123456789012345680000", "-0.0": "0", '"x"': '"x"', "[]": "[]", "{}": "{}", "0.1": "0.1",
    }
    assert {k: X.canonical_text(__import__("json").loads(k)) for k in forms} == forms
    d = spark.createDataFrame([(k,) for k in forms] + [(None,), ("{bad",), ("",), ("[" * 100_000,)], "t string")
    got = {r.t: r.h for r in d.select("t", X.value_hash("t").alias("h")).collect()}
    assert all(got[k] == hashlib.sha256(v.encode()).hexdigest() for k, v in forms.items())
    assert got[None] is None and got["{bad"] is None and got[""] is None and got["[" * 100_000] is None
