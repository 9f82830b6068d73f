import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bpe as B

FOLDER = B.FOLDER
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def ours():
    with open(f"{FOLDER}/byte_bpe_50k.json", "rb") as f:
        return B.PairIndexBpe.from_bytes("x.json", f.read())


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab é'ls\n\t1<|>endoftxに", max_size=120))
def test_any_text_equals_the_library(ours, theirs, text):
    assert next(ours.encode_batch([text])) == theirs(text)


def test_long_runs_and_special_strings(ours, theirs):
    for text in ("a" * 50_001, " " * 3000 + "x", "<|endoftext|><|startoftext|>", "ab" * 20_000, "'ll've", "  x"):
        assert next(ours.encode_batch([text])) == theirs(text)


def test_rank_file(theirs):
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = B.PairIndexBpe.from_bytes("x.tiktoken", f.read())
    for text in ("Hello world, this is naïve", "def f(x):\n\treturn x + 1", "日本語のテキスト"):
        assert next(ranks.encode_batch([text])) == theirs(text)


def test_corpus(spark, theirs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.ids for r in B.encode_corpus(d).collect()}
    assert got == {r.doc_id: theirs(r.text) if r.text else [] for r in d.select("doc_id", "text").collect()}
    counts = {r.doc_id: r.n_tokens for r in B.count_tokens(d).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_cases(spark, theirs):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "a", "x"), (3, " ", "x"), (4, "word " * 100_000, "x")], "doc_id bigint, text string, ids string")
    rows = B.encode_corpus(d).collect()
    by = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 6 and by[1] == by[2] == [] and by[3] == theirs(" ") and by[None] == theirs("a") and len(by[4]) == 100_001
    assert B.encode_corpus(d.limit(0)).isEmpty() and dict(B.encode_corpus(d).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_vocabularies_count(spark, name):
    d = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in B.count_tokens(d, tokenizer=name).collect()}
    assert got[1] >= 2 and got[2] == 0


def test_unknown_name(spark):
    with pytest.raises(ValueError):
        B.encode_corpus(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), tokenizer="none")
