import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import packing as P

SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9), st.integers(1, 30))
def test_fullest_is_the_fullest(sizes, room):
    counts = {n: sizes.count(n) for n in set(sizes)}
    got = P.fullest(sorted(counts, reverse=True), counts, room)
    best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
    assert sum(n * k for n, k in got) == best and all(0 < k <= counts[n] for n, k in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_no_window_is_too_full(sizes):
    x = np.array(sizes, np.int64)
    w = P.pack_lengths(x, 50)
    if len(x):
        load = np.bincount(w, weights=x)
        assert load.max() <= 50 and load.min() > 0 and len(load) <= len(x)
        assert len(load) <= 2 * -(-x.sum() // 50) + 1


def test_close_to_the_bound():
    r = random.Random(1)
    x = np.array([min(256, max(1, int(r.expovariate(1 / 60)))) for _ in range(5000)])
    assert P.pack_lengths(x, 256).max() + 1 <= 1.002 * x.sum() / 256 + 1


def check(packed, docs, windows):
    rows = packed.collect()
    for name, capacity in windows.items():
        mine = [r for r in rows if r.window_name == name]
        load = {}
        for r in mine:
            if r.window_id is not None:
                load[r.window_id] = load.get(r.window_id, 0) + r.n_tokens
        assert max(load.values(), default=0) <= capacity
        for doc, n in docs.items():
            parts = sorted((r.part, r.token_start, r.n_tokens) for r in mine if r.doc_id == doc)
            assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [i * capacity for i in range(len(parts))]
            assert len(parts) == max(1, -(-n // capacity))
    return rows


def test_whole_corpus(spark):
    from cairn.llm.bpe import count_tokens

    d = spark.read.parquet(f"{SF}/documents.parquet")
    w = spark.read.parquet(f"{SF}/context_windows.parquet")
    docs = {r.doc_id: r.n_tokens for r in count_tokens(d).collect()}
    kinds = {r.window_name: r.capacity_tokens for r in w.collect()}
    check(P.pack_windows(d, w), docs, kinds)
    check(P.pack_windows(d, w, shard_windows=1, shard_pieces=20), docs, kinds)


def test_cases(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "one two three", 5), (3, "one two three", 5), (None, "word", 5), (4, "word " * 999 + "word", 5)], "doc_id bigint, text string, capacity int")
    w = spark.createDataFrame([("s", "byte_bpe_50k", 10, 1), (None, "byte_bpe_50k", 10, 1), ("z", "byte_bpe_50k", 0, 1)], "window_name string, tokenizer string, capacity_tokens int, part int")
    rows = P.pack_windows(d, w).collect()
    assert {r.window_name for r in rows} == {"s"} and len(rows) == 2 + 2 + 1 + 100
    assert {r.doc_id for r in rows if r.window_id is None} == {1, 2}
    full = [r.window_id for r in rows if r.doc_id == 4]
    assert len(set(full)) == 100
    assert P.pack_windows(d.limit(0), w).isEmpty() and P.pack_windows(d, w.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        P.pack_windows(d, w.selectExpr("'s' window_name", "'none' tokenizer", "9 capacity_tokens"))
