"""Encoding of a corpus by a public byte-level BPE vocabulary.

The words of a batch of texts are found by the vocabulary's pattern and each different word is
encoded once. All new words of the batch lie behind one another in one array of symbols. An
index maps each mergeable pair to all its positions; the active ranks are applied in ascending
order, and each merge updates only the lists of the two pairs that it makes. A word's cost is
therefore near-linear in its length, also for a run of a million letters.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files lie, on the driver.
FOLDER = "/opt/tokenizers"
#: Characters of text whose words are indexed together, and bounds of a worker's memo.
BATCH_CHARS, MEMO_WORDS, MEMO_CHARS = 4_000_000, 200_000, 48


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class PairIndexBpe:
    """Byte-level BPE; ``pairs`` maps (left id, right id) to (rank, merged id)."""

    def __init__(self, byte_ids: list[int], pairs):
        self.byte_ids, self.pairs = byte_ids, pairs
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_bytes(cls, name: str, data: bytes) -> PairIndexBpe:
        """From the contents of a ``.json`` file (merge list) or a ``.tiktoken`` file (ranks)."""
        if name.endswith(".json"):
            model = json.loads(data)["model"]
            ids = model["vocab"]
            pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
            return cls([ids[x] for x in _byte_letters()], pairs)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        return cls([ranks[bytes([b])] for b in range(256)], _JoinedPairs(ranks))

    def encode_words(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        """The ids of each word, by one pass over the ranks that occur in any of them."""
        symbol: list[int] = []
        follow: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        byte_ids, pairs = self.byte_ids, self.pairs
        places: dict[tuple[int, int, int, int], list[int]] = {}
        active: list[tuple[int, int, int, int]] = []

        def note(left: int, right: int, at: int) -> None:
            found = pairs.get((left, right))
            if found is not None:
                key = (found[0], left, right, found[1])
                if key in places:
                    places[key].append(at)
                else:
                    places[key] = [at]
                    heapq.heappush(active, key)

        for word in words:
            first = len(symbol)
            starts.append(first)
            symbol.extend([byte_ids[b] for b in word.encode("utf-8", "surrogatepass")])
            end = len(symbol)
            before.append(-1)
            before.extend(range(first, end - 1))
            follow.extend(range(first + 1, end))
            follow.append(-1)
            for i in range(first, end - 1):
                note(symbol[i], symbol[i + 1], i)
        while active:
            key = heapq.heappop(active)
            _, left, right, merged = key
            at = places.pop(key)
            at.sort()
            for i in at:
                j = follow[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = merged, -1
                k = follow[i] = follow[j]
                if k >= 0:
                    before[k] = i
                    note(merged, symbol[k], i)
                if (h := before[i]) >= 0:
                    note(symbol[h], merged, h)
        out = []
        for first in starts:
            ids = []
            i = first
            while i >= 0:
                ids.append(symbol[i])
                i = follow[i]
            out.append(tuple(ids))
        return out

    def _words(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """Words of each text, in runs of bounded size, all of whose words are in the memo."""
        run: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            run.append(self.split(text) if text else [])
            size += len(text or "")
            if size >= BATCH_CHARS or i == len(texts) - 1:
                new = [w for w in set(chain.from_iterable(run)) if w not in self.memo]
                self.memo.update(zip(new, self.encode_words(new)))
                yield run
                if len(self.memo) > MEMO_WORDS:
                    self.memo.clear()
                else:
                    for w in new:
                        if len(w) > MEMO_CHARS:
                            del self.memo[w]
                run, size = [], 0

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text in turn; null and empty texts give none."""
        for run in self._words(texts):
            look = self.memo.__getitem__
            for words in run:
                yield list(chain.from_iterable(map(look, words)))

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [sum(map(len, map(self.memo.__getitem__, words))) for run in self._words(texts) for words in run]


class _JoinedPairs:
    """Pairs of a rank file: two tokens merge if their joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}

    def get(self, pair: tuple[int, int]) -> tuple[int, int] | None:
        rank = self.ranks.get(self.bytes[pair[0]] + self.bytes[pair[1]])
        return None if rank is None else (rank, rank)


class _Library:
    """The other kinds of public tokenizers, by their own libraries."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            model = Tokenizer.from_buffer(data)
            model.encode_special_tokens = True
            self._encode = lambda texts: [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        yield from self._encode([x or "" for x in texts])

    def count_batch(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.encode_batch(texts)]


#: Files of the public tokenizers by name.
FILES = {
    "byte_bpe_50k": "byte_bpe_50k.json",
    "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken",
    "word_bpe_49k": "word_bpe_49k.json",
    "piece_bpe_32k": "piece_bpe_32k.model",
}
_loaded: dict[str, PairIndexBpe | _Library] = {}


class SharedTokenizer:
    """A vocabulary file read on the driver and broadcast (its size is fixed, under 2 MB)."""

    def __init__(self, spark, name: str, folder: str = FOLDER):
        if name not in FILES:
            raise ValueError(f"no public tokenizer is named {name}; there are {', '.join(FILES)}")
        self.name = name
        with open(os.path.join(folder, FILES[name]), "rb") as f:
            self.data = spark.sparkContext.broadcast(f.read())

    def load(self) -> PairIndexBpe | _Library:
        """The tokenizer in this worker, built once."""
        if self.name not in _loaded:
            kind = PairIndexBpe.from_bytes if self.name.startswith("byte_bpe") else _Library
            _loaded[self.name] = kind(FILES[self.name], self.data.value)
        return _loaded[self.name]


#: Texts that are held as Python objects at once, in characters and rows.
SLICE_CHARS, SLICE_ROWS = 8_000_000, 2_000


def text_slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds a bounded amount of text, one text at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if i > first and (total + n > SLICE_CHARS or i - first >= SLICE_ROWS):
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(sizes):
            yield batch.slice(first)


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Each text as token ids: ``id_col`` and ``ids`` (array of int), one row for each input row.

    Special tokens are never added, and strings that look like one are ordinary text. Null and
    empty texts give an empty list; blank text gives the ids of its white space. Repeated rows
    stay, a null id stays null, other columns are ignored, an empty table gives an empty one.
    """
    shared = SharedTokenizer(docs.sparkSession, tokenizer, folder)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.load()
        for b in text_slices(batches, "text"):
            ids = pa.array(model.encode_batch(b.column("text").to_pylist()), pa.list_(pa.int32()), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=[id_col, "ids"])

    return spread(source, 2).mapInArrow(run, f"`{id_col}` bigint, ids array<int>")


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The number of tokens of each text: ``id_col`` and ``n_tokens``; null and empty texts have 0."""
    shared = SharedTokenizer(docs.sparkSession, tokenizer, folder)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.load()
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.count_batch(b.column("text").to_pylist()), pa.int64())], names=[id_col, "n_tokens"])

    return spread(source, 2).mapInArrow(run, f"`{id_col}` bigint, n_tokens bigint")
