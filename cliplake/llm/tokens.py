"""Encoding of a whole corpus with a public byte-level BPE vocabulary by merge replay.

Texts are split into words by the vocabulary's pattern. Merging never crosses a word, so the corpus is encoded
as the table of its distinct words: they are counted in a first pass over the texts (summed in the tasks, so
only distinct words are shuffled), then each partition of the table holds an inverted index from token pair to
word positions, applies every merge in rank order to all its occurrences at once, and only the touched
neighbours change the index. A second pass looks the words up; no text is shuffled.

The looked-up table goes to every task, so its size is bounded: the SHARED_WORDS most frequent words of at
most SHARED_LENGTH characters. Rarer or longer words are encoded by the same replay where they are met, over
all such words of a slice of rows together; the ids are the same either way. The vocabulary is a fixed file
every executor reads from its own path.

Defined results: a NULL text and an empty text have an empty list of ids; repeated rows repeat; texts
are encoded whole, without special tokens (their names are ordinary text).
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.session import written
from cliplake.sources.tables import table

#: Where the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: The split pattern of the vocabulary (fixed value, from its description).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, where it is faster.
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Words remembered per task; a full memory is emptied.
MEMORY = 500_000
#: Bounds of the table that every task gets: words, and characters of a word.
SHARED_WORDS, SHARED_LENGTH = 200_000, 64
#: Rows encoded at a time; the words of earlier ones are remembered.
SLICE_ROWS = 1024


@lru_cache(4)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of every word, by applying all merges in rank order over all words together.

    The words lie in one array of token ids with links to both neighbours; index[pair] holds the left
    positions of the pair, a heap the ranks of the pairs that occur. As a pair's rank is the id of the token
    it makes, and a merge only makes pairs of higher rank, each pair is taken once, complete.
    """
    flat = b"".join(words)
    size = len(flat)
    byte_id = [ranks[bytes([b])] for b in range(256)]
    token = [byte_id[b] for b in flat]
    span = [1] * size  # bytes of the token that begins here, 0 inside a token
    ends = np.cumsum([len(w) for w in words]).tolist() if words else []
    right, left = list(range(1, size + 1)), list(range(-1, size - 1))
    for e in [0, *ends]:
        if e < size:
            left[e] = -1
        if 0 < e <= size:
            right[e - 1] = -1
    made: dict[tuple[int, int], int | None] = {}
    text_of: dict[int, bytes] = {}
    index: dict[int, dict[int, None]] = defaultdict(dict)  # made token -> left positions, in order
    heap: list[int] = []

    def note(i: int) -> None:
        j = right[i]
        if j < 0:
            return
        pair = (token[i], token[j])
        if pair in made:
            rank = made[pair]
        else:
            rank = made[pair] = ranks.get(flat[i : j + span[j]])
        if rank is not None:
            if not (held := index[(rank)]):
                heapq.heappush(heap, rank)
            held[i] = None

    for i in range(size):
        note(i)
    while heap:
        rank = heapq.heappop(heap)
        for i in sorted(index.pop(rank, ())):
            j = right[i]
            if span[i] == 0 or j < 0 or ranks.get(flat[i : j + span[j]]) != rank:
                continue  # a merge of the same rank to the left has taken one of the two
            token[i], span[i], span[j] = rank, span[i] + span[j], 0
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            note(i)
            if left[i] >= 0:
                note(left[i])
    out, at = [], 0
    for e in ends:
        ids = []
        while at < e:
            ids.append(token[at])
            at += span[at]
        out.append(ids)
    return out


def splitter():
    """Text -> its words."""
    whole, plain = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
    return lambda text: plain(text) if text.isascii() else whole(text)


class Encoder:
    """Texts to ids; words of the shared table are looked up, others replayed and remembered (bounded)."""

    def __init__(self, path: str, shared: dict[str, list[int]] | None = None) -> None:
        self.ranks, self.split = vocabulary(path), splitter()
        self.shared = shared or {}
        self.known = dict(self.shared)

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        parts = [None if t is None else self.split(t) for t in texts]
        fresh = list({w for p in parts if p for w in p if w not in self.known})
        if len(self.known) + len(fresh) > MEMORY + len(self.shared):
            self.known = dict(self.shared)
            fresh = list({w for p in parts if p for w in p if w not in self.known})
        encoded = replay([w.encode("utf-8", "surrogatepass") for w in fresh], self.ranks)
        self.known.update(zip(fresh, encoded))
        known = self.known
        return [None if p is None else [i for w in p for i in known[w]] for p in parts]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS))


def corpus_words(texts: DataFrame) -> DataFrame:
    """word, n: every distinct word of the one column of texts, with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(), Counter()

        def send() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return found

        for b in _slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(split(t))
            if len(counts) > MEMORY:
                yield send()
        if counts:
            yield send()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(texts: DataFrame, vocab: str) -> DataFrame:
    """word, ids: merges replayed over the corpus's distinct words, the SHARED_WORDS most frequent ones at most.

    Words are kept by the power of two of their frequency, so the bound needs no order of all words.
    """
    words = written(corpus_words(texts).where(F.length("word") <= SHARED_LENGTH).withColumn("power", F.floor(F.log2("n")).cast("int")), "words")
    room, least = SHARED_WORDS, None
    for r in sorted(words.groupBy("power").count().collect(), reverse=True):  # at most 64 numbers
        if (room := room - r["count"]) < 0:
            break
        least = r.power
    kept = words.where(F.col("power") >= least) if least is not None else words.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [w for b in batches for w in b.column(0).to_pylist()]
        ids = replay([w.encode() for w in mine], vocabulary(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return kept.select("word").repartition("word").mapInArrow(run, "word string, ids array<int>")


def _encoded(df: DataFrame, key: str, text: str, vocab: str, ddl: str, answer) -> DataFrame:
    """``key`` and ``answer(ids of the text)`` of every row."""
    rows = df.select(key, text)
    table_ = {r.word: r.ids for r in encoded_words(df.select(text), vocab).collect()}  # at most SHARED_WORDS
    shared = df.sparkSession.sparkContext.broadcast(table_)
    kind = pa.list_(pa.int32()) if "array" in ddl else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab, shared.value)
        for b in _slices(batches):
            found = [answer(i or []) for i in encoder.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [key, ddl.split()[0]])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {ddl}")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """``key``, ids."""
    return _encoded(df, key, text, vocab, "ids array<int>", lambda ids: ids)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """``key``, n_tokens (0 for a NULL text)."""
    return _encoded(df, key, text, vocab, "n_tokens bigint", len)


def p8_ids(spark, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, folder, "documents"))
