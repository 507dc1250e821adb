"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's pattern in the JVM and reach
Python as Arrow lists. Each batch is dictionary-encoded, so only words a task
has not met before are encoded, and the ids of documents are gathered by index.

Words are encoded by contiguous rank arrays: the parts of a word (at first its
bytes) and the rank of every adjacent pair lie side by side; the smallest rank is
found by a scan, the boundary between its parts is deleted, and the ranks left
and right of it are looked up again. Words of similar length are rows of one
matrix, so a scan, a deletion and a look-up are each one array operation for
thousands of words. Words beyond ``SHORT`` bytes, for which scanning would be
quadratic, hold the same ranks in a heap.

No shuffle: the encoding is a map over the documents.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import spread

#: The word pattern of the vocabulary (a fixed value), with Unicode white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int32(2**31 - 1)
SHORT = 256
#: Words one matrix holds at most, in bytes, and words a task remembers.
MATRIX_BYTES, REMEMBERED = 1 << 20, 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabularies keep ``name``; any other path can be passed instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    """Tokens by id, and for every mergeable pair of ids (left << 32 | right) the id it becomes."""

    tokens: list[bytes]
    pairs: np.ndarray
    merged: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a rank file: a base64 token and its rank per line."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        return Vocabulary(sorted(ranks, key=ranks.__getitem__), np.array(pairs, dtype=np.int64), np.array(merged, dtype=np.int32))


class Encoder:
    """Encodes words with a vocabulary; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.id_of = {t: i for i, t in enumerate(vocabulary.tokens)}
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], dtype=np.int32)
        bits = max(4, int(len(vocabulary.pairs) * 4).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        todo, step = np.arange(len(vocabulary.pairs)), 0
        while len(todo):  # each round puts one key per free slot
            slot = (self._slot(vocabulary.pairs[todo]) + step) & self.mask
            free = self.keys[slot] < 0
            slots, first = np.unique(slot[free], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.values[slots] = vocabulary.pairs[put], vocabulary.merged[put]
            todo, step = np.setdiff1d(todo, put, assume_unique=True), step + 1
        self.probes = step
        self.vocabulary, self.merge_of = vocabulary, None
        self.forget()

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> 32) * np.int64(0x9E3779B1)) * np.int64(0x2545F4914F6CDD1D)
        return mixed >> 24 & np.int64(0x7FFFFFFF)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair merges into, else NONE. Ids are ranks."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys) & self.mask
        out = np.full(len(keys), NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            at = slot[todo]
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
        return out

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of similar length: the rank arrays of all words side by side."""
        width = max(map(len, words))
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        parts = self.byte_id[raw]
        inside = np.arange(width - 1) < (n - 1)[:, None]
        rank = np.full((len(words), width - 1), NONE, dtype=np.int32)
        rank[inside] = self.ranks(parts[:, :-1][inside], parts[:, 1:][inside])
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        alive = np.arange(len(words))
        while len(alive):
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(alive), dtype=np.int64)
            least = rank[np.arange(len(alive)), j] if rank.shape[1] else np.full(len(alive), NONE)
            done = least == NONE
            for i in np.flatnonzero(done):
                out[alive[i]] = parts[i, : n[i]].copy()
            if done.any():
                go = ~done
                alive, parts, rank, n, j, least = alive[go], parts[go], rank[go], n[go], j[go], least[go]
                if not len(alive):
                    break
            row, wide = np.arange(len(alive)), parts.shape[1] - 1
            keep = np.arange(wide) + (np.arange(wide) > j[:, None])
            parts = np.take_along_axis(parts, keep, 1)
            parts[row, j] = least
            keep = np.arange(wide - 1) + (np.arange(wide - 1) >= j[:, None])
            rank = np.take_along_axis(rank, keep, 1) if wide > 1 else rank[:, :0]
            n = n - 1
            has = j < n - 1
            rank[row[has], j[has]] = self.ranks(parts[row[has], j[has]], parts[row[has], j[has] + 1])
            has = j > 0
            rank[row[has], j[has] - 1] = self.ranks(parts[row[has], j[has] - 1], parts[row[has], j[has]])
        return out

    def _heap(self, word: bytes) -> np.ndarray:
        """Ids of a long word: the same smallest-rank-first merges, leftmost among equals."""
        if self.merge_of is None:
            self.merge_of = dict(zip(self.vocabulary.pairs.tolist(), self.vocabulary.merged.tolist()))
        merge_of = self.merge_of
        parts = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        start = self.ranks(np.array(parts[:-1], dtype=np.int32), np.array(parts[1:], dtype=np.int32)).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(start) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < size:
                a, b = parts[i], parts[after[i]]
                r = merge_of.get(a << 32 | b)
                if r is not None:
                    heapq.heappush(heap, (r, i, a, b))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] >= size or parts[after[i]] != b:
                continue
            gone = after[i]
            parts[i], parts[gone], after[i] = r, -1, after[gone]
            if after[i] < size:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([p for p in parts if p >= 0], dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        rest = []
        for k, w in enumerate(words):
            whole = self.id_of.get(w)
            if whole is not None:
                out[k] = np.array([whole], dtype=np.int32)
            elif len(w) > SHORT:
                out[k] = self._heap(w)
            else:
                rest.append(k)
        rest.sort(key=lambda k: len(words[k]))
        begin = 0
        while begin < len(rest):
            # rows of up to a quarter more than the shortest, and of a bounded matrix
            size = len(words[rest[begin]])
            end = begin
            while end < len(rest) and len(words[rest[end]]) <= size + max(2, size // 4) and (end - begin) * size < MATRIX_BYTES:
                end += 1
            for k, ids in zip(rest[begin:end], self._matrix([words[k] for k in rest[begin:end]])):
                out[k] = ids
            begin = end
        return out

    def encode_lists(self, words: pa.ListArray) -> pa.ListArray:
        """The ids of every list of words, concatenated per list; a null list has none."""
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.number) + len(names) > REMEMBERED:
            self.forget()
        number = self.number
        fresh = [w for w in names if w not in number]
        if fresh:
            ids = self.encode_words([w.encode() for w in fresh])
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            for k, w in enumerate(fresh, len(self.lengths)):
                number[w] = k
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, *ids))
        code = np.array([number[w] for w in names], dtype=np.int64)[np.asarray(coded.indices)] if names else np.zeros(0, dtype=np.int64)
        lengths = self.lengths[code]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.ids[np.repeat(self.starts[code] - ends[:-1], lengths) + np.arange(ends[-1])] if len(code) else np.zeros(0, dtype=np.int32)
        bounds = np.concatenate(([0], np.cumsum(np.asarray(words.value_lengths().fill_null(0), dtype=np.int64))))
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(flat))


#: The encoder of a Python worker, kept between its tasks.
_ENCODERS: dict[str, Encoder] = {}


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def encode_corpus(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): every document's ids, without special tokens.

    Null and empty texts have an empty list. Strings of special tokens in a text
    are ordinary text. One row per input row, repeated rows included. The
    vocabulary is sent to the tasks once; its size is the file's.
    """
    name = path or vocabulary_path()
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.load(name))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(name)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[name] = Encoder(shared.value)
        for b in batches:
            ids = encoder.encode_lists(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["k", "ids"])

    rows = spread(documents.select(key, text)).select(F.col(key).alias("k"), split_words(F.col(text)).alias("words"))
    return rows.mapInArrow(encode, f"k {dict(documents.dtypes)[key]}, ids array<int>").select(F.col("k").alias(key), "ids")
