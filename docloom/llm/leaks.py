"""Evaluation texts leaking into a training corpus, by an FM-index per shard.

The phrases of the evaluation items (13 words; 26 letters or numbers for items
in Japanese or Chinese) are compiled once: their words, or characters, are the
alphabet. Each task turns its documents into symbols of that alphabet block by
block, keeps the stretches in which a phrase could lie at all (symbols outside
the alphabet separate), and builds an FM-index of the block: a suffix array in
which every stretch ends with a terminator of its own, its Burrows-Wheeler
transform in a wavelet tree, and every 32nd suffix position. All phrases are
searched backwards together; their occurrences are located by walking to the
nearest sampled position and merged into spans per document and item.

Only spans leave a task. The compiled items are broadcast while they are small;
a larger set of items is searched in groups of bounded size, one pass each.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import spread

PHRASE_WORDS, PHRASE_CHARS = 13, 26
#: Languages whose items are compared letter by letter as well.
UNSPACED = ("ja", "zh")
#: Characters of items searched in one pass, symbols of an index block, and distance of sampled positions.
ITEM_CHARS, BLOCK_SYMBOLS, SAMPLE = 4_000_000, 1 << 19, 32

_TOKEN = re.compile(r"[^\W_]+")

SPANS = "doc_id long, item_id long, unit string, span_start int, span_end int"


@functools.cache
def _format_characters() -> np.ndarray:
    """Of every code point whether it is a format character."""
    return np.array([unicodedata.category(chr(c)) == "Cf" for c in range(sys.maxunicode + 1)])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normal_text(text: str) -> str:
    """NFKC, lower case, no format characters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).lower()
    codes = _code_points(text)
    drop = _format_characters()[codes]
    return codes[~drop].tobytes().decode("utf-32-le", "surrogatepass") if drop.any() else text


def normal_words(text: str) -> list[str]:
    """The words of the normal text; everything that is neither letter nor number separates."""
    return _TOKEN.findall(normal_text(text))


@dataclass
class Phrases:
    """Distinct phrases of k symbols, and the items each comes from."""

    k: int
    symbols: dict[str, int]
    grams: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    #: Least number of non-ASCII symbols in a phrase; of every symbol whether it is one.
    special_least: int = 0
    special: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=bool))

    @staticmethod
    def compile(units: dict[int, list[str]], k: int) -> Phrases:
        symbols: dict[str, int] = {}
        owners: dict[tuple, set[int]] = {}
        for item, row in units.items():
            if len(row) >= k:
                codes = [symbols.setdefault(u, len(symbols) + 1) for u in row]
                for i in range(len(codes) - k + 1):
                    owners.setdefault(tuple(codes[i : i + k]), set()).add(item)
        grams = np.array(sorted(owners), dtype=np.int64).reshape(-1, k)
        lists = [sorted(owners[tuple(g)]) for g in grams.tolist()]
        special = np.array([False] + [not u.isascii() for u in symbols])
        return Phrases(k, symbols, grams, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), np.array([i for x in lists for i in x], dtype=np.int64), int(special[grams].sum(axis=1).min()) if len(grams) else 0, special)


@dataclass
class Items:
    words: Phrases
    chars: Phrases
    code_of: np.ndarray

    @staticmethod
    def compile(rows: list[dict]) -> Items:
        words = {r["item_id"]: normal_words(r["text"]) for r in rows if r["text"] is not None and r["item_id"] is not None}
        unspaced = {r["item_id"] for r in rows if (r["lang"] or "").lower().split("-")[0] in UNSPACED}
        chars = Phrases.compile({i: list("".join(w)) for i, w in words.items() if i in unspaced}, PHRASE_CHARS)
        table = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for ch, n in chars.symbols.items():
            table[ord(ch)] = n
        return Items(Phrases.compile(words, PHRASE_WORDS), chars, table)


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Sorted suffixes of ``text``, whose zeros are terminators that differ by position.

    The first sort takes as many symbols as fit one integer; each further round
    doubles the compared length, for suffixes that are still tied only.
    """
    n, width = len(text), max(1, 62 // bits)
    zero = np.flatnonzero(text == 0)
    stop = zero[np.searchsorted(zero, np.arange(n))]  # the terminator at or after each position
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        at = np.arange(j, n + j)
        key = key << bits | np.where(at <= stop, text[np.minimum(at, n - 1)], 0)
    sa = np.argsort(key, kind="stable")
    new = np.concatenate(([True], np.diff(key[sa]) != 0)) | (stop[sa] - sa < width)
    new[1:] |= (stop[sa] - sa < width)[:-1]
    k = width
    rank = np.empty(n, dtype=np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = group
    size = np.diff(np.append(np.flatnonzero(new), n))
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(slots):
        pos = sa[slots]
        both = rank[pos] * n + rank[pos + k]
        order = np.argsort(both, kind="stable")
        pos, both = pos[order], both[order]
        sa[slots] = pos
        new = np.concatenate(([True], np.diff(both) != 0))
        rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(slots)))
        slots = slots[np.repeat(size > 1, size)]
        k *= 2
    return sa


class WaveletTree:
    """Rank of a symbol up to a position; one bit plane per level, ones behind zeros."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.first = np.full(1 << bits, 0, dtype=np.int64)
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            before = ones[at]
            at = np.where((symbol >> level) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int):
        bits = max(1, int(alphabet).bit_length())
        sa = suffix_array(text, bits)
        self.last = text[sa - 1]
        self.tree = WaveletTree(self.last, bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 1))))
        self.size = len(text)
        # every 32nd position, and those no walk may pass: the beginnings of stretches
        sampled = (sa % SAMPLE == 0) | (self.last == 0)
        self.sampled, self.count, self.position = sampled, np.concatenate(([0], np.cumsum(sampled))), sa[sampled]

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of the phrases that occur: backward search, all phrases at once."""
        alive = np.arange(len(grams))
        lo, hi = np.zeros(len(grams), dtype=np.int64), np.full(len(grams), self.size, dtype=np.int64)
        for column in range(grams.shape[1] - 1, -1, -1):
            c = grams[alive, column]
            lo, hi = self.step(c, lo), self.step(c, hi)
            some = hi > lo
            alive, lo, hi = alive[some], lo[some], hi[some]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        rows, steps, todo = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while True:
            todo = todo[~self.sampled[rows[todo]]]
            if not len(todo):
                break
            rows[todo] = self.step(self.last[rows[todo]], rows[todo])
            steps[todo] += 1
        return self.position[self.count[rows]] + steps


def stretches(symbols: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal stretches made of windows in which a phrase of ``p`` could lie."""
    k, n = p.k, len(symbols)
    if n < k or not len(p.grams):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    other = np.concatenate(([0], np.cumsum(symbols == 0)))
    window = other[k:] == other[:-k]
    if p.special_least:
        special = np.concatenate(([0], np.cumsum(p.special[symbols])))
        window &= special[k:] - special[:-k] >= p.special_least
    edge = np.diff(np.concatenate(([0], window.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + k - 1
    # windows that overlap across a gap without a foreign symbol stay separate stretches; each window is whole in one
    return begin, end


class Block:
    """Documents gathered for one index of one kind of phrase."""

    def __init__(self, unit: str, phrases: Phrases):
        self.unit, self.phrases = unit, phrases
        self.clear()

    def clear(self) -> None:
        self.doc_ids: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.offset: list[np.ndarray] = []
        self.symbols = 0

    def add(self, doc_ids: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """Symbols of documents, one zero behind each; lengths count it."""
        begin, end = stretches(symbols, self.phrases)
        if not len(begin):
            return
        starts = np.cumsum(lengths) - lengths
        doc = np.searchsorted(starts, begin, side="right") - 1
        size = end - begin
        bounds = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[bounds + size] = False
        text[inside] = symbols[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.parts.append(text)
        self.doc.append(doc_ids[doc])
        self.offset.append(np.stack((bounds + self.symbols, begin - starts[doc])))
        self.symbols += len(text)

    def spans(self) -> list[tuple[np.ndarray, ...]]:
        """(doc_id, item_id, start, end) columns of the merged spans."""
        if not self.parts:
            return []
        text, docs, offset, p = np.concatenate(self.parts), np.concatenate(self.doc), np.concatenate(self.offset, axis=1), self.phrases
        self.clear()
        index = FMIndex(text, len(p.symbols))
        which, lo, hi = index.search(p.grams)
        if not len(which):
            return []
        count = hi - lo
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at, gram = index.locate(rows), np.repeat(which, count)
        stretch = np.searchsorted(offset[0], at, side="right") - 1
        doc, start = docs[stretch], at - offset[0][stretch] + offset[1][stretch]
        owners = p.starts[gram + 1] - p.starts[gram]
        item = p.items[np.repeat(p.starts[gram] - (np.cumsum(owners) - owners), owners) + np.arange(owners.sum())]
        doc, start = np.repeat(doc, owners), np.repeat(start, owners)
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start) > p.k)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        return [(doc[first], item[first], start[first], start[last] + p.k)]


def find_in_batches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    words, chars = Block("word", items.words), Block("char", items.chars)
    code = items.words.symbols

    def flush(b: Block) -> Iterator[pa.RecordBatch]:
        for doc, item, start, end in b.spans():
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(item), pa.array([b.unit] * len(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "item_id", "unit", "span_start", "span_end"])

    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        # a few documents at a time: a block ends soon after it is full, at the end of a document
        begin = 0
        while begin < len(texts):
            size, end = 0, begin
            while end < len(texts) and size < BLOCK_SYMBOLS:
                size += len(texts[end]) // 4
                end += 1
            rows = [normal_words(t) for t in texts[begin:end]]
            lengths = np.array([len(r) + 1 for r in rows], dtype=np.int64)
            for r in rows:
                r.append("")  # no word: separates the documents
            known = code.get
            flat = [known(w, 0) for w in itertools.chain.from_iterable(rows)]
            words.add(ids[begin:end], np.array(flat, dtype=np.int64), lengths)
            if len(items.chars.grams):
                solid = ["".join(r) for r in rows]
                some = [i for i, s in enumerate(solid) if not (items.chars.special_least and s.isascii())]
                if some:
                    joined = "\0".join([solid[i] for i in some] + [""])
                    symbols = items.code_of[_code_points(joined)]
                    chars.add(ids[begin:end][some], symbols.astype(np.int64), np.array([len(solid[i]) + 1 for i in some], dtype=np.int64))
            begin = end
            for b in (words, chars):
                if b.symbols >= BLOCK_SYMBOLS:
                    yield from flush(b)
    yield from flush(words)
    yield from flush(chars)


def item_groups(items: DataFrame, limit: int = ITEM_CHARS) -> list[Items]:
    """The items compiled in groups of about ``limit`` characters; one group as long as they are few."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-total // limit))
    one = lambda g: rows if groups == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
    return [Items.compile(one(g).toArrow().to_pylist()) for g in range(groups)]


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, unit, span_start, span_end): merged stretches of documents that occur in items.

    Positions count the normalised words of a document, or its letters and
    numbers without separators. Null texts and ids are ignored; items without a
    full phrase have no case. Equal items under several ids are each reported.
    """
    spark, out = documents.sparkSession, None
    rows = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
    for group in item_groups(items):
        shared = spark.sparkContext.broadcast(group)
        found = rows.mapInArrow(lambda batches, shared=shared: find_in_batches(batches, shared.value), SPANS)
        out = found if out is None else out.unionByName(found)
    return out


def word_offsets(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text``, in code points, of every normalised word.

    Each line is normalised by grapheme cluster, so that every normalised
    character has a place. Where that differs from the line as a whole, its
    characters have the whole line as their place. Lower-casing keeps count of
    the characters: only the final sigma depends on its neighbours, and it is
    one character either way.
    """
    import regex

    places, at, joined = [], 0, []
    for line in re.split(r"(?<=\n)", text):
        parts, own = [], []
        for m in regex.finditer(r"\X", line):
            piece = unicodedata.normalize("NFKC", m.group())
            parts.append(piece)
            own += [(at + m.start(), at + m.end())] * len(piece)
        normal = "".join(parts)
        whole = unicodedata.normalize("NFKC", line)
        if normal != whole:
            bare = line.rstrip("\r\n")
            normal, own = whole, [(at, at + len(bare))] * len(whole)
        joined.append(normal)
        places += own
        at += len(line)
    normal = "".join(joined)
    lower = normal.lower()
    if len(lower) != len(normal):
        places = [place for ch, place in zip(normal, places) for _ in ch.lower()]
    drop = _format_characters()[_code_points(lower)]
    if drop.any():
        places = [place for place, gone in zip(places, drop.tolist()) if not gone]
    return [(places[m.start()][0], places[m.end() - 1][1]) for m in _TOKEN.finditer(normal_text(text))]


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): what to cut out of each document, in code points of its text.

    The spans of all items of a document are merged where they touch or overlap.
    Only documents with a leak are read again. Should the characters of a line
    have no places of their own, the line is cut out, never more.
    """
    spans = leaked_spans(documents, items).groupBy("doc_id").agg(F.collect_set(F.struct("unit", "span_start", "span_end")).alias("spans"))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = word_offsets(text)
                letters = np.repeat(np.arange(len(words)), [len(w) for w in normal_words(text)])
                cut = []
                for s in own:
                    first, last = s["span_start"], s["span_end"] - 1
                    if s["unit"] == "char":
                        first, last = letters[first], letters[last]
                    cut.append((words[first][0], words[last][1]))
                cut.sort()
                merged = [cut[0]]
                for a, z in cut[1:]:
                    if a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
                    else:
                        merged.append((a, z))
                out += [(doc, a, z) for a, z in merged]
            if out:
                d, a, z = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["doc_id", "span_start", "span_end"])

    return texts.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(place, "doc_id long, span_start int, span_end int")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the documents that share a phrase with an item."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()
