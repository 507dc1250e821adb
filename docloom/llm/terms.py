"""Frequency of every distinct term, read from per-term record bitmaps.

Vertical layout: every record has a number, a chunk and 15 low bits, which a
record map ties to its id. Each task builds, per term and chunk, a compressed
bitmap of the low bits it has seen (a sorted uint16 list, or plain bits once
that is shorter) and an occurrence counter. The bitmaps of one term and chunk
from different tasks meet and are united; a record that comes twice is one bit.
A term's document frequency is the sum of the cardinalities of its chunks.

Chunks follow the hash that spreads the records over tasks, so a task holds few
chunks and its bitmaps are dense. A frequent term is spread over as many groups
as there are chunks, and its cardinalities are summed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Maximal runs of letters, numbers and underscores.
WORD = r"[\p{L}\p{N}_]+"

#: Bits of a record number within its chunk, and records a chunk has on average at most.
LOW_BITS, CHUNK_RECORDS = 15, 1 << 14

BITMAPS = "field_name string, chunk long, term string, dense boolean, bits binary, occurrences long"
UNITED = "field_name string, term string, chunk long, records long, occurrences long, dense boolean, bits binary"

#: How the raw values of a field become terms; blank terms are dropped.
NORMALISERS: dict[str, Callable[[str], str]] = {"text": str.lower, "identifiers": lambda s: s.strip(" ") if s.strip() else ""}


def one_row_per_record(rows: DataFrame, record: str, value: str) -> DataFrame:
    """(record_id, value): redelivered rows meet before the shuffle; if rows disagree, the greatest value counts."""
    return rows.where(F.col(record).isNotNull()).groupBy(F.col(record).alias("record_id")).agg(F.max(value).alias("value"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def chunk_buckets(records: int, partitions: int) -> int:
    """Hash buckets that become chunks: a divisor or a multiple of the shuffle's partitions, so that both are told by one hash."""
    want = max(1, -(-records // CHUNK_RECORDS))
    if want > partitions:
        return partitions * -(-want // partitions)
    return next(b for b in range(want, partitions + 1) if partitions % b == 0)


def record_numbers(ids: DataFrame, records: int) -> DataFrame:
    """(record_id, chunk, low): the record map. ``records`` is the number of distinct ids, up to which chunks are filled evenly.

    A record's number is its place among the ids of its hash bucket, so it does
    not depend on which task numbers it. Buckets hold some 16,384 ids.
    """
    partitions = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = chunk_buckets(records, partitions)
    rows = ids.where("record_id IS NOT NULL").select("record_id", F.pmod(F.hash("record_id"), F.lit(buckets)).cast("long").alias("bucket")).distinct()
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("record_id")).cast("long") - 1
    return rows.select("record_id", "bucket", place.alias("place")).select("record_id", (F.col("bucket") + F.lit(buckets) * F.shiftright("place", LOW_BITS)).alias("chunk"), F.col("place").bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int").alias("low"))


def _compress(names: list[pa.Array], owner: np.ndarray, low: np.ndarray, cardinality: np.ndarray, counters: list[np.ndarray], schema: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch of sparse and one of dense bitmaps; ``owner`` (ascending) and ``low`` are the set bits of each."""
    high = np.zeros(len(cardinality), dtype=np.int64)
    np.maximum.at(high, owner, low)
    dense = cardinality * 2 > high // 8 + 1
    for is_dense in (False, True):
        which = np.flatnonzero(dense == is_dense)
        if not len(which):
            continue
        if is_dense:
            size = high[which] // 8 + 1
            begin = np.cumsum(size) - size
            flat = np.zeros(int(size.sum()), dtype=np.uint8)
            own = np.repeat(dense, cardinality)
            at = np.repeat(begin, cardinality[which]) * 8 + low[own]
            np.bitwise_or.at(flat, at >> 3, (1 << (at & 7)).astype(np.uint8))
        else:
            size = cardinality[which] * 2
            flat = low[np.repeat(~dense, cardinality)].astype("<u2")
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        bits = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
        take = pa.array(which)
        yield pa.RecordBatch.from_arrays([*(n.take(take) for n in names), *(pa.array(c[which].astype(np.int64)) for c in counters), pa.array(np.full(len(which), is_dense)), bits], names=schema)


def block_bitmaps(field: str, chunks: np.ndarray, lows: np.ndarray, terms: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """The bitmaps of a block of records: one per term and chunk."""
    raw = terms.flatten()
    lengths = np.asarray(terms.value_lengths().fill_null(0), dtype=np.int64)
    coded = raw.dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    clean = [NORMALISERS[field](s) if s is not None else "" for s in coded.dictionary.to_pylist()]
    number: dict[str, int] = {}
    remap = np.array([number.setdefault(s, len(number)) if s else -1 for s in clean] + [-1], dtype=np.int64)
    code = remap[np.asarray(coded.indices.fill_null(len(clean)), dtype=np.int64)]
    own, local = np.unique(chunks, return_inverse=True)
    group, low = code * len(own) + np.repeat(local, lengths), np.repeat(lows, lengths)
    group, low = group[code >= 0], low[code >= 0]
    if not len(group):
        return
    groups, group = np.unique(group, return_inverse=True)
    occurrences = np.bincount(group, minlength=len(groups))
    pairs = np.unique(group << LOW_BITS | low)
    owner = pairs >> LOW_BITS
    names = pa.array(list(number), pa.string()).take(pa.array(groups // len(own)))
    label = pa.array([field], pa.string()).take(pa.array(np.zeros(len(groups), dtype=np.int64)))
    for b in _compress([label, names], owner, pairs & ((1 << LOW_BITS) - 1), np.bincount(owner, minlength=len(groups)), [own[groups % len(own)], occurrences], ["field_name", "term", "chunk", "occurrences", "dense", "bits"]):
        yield b.select(["field_name", "chunk", "term", "dense", "bits", "occurrences"])


def term_bitmaps(records: DataFrame) -> DataFrame:
    """The vertical index of ``(field_name, chunk, low, terms)`` rows: bitmaps per task, term and chunk.

    A null list is a record without terms. Null and blank terms are ignored. A
    record that occurs in several rows is one bit wherever it occurs; its
    occurrences count for every row.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fields = rows.column(0).to_pylist()
            for field in sorted(set(fields)):
                own = rows if len(set(fields)) == 1 else rows.filter(pa.array([f == field for f in fields]))
                yield from block_bitmaps(field, own.column(1).to_numpy(), own.column(2).to_numpy().astype(np.int64), own.column(3))

    return records.select("field_name", "chunk", "low", "terms").mapInArrow(build, BITMAPS)


def positions(dense: np.ndarray, bits: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, low) of all set bits of the bitmaps, rows ascending."""
    row, low = [], []
    for is_dense in (False, True):
        which = np.flatnonzero(dense == is_dense)
        if not len(which):
            continue
        own = bits.take(pa.array(which))
        size = np.diff(np.frombuffer(own.buffers()[1], dtype=np.int32, count=len(own) + 1, offset=own.offset * 4)).astype(np.int64)
        first = int(np.frombuffer(own.buffers()[1], dtype=np.int32, count=1, offset=own.offset * 4)[0])
        data = np.frombuffer(own.buffers()[2] or b"", dtype=np.uint8)[first : first + int(size.sum())]
        if is_dense:
            at = np.flatnonzero(np.unpackbits(data, bitorder="little"))
            byte_row = np.repeat(np.arange(len(own)), size)
            r = byte_row[at >> 3]
            row.append(which[r])
            low.append(at - (np.cumsum(size) - size)[r] * 8)
        else:
            row.append(np.repeat(which, size // 2))
            low.append(data.view("<u2").astype(np.int64))
    if not row:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row, low = np.concatenate(row), np.concatenate(low)
    order = np.argsort(row, kind="stable")
    return row[order], low[order]


def _unite(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The united bitmaps of rows whose groups (field, term, chunk) are adjacent and whole."""
    field, chunk, term = (rows.column(i).combine_chunks() for i in range(3))
    new = _starts(rows)
    first = np.flatnonzero(new)
    owner = np.cumsum(new) - 1
    occurrences = np.add.reduceat(rows.column(5).to_numpy(), first)
    row, low = positions(rows.column(3).to_numpy().astype(bool), rows.column(4).combine_chunks())
    pairs = owner[row] << LOW_BITS | low
    pairs = np.unique(pairs) if len(first) < len(owner) else pairs  # nothing to unite where every group is one bitmap
    group = pairs >> LOW_BITS
    records = np.bincount(group, minlength=len(first))
    take = pa.array(first)
    for b in _compress([field.take(take), term.take(take), chunk.take(take)], group, pairs & ((1 << LOW_BITS) - 1), records, [records, occurrences], [x.split()[0] for x in UNITED.split(", ")]):
        yield b


def _starts(rows: pa.Table) -> np.ndarray:
    """Whether each row begins a group of equal (field, term, chunk)."""
    new = np.ones(rows.num_rows, dtype=bool)
    same = np.ones(rows.num_rows - 1, dtype=bool)
    for i in range(3):
        c = rows.column(i).combine_chunks()
        same &= np.asarray(pc.equal(c.slice(1), c.slice(0, len(c) - 1)))
    new[1:] = ~same
    return new


def unite_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """(field_name, term, chunk, records, occurrences, dense, bits): one bitmap per term and chunk, with its cardinality."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(np.flatnonzero(_starts(rows))[-1])  # the last group may go on in the next batch
            if last:
                yield from _unite(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from _unite(held)

    key = ["field_name", "term", "chunk"]
    return bitmaps.repartition(*key).sortWithinPartitions(*key).mapInArrow(unite, UNITED)


def term_frequencies(united: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records): document frequencies as cardinalities of united bitmaps."""
    return united.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(frequencies: DataFrame, totals: DataFrame, rare_records: int = 1, common_percent: int = 10) -> DataFrame:
    """Adds ``mark``: 'rare' up to ``rare_records`` records, else 'common' above ``common_percent`` of all records, else null.

    ``totals`` has one (field_name, total) row per field.
    """
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * 100 > F.col("total") * common_percent, "common")
    return frequencies.join(F.broadcast(totals), "field_name").withColumn("mark", mark).drop("total")  # one row per field


def _field_rows(sections: DataFrame, work_items: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    return {"text": (sections, "text"), "identifiers": (work_items, "identifiers")}


def record_totals(sections: DataFrame, work_items: DataFrame) -> dict[str, int]:
    """The number of records of each field: distinct non-null section_ids of its table."""
    one = lambda f, rows: rows.agg(F.lit(f).alias("field_name"), F.countDistinct("section_id").alias("total"))
    parts = [one(f, rows) for f, (rows, _) in _field_rows(sections, work_items).items()]
    return {r.field_name: r.total for r in parts[0].unionByName(parts[1]).collect()}


def corpus_records(sections: DataFrame, work_items: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(field_name, record_id, chunk, low): the record map of both fields."""
    parts = [record_numbers(rows.select(F.col("section_id").alias("record_id")), totals[f]).select(F.lit(f).alias("field_name"), "record_id", "chunk", "low") for f, (rows, _) in _field_rows(sections, work_items).items()]
    return parts[0].unionByName(parts[1])


def corpus_bitmaps(sections: DataFrame, work_items: DataFrame, totals: dict[str, int]) -> DataFrame:
    """The united bitmaps of the words of ``text`` and the values of ``identifiers``.

    A record is a distinct non-null section_id of its table, with or without
    terms; of rows that disagree the greatest value counts. The map meets the
    records where they have been made distinct, so texts are shuffled once.
    """
    parts = []
    for field, (rows, value) in _field_rows(sections, work_items).items():
        records = one_row_per_record(rows, "section_id", value)
        numbers = record_numbers(rows.select(F.col("section_id").alias("record_id")), totals[field])
        terms = words(F.col("value")) if field == "text" else F.col("value")
        parts.append(records.join(numbers.hint("shuffle_hash"), "record_id").select(F.lit(field).alias("field_name"), "chunk", "low", terms.alias("terms")))
    return unite_bitmaps(term_bitmaps(parts[0].unionByName(parts[1])))


def corpus_terms(sections: DataFrame, work_items: DataFrame) -> DataFrame:
    """Frequencies and marks of the words of ``text`` and the values of ``identifiers``.

    A record is a distinct non-null section_id of its table, with or without
    terms. Empty tables give no terms. Other columns are ignored.
    """
    totals = record_totals(sections, work_items)
    united = corpus_bitmaps(sections, work_items, totals)
    rows = sections.sparkSession.createDataFrame(list(totals.items()), "field_name string, total long")
    return mark_terms(term_frequencies(united), rows)
