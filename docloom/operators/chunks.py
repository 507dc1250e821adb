"""Line-greedy overlapping chunks of sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "section_id string, chunk_no int, first_line int, last_line int, chunk string"


def line_chunks(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) line numbers, from 0: lines are added while they fit ``size``; a chunk begins with the last lines of the one before that reach ``overlap``.

    A line longer than ``size`` is a chunk of its own. An overlap of ``size`` or
    more counts as a quarter of it.
    """
    if overlap >= size:
        overlap = size // 4
    lines = text.splitlines(keepends=True)
    out, first, held, fresh = [], 0, 0, 0
    for n, line in enumerate(lines):
        if fresh and held + len(line) > size:
            out.append((first, n - 1))
            back, kept = n, 0
            while back > first and kept < overlap:
                back -= 1
                kept += len(lines[back])
            first, held, fresh = (back, kept, 0) if kept + len(line) <= size else (n, 0, 0)
        held, fresh = held + len(line), fresh + 1
    return out + ([(first, len(lines) - 1)] if fresh else [])


def chunk_sections(sections: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """The chunks of every section that have text; null and blank texts have none. A map over the rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = text.splitlines(keepends=True)
                kept = [(f, t, "".join(lines[f : t + 1]).strip()) for f, t in line_chunks(text, size, overlap)]
                rows += [(key, i, f, t, c) for i, (f, t, c) in enumerate((k for k in kept if k[2]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["section_id", "chunk_no", "first_line", "last_line", "chunk"])

    return sections.where("text IS NOT NULL").select("section_id", "text").mapInArrow(split, SCHEMA)
