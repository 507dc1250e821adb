"""Cutting oversized texts into overlapping pieces at natural boundaries.

Balanced targets: the fewest pieces that can hold the text are counted, their
ends are spread evenly, and each end moves to the strongest boundary nearby; if
there is none nearby, to one anywhere the limit allows. As long as a piece
breaks the limit, or a cut lies inside a word or at no natural boundary (a
line's end at least) though that can be avoided, more pieces are tried. Where no
count of balanced pieces gets down to the cuts that cannot be avoided, the plan
is one that goes as far as it can with every piece, which does.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strengths of the boundaries, weakest first. A cut lies before the character at its offset.
STRENGTHS = ("none", "word", "clause", "line", "sentence", "block", "paragraph", "heading")
#: Every alternative takes a run whole and from its beginning only, so that long runs cost no more than their length.
_BOUNDARY = re.compile(
    r"(?P<paragraph>\n[^\S\n]*+\n\s*+(?=\S))"
    r"|(?P<line>\n)"
    r"|(?P<sentence>(?<![.!?…।؟])[.!?…।؟]++[\"'”’»)\]]*+[^\S\n]++(?=\S)|(?<![。！？])[。！？]++[」』”’）]*+[^\S\n]*+(?=[^\s。！？]))"
    r"|(?P<clause>[,;:][^\S\n]++(?=\S)|[、，；：](?=\S))"
    r"|(?P<word>(?<![^\S\n])[^\S\n]++(?=\S))"
)
_ENDS, _CLOSES = frozenset(".!?…।؟。！？"), frozenset("\"'”’»)]」』）")
_BLOCK_START = re.compile(r"[^\S\n]*(?:[-*+]\s|\d{1,9}[.)]\s|\||>|```|~~~)")
_HEADING = re.compile(r" {0,3}#{1,6}\s")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})", re.M)
_HEADING_LINE = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", re.M)

#: The weakest natural boundary.
NATURAL = STRENGTHS.index("line")

SCHEMA = "section_id string, heading_path array<string>, piece_no int, n_pieces int, start_offset int, end_offset int, boundary string, inner_headings array<string>, piece string"


def _fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code; an open fence reaches to the end."""
    spans, opened = [], None
    for m in _FENCE.finditer(text):
        if opened is None:
            opened = (m.start(), m.group(1))
        elif m.group(1)[0] == opened[1][0] and len(m.group(1)) >= len(opened[1]):
            spans.append((opened[0], m.end()))
            opened = None
    return spans + ([(opened[0], len(text))] if opened else [])


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    k = bisect_right(spans, (at, 1 << 62)) - 1
    return k >= 0 and spans[k][0] < at < spans[k][1]


def _extends(ch: str) -> bool:
    """Marks, joiners, variation selectors and skin tones belong to the character before them."""
    return unicodedata.category(ch) in ("Mn", "Mc", "Me") or ch in "\u200d\ufe0f" or "\U0001f3fb" <= ch <= "\U0001f3ff"


def _whole(text: str, at: int, least: int) -> int:
    """``at`` or the nearest offset before it that does not tear a character from its marks."""
    k = at
    while k > least and k < len(text) and (_extends(text[k]) or text[k - 1] == "\u200d"):
        k -= 1
    return k if k > least else at


def _sentence_ended(text: str, at: int) -> bool:
    """Whether the text before the white space before ``at`` ends with an end mark and its closing marks."""
    while at and text[at - 1].isspace():
        at -= 1
    while at and text[at - 1] in _CLOSES:
        at -= 1
    return at > 0 and text[at - 1] in _ENDS


class Boundaries:
    """The boundaries of a text by strength, each list ascending."""

    def __init__(self, text: str):
        fences = _fences(text) if "```" in text or "~~~" in text else []
        self.text, self.by = text, [[] for _ in STRENGTHS]
        ended = len(text.rstrip())  # of the white space at the end only lines count
        for m in _BOUNDARY.finditer(text, 0, min(len(text), ended + 1)):
            at, kind = m.end(), m.lastgroup
            if fences and _inside(fences, at):
                kind = "line" if kind in ("paragraph", "line") else "word"
            elif kind in ("paragraph", "line"):
                kind = "heading" if _HEADING.match(text, at) else "block" if kind == "line" and _BLOCK_START.match(text, at) else kind
                if kind == "line" and _sentence_ended(text, at):
                    kind = "sentence"
            self.by[STRENGTHS.index(kind)].append(at)
        self.by[NATURAL] += [m.end() for m in re.compile("\n").finditer(text, min(len(text), ended + 1))]

    def from_strength(self, least: int) -> list[int]:
        return sorted(at for own in self.by[least:] for at in own)

    def near(self, target: int, lo: int, hi: int) -> tuple[int, int]:
        """(offset, strength) of the strongest boundary in [lo, hi]; among equals the one nearest to ``target``. Strength 0: there is none."""
        for strength in range(len(STRENGTHS) - 1, 0, -1):
            own = self.by[strength]
            k = bisect_right(own, target)
            best = min((at for at in own[max(0, k - 1) : k + 1] if lo <= at <= hi), key=lambda at: (abs(at - target), at), default=0)
            if best:
                return best, strength
        return 0, 0


def _unavoidable(ends: list[int], size: int, step: int, overlap: int) -> int:
    """The cuts that no choice of pieces can put at one of ``ends``: those within runs longer than a piece."""
    ends = [overlap, *[at for at in ends if overlap < at < size], size]
    return sum(-(-(b - a) // step) - 1 for a, b in zip(ends, ends[1:]) if b > a)


Plan = list[tuple[int, int, str]]


def _balanced(text: str, n: int, limit: int, overlap: int, found: Boundaries) -> Plan | None:
    """A plan of ``n`` pieces with evenly spread targets; None if a piece breaks the limit."""
    size, step = len(text), limit - overlap
    stride = (size - overlap) / n
    reach, pieces, start, end = max(1, int(stride * 0.45)), [], 0, 0
    for i in range(1, n):
        target = round(overlap + i * stride)
        least, most = max(end + 1, overlap + 1, size - (n - i) * step), min(start + limit, size - (n - i))
        if least > most:
            return None
        target = min(max(target, least), most)
        at, strength = found.near(target, max(least, target - reach), min(most, target + reach))
        if not strength:
            at, strength = found.near(target, least, most)
        if not strength:
            at = _whole(text, target, least - 1)
        pieces.append((start, at, STRENGTHS[strength]))
        end, start = at, _whole(text, at - overlap, start)
    return [*pieces, (start, size, "end")] if size - start <= limit else None


def _farthest(text: str, limit: int, overlap: int, natural: list[int], every: list[int], strength_of: dict[int, int]) -> Plan:
    """Every piece as long as it can be and still end at a natural boundary, else at any, else where the run to the next one is halved fairly."""
    size, pieces, start, end = len(text), [], 0, 0
    while size - start > limit:
        for ends in (natural, every):
            k = bisect_right(ends, start + limit) - 1
            at = ends[k] if k >= 0 else 0
            if at > max(end, overlap):
                break
        else:
            k = bisect_right(every, start + limit)
            run = (every[k] if k < len(every) else size) - max(end, overlap)
            parts = -(-run // (limit - overlap))
            at = min(start + limit, max(end, overlap) + -(-run // parts))
            at = _whole(text, at, max(end, overlap))
        pieces.append((start, at, STRENGTHS[strength_of.get(at, 0)]))
        end, start = at, _whole(text, at - overlap, start)
    return [*pieces, (start, size, "end")]


def _weak(plan: Plan) -> tuple[int, int]:
    """Cuts inside a word, and cuts at no natural boundary."""
    kinds = [STRENGTHS.index(kind) for _, _, kind in plan[:-1]]
    return kinds.count(0), sum(k < NATURAL for k in kinds)


def cut(text: str, limit: int, overlap: int) -> Plan:
    """(start, end, boundary) of the pieces, in code points.

    Every piece has at most ``limit`` characters and, but for the first, starts
    ``overlap`` characters before the end of the piece before it (a few more
    where a character would lose its marks). A limit below one counts as one, a
    negative overlap as none; an overlap that leaves a piece nothing of its own
    is an error.
    """
    limit, overlap, size = max(1, limit), max(0, overlap), len(text)
    if size <= limit:
        return [(0, size, "end")] if size else []
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} leaves nothing of pieces of {limit} characters")
    step = limit - overlap
    least = -(-(size - overlap) // step)
    found = Boundaries(text)
    plan = _balanced(text, least, limit, overlap, found)
    if plan and _weak(plan)[1] == 0:
        return plan
    natural, every = found.from_strength(NATURAL), found.from_strength(1)
    fewest = _unavoidable(every, size, step, overlap), _unavoidable(natural, size, step, overlap)
    best = (_weak(plan), plan) if plan else None
    n = least
    while (best is None or best[0] > fewest) and n < 2 * least + 8:
        n += 1
        plan = _balanced(text, n, limit, overlap, found)
        if plan and (best is None or _weak(plan) < best[0]):
            best = (_weak(plan), plan)
    if best is None or best[0] > fewest:
        plan = _farthest(text, limit, overlap, natural, every, {at: k for k, own in enumerate(found.by) for at in own})
        if best is None or _weak(plan) < best[0]:
            return plan
    return best[1]


def headings_at(text: str, offsets: list[int]) -> list[list[str]]:
    """For each offset (ascending) the headings inside the text that are in force there."""
    fences = _fences(text) if "```" in text or "~~~" in text else []
    marks = [(m.start(), len(m.group(1)), m.group(2)) for m in _HEADING_LINE.finditer(text) if not _inside(fences, m.start())] if "#" in text else []
    out, stack, k = [], [], 0
    for at in offsets:
        while k < len(marks) and marks[k][0] <= at:
            stack = [h for h in stack if h[0] < marks[k][1]] + [marks[k][1:]]
            k += 1
        out.append([h[1] for h in stack])
    return out


def with_limits(sections: DataFrame, config: DataFrame, default_profile: str = "standard") -> DataFrame:
    """Sections with the ``max_chars`` and ``overlap_chars`` of their profile.

    A null or unknown profile means ``default_profile``. If a profile is listed
    twice, the smallest limit counts. The config is a handful of rows.
    """
    limits = config.where("max_chars IS NOT NULL").groupBy(F.col("profile").alias("limit_profile")).agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("own"))
    default = limits.where(F.col("limit_profile") == default_profile).select(F.col("own").alias("default"))
    joined = sections.select("section_id", "heading_path", "text", "profile", "ingested_at").join(F.broadcast(limits), F.coalesce("profile", F.lit(default_profile)) == F.col("limit_profile"), "left")
    limit = F.coalesce("own", "default")
    return joined.join(F.broadcast(default), F.lit(True), "left").select("section_id", "heading_path", "text", "ingested_at", limit["max_chars"].alias("max_chars"), limit["overlap_chars"].alias("overlap_chars"))


def _latest(rows: DataFrame) -> DataFrame:
    """One row per section_id: the one ingested last; combined before the shuffle. Among several of them the greatest text counts, null last."""
    return rows.where("section_id IS NOT NULL").groupBy("section_id").agg(F.max(F.struct("ingested_at", "text", "heading_path", "max_chars", "overlap_chars")).alias("r")).select("section_id", "r.*")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            pieces = cut(r["text"], r["max_chars"], r["overlap_chars"])
            inner = headings_at(r["text"], [p[0] for p in pieces])
            for k, ((start, end, boundary), heads) in enumerate(zip(pieces, inner)):
                rows.append((r["section_id"], r["heading_path"], k + 1, len(pieces), start, end, boundary, heads, r["text"][start:end]))
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(c, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def split_oversized(sections: DataFrame, config: DataFrame) -> DataFrame:
    """The pieces of every section whose text is longer than its profile's limit.

    Redelivered rows of a section count once, and the latest row tells whether
    it is oversized; other texts stay where they are. Null and empty texts are
    never oversized. ``heading_path`` is the section's own; ``inner_headings``
    are the deeper headings inside the text that are in force where the piece
    starts.
    """
    long = F.when(F.length("text") > F.col("max_chars"), F.col("text"))
    over = _latest(with_limits(sections, config).withColumn("text", long).withColumn("heading_path", F.when(F.col("text").isNotNull(), F.col("heading_path"))))
    return over.where("text IS NOT NULL").select("section_id", "heading_path", "text", "max_chars", "overlap_chars").mapInArrow(_split, SCHEMA)


def all_pieces(sections: DataFrame, config: DataFrame) -> DataFrame:
    """Pieces of all sections: those within the limit are one piece each, without Python. Null and empty texts have none."""
    rows = _latest(with_limits(sections, config)).where(F.length("text") > 0)
    over = F.coalesce(F.length("text") > F.col("max_chars"), F.lit(False))
    none = F.array().cast("array<string>")
    whole = rows.where(~over).select("section_id", "heading_path", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), F.lit("end").alias("boundary"), none.alias("inner_headings"), F.col("text").alias("piece"))
    return rows.where(over).select("section_id", "heading_path", "text", "max_chars", "overlap_chars").mapInArrow(_split, SCHEMA).unionByName(whole)


def piece_checks(sections: DataFrame, config: DataFrame) -> DataFrame:
    """(section_id, covered, over_limit, short_overlaps, wrong_texts): what the pieces of each section amount to.

    ``covered`` counts the characters in the pieces, each once; the others count
    pieces over the limit, overlaps smaller than configured, and pieces whose
    length is not that of their span.
    """
    pieces = all_pieces(sections, config).select("section_id", "piece_no", "start_offset", "end_offset", F.length("piece").alias("chars"))
    limits = _latest(with_limits(sections, config).withColumn("text", F.lit(None).cast("string")).withColumn("heading_path", F.lit(None).cast("array<string>"))).select("section_id", "max_chars", "overlap_chars")
    before = F.lag("end_offset").over(Window.partitionBy("section_id").orderBy("piece_no"))
    rows = pieces.withColumn("before", before).join(limits, "section_id")
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("section_id").agg(
        F.sum(F.col("end_offset") - F.greatest("start_offset", F.coalesce("before", F.lit(0)))).alias("covered"),
        count(F.col("chars") > F.col("max_chars")).alias("over_limit"),
        count(F.col("before") - F.col("start_offset") < F.col("overlap_chars")).alias("short_overlaps"),
        count(F.col("chars") != F.col("end_offset") - F.col("start_offset")).alias("wrong_texts"),
    )
