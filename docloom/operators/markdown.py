"""Markdown documents as sections, lines, chapters and links.

Lines are exploded and every state (open fence, heading stack, section number)
is a running window over the lines of a document, so one pass over one shuffle
by document gives all of them.

Covered: ATX headings of levels 1 to 6, setext headings of one line, fenced code.
A fence is closed by a line of the same character, at least as long, with
nothing behind it; an open fence reaches to the end of the document. Headings in
block quotes and list items are not headings here. Text before the first heading
belongs to no section; a document without headings is one section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

_ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
_SETEXT = r"^ {0,3}(=+|-+)[ \t]*$"
_FENCE = r"^ {0,3}(`{3,}|~{3,})([^\r\n]*)"
#: Lines that cannot be the text of a setext heading.
_NO_TEXT = r"^[ \t]*$|^ {0,3}(?:#{1,6}(?:[ \t]|$)|[-*+][ \t]|[0-9]{1,9}[.)][ \t]|\||>|```|~~~|=+[ \t]*$|-+[ \t]*$)"


def _fences(lines: Column) -> Column:
    """(opens, closes): the numbers of the lines of an array that open and close fenced code, by a fold over the lines that could."""
    numbers = "array<int>"
    could = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_FENCE), F.named_struct(F.lit("n"), i, F.lit("run"), F.regexp_extract(x, _FENCE, 1), F.lit("info"), F.trim(F.regexp_replace(F.regexp_extract(x, _FENCE, 2), "\t", " "))))), lambda x: x.isNotNull())
    state = lambda run, opens, closes: F.named_struct(F.lit("run"), run, F.lit("opens"), opens, F.lit("closes"), closes)

    def step(a: Column, x: Column) -> Column:
        opening = (a["run"] == "") & (x["run"].startswith("~") | ~x["info"].contains("`"))
        closing = (a["run"] != "") & (x["info"] == "") & x["run"].startswith(a["run"])
        return F.when(opening, state(x["run"], F.array_append(a["opens"], x["n"]), a["closes"])).when(closing, state(F.lit(""), a["opens"], F.array_append(a["closes"], x["n"]))).otherwise(a)

    none = F.array().cast(numbers)
    return F.aggregate(could, state(F.lit(""), none, none), step, lambda a: F.named_struct(F.lit("opens"), a["opens"], F.lit("closes"), a["closes"]))


def _raw_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, raw, fence): 0-based lines; fence is 1 where code opens and -1 where it closes."""
    texts = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, F.split(F.col(text), "\n", -1).alias("lines"))
    fenced = F.exists("lines", lambda x: x.rlike(_FENCE))
    none = F.struct(F.array().cast("array<int>").alias("opens"), F.array().cast("array<int>").alias("closes"))
    rows = texts.select(key, F.when(fenced, _fences(F.col("lines"))).otherwise(none).alias("f"), F.posexplode("lines").alias("n", "raw"))
    # only lines that look like a fence are searched for among the few that are one
    mark = F.when(F.col("raw").rlike(_FENCE), F.when(F.array_contains("f.opens", F.col("n")), 1).when(F.array_contains("f.closes", F.col("n")), -1))
    return rows.select(key, "n", "raw", F.coalesce(mark, F.lit(0)).alias("fence"))


def document_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", code: bool = False) -> DataFrame:
    """(key, line_no, start_offset, line): 1-based lines and their offsets in code points.

    Null and empty texts have no lines; a final line break starts no line. CRLF
    counts as two characters and is stripped from the line. With ``code`` also
    ``in_code``: whether the line is fenced code, its fences included.
    """
    rows = _raw_lines(documents, key, text)
    w = Window.partitionBy(key).orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = rows.withColumn("start_offset", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0))).withColumn("follows", F.lead("n").over(w))
    inside = (F.coalesce(F.sum("fence").over(before), F.lit(0)) > 0) | (F.col("fence") > 0)
    if code:
        lines = lines.withColumn("in_code", inside)
    return lines.where("follows IS NOT NULL OR raw <> ''").select(key, (F.col("n") + 1).alias("line_no"), "start_offset", F.regexp_replace("raw", "\r$", "").alias("line"), *(["in_code"] if code else []))


def headings(lines: DataFrame, key: str = "doc_id", max_level: int = 4) -> DataFrame:
    """Lines (with ``in_code``) with ``level`` and ``heading`` where one starts, and whether the line is the underline of one."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("next_line", F.lead("line").over(w)).withColumn("next_code", F.lead("in_code").over(w)).withColumn("prev_line", F.lag("line").over(w)).withColumn("prev_code", F.lag("in_code").over(w))
    atx = ~F.col("in_code") & F.col("line").rlike(_ATX)
    plain = lambda c, code: ~F.col(code) & ~F.col(c).rlike(_NO_TEXT)
    alone = F.col("prev_line").isNull() | F.col("prev_code") | F.col("prev_line").rlike(_NO_TEXT)
    setext = plain("line", "in_code") & alone & ~F.coalesce("next_code", F.lit(True)) & F.coalesce(F.col("next_line").rlike(_SETEXT), F.lit(False))
    level = F.when(atx, F.length(F.regexp_extract("line", _ATX, 1))).when(setext, F.when(F.col("next_line").rlike(r"^ {0,3}="), 1).otherwise(2))
    heading = F.when(atx, F.trim(F.regexp_extract("line", _ATX, 2))).when(setext, F.trim("line"))
    rows = rows.withColumn("level", F.when(level <= max_level, level)).withColumn("heading", F.when(F.col("level").isNotNull(), heading))
    underline = F.coalesce(F.lag(F.when(setext & F.col("level").isNotNull(), F.lit(True))).over(w), F.lit(False))
    return rows.withColumn("underline", underline).select(key, "line_no", "start_offset", "line", "level", "heading", "underline")


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text", max_level: int = 4) -> DataFrame:
    """(key, ordinal, level, heading, heading_path, start_line, end_line, body, hashes, ids) of every section."""
    marked = headings(document_lines(documents, key, text, code=True), key, max_level)
    w = Window.partitionBy(key).orderBy("line_no")
    marked = marked.withColumn("ordinal", F.count("level").over(w)).withColumn("any", F.count("level").over(Window.partitionBy(key)))
    # the stack: of every level the last heading, and where it stood; a shallower one later resets it
    at = {n: F.last(F.when(F.col("level") == n, F.col("line_no")), ignorenulls=True).over(w) for n in range(1, max_level + 1)}
    name = {n: F.last(F.when(F.col("level") == n, F.col("heading")), ignorenulls=True).over(w) for n in range(1, max_level + 1)}
    for n in range(1, max_level + 1):
        marked = marked.withColumn(f"a{n}", at[n]).withColumn(f"h{n}", name[n])
    live = lambda n: F.when(F.col(f"a{n}") >= F.greatest(*[F.coalesce(F.col(f"a{m}"), F.lit(0)) for m in range(1, n + 1)], F.lit(0)), F.col(f"h{n}"))
    path = F.array_compact(F.array(*[live(n) for n in range(1, max_level + 1)]))
    body_line = F.col("level").isNull() & ~F.col("underline")
    grouped = (
        marked.where("ordinal > 0 OR any = 0")
        .withColumn("path", F.when(F.col("level").isNotNull(), path))
        .groupBy(key, "ordinal")
        .agg(
            F.max("level").alias("level"),
            F.max("heading").alias("heading"),
            F.max("path").alias("heading_path"),
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body_line, F.struct("line_no", "line")))), lambda s: s["line"]), "\n").alias("body"),
        )
    )
    doc = F.col(key).cast("string")
    return grouped.select(
        key,
        "ordinal",
        "level",
        "heading",
        F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"),
        "start_line",
        "end_line",
        "body",
        T.source_hash(F.col("body")).alias("source_hash"),
        T.semantic_hash(F.col("body")).alias("semantic_hash"),
        T.section_id(doc, F.col("ordinal"), F.col("heading")).alias("section_id"),
        T.stable_uid(doc, F.col("ordinal")).alias("stable_section_uid"),
    )


def structure_hashes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lines, structure_hash): equal for documents that differ in the white space of their prose only.

    Prose lines are collapsed and blank ones dropped; fenced code counts as it is.
    """
    marked = document_lines(documents, key, text, code=True)
    rows = marked.select(key, "line_no", F.when(F.col("in_code"), F.concat(F.lit("code:"), F.col("line"))).otherwise(T.collapse(F.col("line"))).alias("part")).where("part <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda s: s["part"]), "\n")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.sha2(joined, 256).alias("structure_hash"))


def links(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, label, target) of inline links, images left out, adjacent ones each."""
    pattern = r'(?<!!)\[([^\]\n]+)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("target"))
    return rows.select(key, F.posexplode(pairs).alias("position", "l")).select(key, "position", F.col("l.label").alias("label"), F.col("l.target").alias("target"))


def fold_path(path: Column) -> Column:
    """A relative path without empty parts, '.' and '..'; what '..' climbs above the root is dropped."""
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.array_append(a, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def link_place(document_id: Column, target: Column) -> Column:
    """(document, fragment) a link's target names, seen from a document; null for addresses with a scheme.

    Percent escapes are decoded. A target without a path is in the document
    itself; an absolute path starts at the root; a query is ignored.
    """
    bare = F.regexp_replace(F.trim(target), r"\?[^#]*", "")
    decode = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    path, fragment = decode(F.regexp_extract(bare, r"^([^#]*)", 1)), F.trim(decode(F.regexp_extract(bare, r"^[^#]*#(.*)$", 1)))
    parent = F.regexp_extract(document_id, r"^(.*)/[^/]*$", 1)
    place = F.when(path == "", document_id).when(path.startswith("/"), fold_path(path)).otherwise(fold_path(F.concat_ws("/", parent, path)))
    return F.when(~F.trim(target).rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)"), F.struct(place.alias("document"), fragment.alias("fragment")))


def resolve_links(found: DataFrame, sections: DataFrame) -> DataFrame:
    """(source_id, position, label, target, target_id) of (source_id, document_id, position, label, target).

    ``sections`` has (section_id, document_id, ordinal, heading), one row per
    section. A target with a fragment is the section whose id is
    'document#fragment', else the document's last one whose heading has that
    slug; one without is the document's first section. Links that lead nowhere
    have a null target_id.
    """
    at = link_place(F.col("document_id"), F.col("target"))
    rows = found.select("source_id", "position", "label", "target", at.alias("at"))
    named = F.when(F.col("at.fragment") != "", F.concat("at.document", F.lit("#"), "at.fragment"))
    # one small key per way to be found; every link asks for at most two of them
    kinds = F.when(named.isNotNull(), F.array(F.concat(F.lit("id:"), named), F.concat(F.lit("slug:"), "at.document", F.lit("#"), T.slug(F.col("at.fragment"))))).otherwise(F.array(F.concat(F.lit("first:"), "at.document")))
    s = sections.where("section_id IS NOT NULL AND document_id IS NOT NULL")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    ids = s.select(key("id", F.col("section_id")).alias("k"), "section_id")
    slugs = s.where("heading IS NOT NULL").groupBy(key("slug", F.concat("document_id", F.lit("#"), T.slug(F.col("heading")))).alias("k")).agg(F.max_by("section_id", F.struct("ordinal", "section_id")).alias("section_id"))
    first = s.groupBy(key("first", F.col("document_id")).alias("k")).agg(F.min_by("section_id", F.struct("ordinal", "section_id")).alias("section_id"))
    asked = rows.where("at IS NOT NULL").select("source_id", "position", F.posexplode(kinds).alias("way", "k"))
    best = asked.join(ids.unionByName(slugs).unionByName(first).distinct(), "k").groupBy("source_id", "position").agg(F.min_by("section_id", "way").alias("target_id"))
    return rows.drop("at").join(best, ["source_id", "position"], "left")
