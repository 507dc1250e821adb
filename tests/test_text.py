import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import chunks
from docloom.operators import markdown as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v):
    return F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>")


@pytest.mark.parametrize("raw,want", [("Hello, World!", "hello-world"), ("設定 ファイル", "設定-ファイル"), ("--", "section"), ("", "section"), ("a_b", "a_b"), (None, None)])
def test_slug(spark, raw, want):
    assert one(spark, T.slug(F.lit(raw).cast("string"))) == want


def test_hashes_ignore_format_only(spark):
    a, b = "x  y\n\n z　", "x y z"
    assert one(spark, T.semantic_hash(lit(a))) == one(spark, T.semantic_hash(lit(b))) == hashlib.sha256(b.encode()).hexdigest()
    assert one(spark, T.source_hash(lit(a))) == hashlib.sha256(a.encode()).hexdigest()


def test_uuid5(spark):
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    for name in ("", "docs/a.md#0001-x", "日本語"):
        assert one(spark, T.uuid5(space.hex, lit(name))) == str(uuid.uuid5(space, name))


def test_identifiers(spark):
    text = "Use `a b` and [table.x] here.\nkey_1 = 2\ncall foo.bar, go() in main.py or /run --dry-run. MAX_SIZE SpanFlag stale_pair plain_name required x.AB"
    got = one(spark, T.identifiers(lit(["Head"]), lit(text)))
    assert got[:4] == ["a b", "table.x", "key_1", "foo.bar"]
    assert {"go()", "main.py", "/run", "--dry-run", "MAX_SIZE", "SpanFlag", "stale_pair", "required"} <= set(got) and "plain_name" not in got
    assert one(spark, T.identifiers(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == []
    assert len(one(spark, T.identifiers(lit([]), lit(" ".join(f"`c{i}`" for i in range(99)))))) == 64


def test_keys_terms_and_summary(spark):
    assert one(spark, T.search_keys(lit(["Retry  budget", "max_size", "Foo.bar", "", "known", "Retry budget"]), lit(["known", None]))) == ["Retry budget"]
    assert one(spark, T.specific_terms(lit(["user", "USERS", "1234", "abc", "quota", None, "テスト"]))) == ["quota"]
    assert one(spark, T.fallback_summary(lit(["A", "B"]), lit("\n  \n first line \nsecond"))) == "A / B: first line"
    assert one(spark, T.fallback_summary(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == ""
    assert one(spark, T.embedding_text(lit(["A"]), lit(""), lit([]), lit(["x", "y"]))) == "A | x, y"


def test_tokens_and_grams(spark):
    assert one(spark, T.tokens(lit("See @a/b-c x1 42 見出し解析"))) == ["see", "@a/b-c", "x1", "42", "見出し解析", "見出", "出し", "し解", "解析"]
    assert one(spark, T.char_grams(lit("a B𝕏c"), 2)) == ["ab", "b𝕏", "𝕏c"]
    assert one(spark, T.char_grams(lit("a"), 2)) == [] and one(spark, T.char_grams(lit("abcd"), 3)) == ["abc", "bcd"]
    assert set(one(spark, T.identifier_parts(lit(["MaxSize.x-yz"])))) == {"maxsize.x-yz", "maxsize", "yz", "max", "size"}


def test_scores(spark):
    assert one(spark, T.match_score(lit(["a", "zz"]), lit("cat"))) == 0.5 and one(spark, T.match_score(lit([]), lit("cat"))) == 0.0
    assert one(spark, T.occurrences(lit("aXaXa"), lit("aX"))) == 2 and one(spark, T.occurrences(lit("a"), lit(""))) == 0
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, V.cosine(arr([1, 0]), arr([1, 1]))) == pytest.approx(0.5**0.5)
    assert one(spark, V.cosine(arr([0, 0]), arr([1, 1]))) == 0.0 and one(spark, V.cosine(arr([1]), arr([1, 1]))) is None
    sparse = V.normal_sparse(F.expr("array(3, 1, 3, 2, null)"), F.expr("array(1f, 0f, 2f, float('nan'), 1f)"))
    assert [tuple(x) for x in one(spark, sparse)] == [(3, 3.0)]


MD = "intro\n# Top\nbody `x`\n\n```\n# code\n```\n## Sub ##\r\ntext\n\nUnder\n-----\nmore\n##### deep\n# Next\n"


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, MD, "c"), (2, "no heading\nat all", "c"), (3, None, "c"), (4, "", "c"), (5, "# only", "c")], "doc_id long, text string, line string")
    got = {(r.doc_id, r.ordinal): r for r in M.sections(df).collect()}
    assert [(k, got[k].heading, got[k].heading_path) for k in sorted(got)] == [
        ((1, 1), "Top", ["Top"]), ((1, 2), "Sub", ["Top", "Sub"]), ((1, 3), "Under", ["Top", "Under"]), ((1, 4), "Next", ["Next"]), ((2, 0), None, []), ((5, 1), "only", ["only"]),
    ]
    assert got[1, 1].body == "body `x`\n\n```\n# code\n```" and got[1, 3].body == "more\n##### deep" and got[2, 0].body == "no heading\nat all"
    assert got[1, 2].section_id == "1#0002-sub" and got[2, 0].section_id == "2#0000-document"


def test_lines(spark):
    df = spark.createDataFrame([(1, "é\r\n\nx\n")], "doc_id long, text string")
    assert [(r.line_no, r.start_offset, r.line) for r in M.document_lines(df).orderBy("line_no").collect()] == [(1, 0, "é"), (2, 3, ""), (3, 4, "x")]


def test_links(spark):
    df = spark.createDataFrame([("a", '[x](#y) ![img](p.png) [z](b.md "t")'), ("b", None)], "k string, text string")
    assert [(r.position, r.label, r.target) for r in M.links(df, "k", "text").collect()] == [(0, "x", "#y"), (1, "z", "b.md")]


def test_line_chunks():
    text = "".join(f"line {i:03d}\n" for i in range(50))
    got = chunks.line_chunks(text, 100, 20)
    lines = text.splitlines(keepends=True)
    assert got[0][0] == 0 and got[-1][1] == 49
    assert all(sum(map(len, lines[a : b + 1])) <= 100 for a, b in got)
    assert all(b >= c > a for (a, b), (c, _) in zip(got, got[1:])) and all(b - c + 1 == 3 for (_, b), (c, _) in zip(got, got[1:]))
    assert chunks.line_chunks("x" * 500 + "\ny\n", 100, 20) == [(0, 0), (1, 1)] and chunks.line_chunks("", 10, 2) == []


def test_chunks_of_dirty_sections(spark):
    df = spark.createDataFrame([("a", "one\ntwo\n", 1), ("b", None, 1), ("c", " \n", 1)], "section_id string, text string, chunk int")
    assert [(r.section_id, r.chunk) for r in chunks.chunk_sections(df).collect()] == [("a", "one\ntwo")]


def heads(spark, text):
    rows = M.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()
    return [r.heading for r in rows if r.heading]


def test_fences_close_by_their_own_character_and_length(spark):
    assert heads(spark, "# A\n~~~\n```\n# code\n~~~\n# B") == ["A", "B"]
    assert heads(spark, "# A\n````\n```\n# code\n```\n# code\n````\n# B") == ["A", "B"]
    assert heads(spark, "# A\n```py\n# code\n``` x\n# code\n```  \n# B") == ["A", "B"]
    assert heads(spark, "# A\n``` a`b\n# B\n    ```\n# C") == ["A", "B", "C"]
    assert heads(spark, "# A\n~~~ x`y\r\n# code\r\n~~~~\r\n# B\n```\n# open") == ["A", "B"]


def test_links_and_where_they_lead(spark):
    text = '[a](x.md)[b](#S "t") ![i](p.png) [c](https://e.org/x) [d\n](no) \\ [e](../y%20z.md#h)'
    got = [(r.label, r.target) for r in M.links(spark.createDataFrame([("k", text)], "key string, text string"), "key", "text").collect()]
    assert got == [("a", "x.md"), ("b", "#S"), ("c", "https://e.org/x"), ("e", "../y%20z.md#h")]
    place = lambda doc, target: one(spark, M.link_place(lit(doc), lit(target)))
    assert tuple(place("d/e/f.md", "../y%20z.md#h")) == ("d/y z.md", "h")
    assert tuple(place("d/f.md", "#s")) == ("d/f.md", "s") and tuple(place("f.md", "./g.md?x=1")) == ("g.md", "")
    assert tuple(place("d/f.md", "/a//b/./c.md")) == ("a/b/c.md", "") and tuple(place("d/f.md", "../../../g+h.md")) == ("g+h.md", "")
    assert place("d/f.md", "https://e.org/x") is None and place("d/f.md", "mailto:x@y") is None and tuple(place("d/f.md", "100%.md")) == ("d/100%.md", "")


def test_links_resolve_by_id_slug_and_document(spark):
    sections = spark.createDataFrame([("d/a.md#0001-one", "d/a.md", 1, "One"), ("d/a.md#0002-two", "d/a.md", 2, "Two"), ("d/a.md#0003-two", "d/a.md", 3, "Two"), (None, "d/b.md", 1, "x"), ("d/a.md#0001-one", "d/a.md", 1, "One")], "section_id string, document_id string, ordinal int, heading string")
    targets = ["a.md", "#0002-two", "a.md#two", "a.md#TWO", "a.md#gone", "b.md", "c.md#x", "http://x#y", None]
    found = spark.createDataFrame([("s", "d/a.md", i, "t", x) for i, x in enumerate(targets)], "source_id string, document_id string, position int, label string, target string")
    got = {r.position: r.target_id for r in M.resolve_links(found, sections).collect()}
    assert got == {0: "d/a.md#0001-one", 1: "d/a.md#0002-two", 2: "d/a.md#0003-two", 3: "d/a.md#0003-two", 4: None, 5: None, 6: None, 7: None, 8: None}


def test_adjacent_identifiers(spark):
    got = one(spark, T.identifiers(lit([]), lit("[a][b] f()g() /x-/y")))
    assert {"a", "b", "f()", "g()", "/x-", "/y"} <= set(got)
