import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pieces

PROSE = ("The rule holds for every record. It ends here! Does it? " * 8 + "\n\n# A heading\n\nMore text follows it, and more. " * 3 + "\n- item one\n- item two\n" * 6) * 4


def check(text, limit, overlap):
    got = pieces.cut(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for start, end, _ in got:
        assert 0 < end - start <= limit
    for (_, end, _), (start, _, _) in zip(got, got[1:]):
        assert overlap <= end - start <= overlap + 12
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#、。é́`~", min_size=1, max_size=600), st.integers(5, 80), st.integers(0, 60))
def test_limits_and_cover(text, limit, overlap):
    if overlap >= limit and len(text) > limit:
        with pytest.raises(ValueError):
            pieces.cut(text, limit, overlap)
        return
    got = pieces.cut(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e, _ in got)
    assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(got, got[1:]))


def test_prose_is_cut_at_boundaries_with_the_overlap():
    got = check(PROSE, 400, 60)
    assert all(kind in ("sentence", "block", "paragraph", "heading", "end") for _, _, kind in got)
    least = -(-(len(PROSE) - 60) // 340)
    assert len(got) <= least + 1


def test_headings_win_and_code_is_no_heading():
    text = "x" * 60 + " words here.\n\n# Next\n" + "y " * 60
    (_, end, kind), *_ = pieces.cut(text, 150, 0)
    assert kind == "heading" and text[end:].startswith("# Next")
    code = "```\n" + "# not a heading\n" * 20 + "```\n"
    assert all(kind != "heading" for _, _, kind in pieces.cut(code, 100, 10))


def test_no_boundary_at_all():
    got = check("x" * 1000, 100, 10)
    assert {k for _, _, k in got} == {"none", "end"}


def test_marks_stay_with_their_character():
    for _, end, _ in pieces.cut("é" * 500, 101, 0)[:-1]:
        assert end % 2 == 0


SECTIONS = "section_id string, heading_path array<string>, text string, profile string, ingested_at timestamp, piece string"
CONFIG = "profile string, max_heading_level int, max_chars int, overlap_chars int"


def test_tables(spark):
    long = "# Deep\n" + "Some words in a row. " * 20
    rows = [("a", ["H"], long, None), ("a", ["H"], long, None), ("b", None, "short", "tight"), ("c", [], long, "nobody"), ("d", [], None, "tight"), ("e", [], "", "tight"), ("f", [], "x" * 100, "tight"), (None, [], long, None)]
    s = spark.createDataFrame([(*r, None, "clash") for r in rows], SECTIONS)
    config = spark.createDataFrame([("standard", 4, 200, 20), ("tight", 2, 50, 0), ("tight", 2, 80, 0)], CONFIG)
    got = pieces.all_pieces(s, config).collect()
    by = {}
    for r in got:
        by.setdefault(r.section_id, []).append(r)
    assert set(by) == {"a", "b", "c", "f"}
    assert sorted(r.piece_no for r in by["a"]) == list(range(1, by["a"][0].n_pieces + 1))
    assert all(r.heading_path == ["H"] and r.piece == long[r.start_offset : r.end_offset] for r in by["a"])
    assert {tuple(r.inner_headings) for r in by["a"]} == {("Deep",)}
    assert by["b"][0].n_pieces == 1 and len(by["f"]) == 2
    assert pieces.all_pieces(s.limit(0), config).count() == 0


def test_random_prose_keeps_the_overlap():
    rng = random.Random(5)
    for _ in range(30):
        check("".join(rng.choice(["word ", "word. ", "\n", "\n\n", "語。", "- x\n"]) for _ in range(400)), rng.randint(60, 300), rng.randint(0, 30))


def weak(got):
    return sum(kind in ("none", "word", "clause") for _, _, kind in got)


def test_one_unavoidable_weak_cut_leaves_the_others_natural():
    text = "x" * 1200 + "\n\n" + ("word " * 60 + "\n\n") * 6
    got = check(text[:2790], 1000, 100)
    assert weak(got) == 1


def test_no_more_weak_cuts_than_runs_need():
    rng = random.Random(7)
    for _ in range(200):
        limit, overlap = rng.randint(60, 200), rng.randint(0, 30)
        text = "".join("x" * rng.choice([5, 20, 40, 90, 150, 400]) + "\n" for _ in range(rng.randint(2, 30)))
        step, cuts = limit - overlap, [i + 1 for i, ch in enumerate(text) if ch == "\n" and overlap < i + 1 < len(text)]
        ends = [overlap, *cuts, len(text)]
        assert weak(check(text, limit, overlap)) == sum(-(-(b - a) // step) - 1 for a, b in zip(ends, ends[1:]) if b > a) or len(text) <= limit


def test_widens_before_it_cuts_a_word():
    text = "x" * 230 + " " + "y" * 1370
    assert pieces.cut(text, 1600, 200) == [(0, 231, "word"), (31, 1601, "end")]


def test_an_overlap_over_half_the_limit_is_kept():
    got = check("Some words in a row. " * 30, 100, 70)
    assert all(end - start >= 70 for (_, end, _), (start, _, _) in zip(got, got[1:]))


def test_no_word_is_cut_that_can_be_spared():
    rng = random.Random(11)
    for _ in range(300):
        limit, overlap = rng.randint(40, 160), rng.randint(0, 30)
        text = "".join("x" * rng.choice([3, 8, 20, 60, 130, 200]) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randint(3, 40)))
        every = pieces.Boundaries(text).from_strength(1)
        none = sum(kind == "none" for _, _, kind in check(text, limit, overlap))
        assert none == (pieces._unavoidable(every, len(text), limit - overlap, overlap) if len(text) > limit else 0)


def test_the_latest_row_is_chosen_first(spark):
    import datetime

    day = lambda k: datetime.datetime(2025, 1, k)
    rows = [("a", [], "word " * 100, "tight", day(1), ""), ("a", [], "short", "tight", day(2), ""), ("b", [], "short", "tight", day(1), ""), ("b", [], "word " * 20, "tight", day(2), "")]
    s, config = spark.createDataFrame(rows, SECTIONS), spark.createDataFrame([("tight", 2, 50, 10)], CONFIG)
    assert {r.section_id for r in pieces.split_oversized(s, config).collect()} == {"b"}
    got = [(r.section_id, r.piece) for r in pieces.all_pieces(s, config).collect()]
    assert ("a", "short") in got and sum(k == "a" for k, _ in got) == 1
    checks = {r.section_id: (r.covered, r.over_limit, r.short_overlaps, r.wrong_texts) for r in pieces.piece_checks(s, config).collect()}
    assert checks == {"a": (5, 0, 0, 0), "b": (100, 0, 0, 0)}
