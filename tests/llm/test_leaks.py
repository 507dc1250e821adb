import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import leaks


def norm(x):
    x = unicodedata.normalize("NFKC", x).lower()
    x = "".join(c for c in x if unicodedata.category(c) != "Cf")
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in x).split()


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, lang, x in items:
            if t is None or x is None or d is None:
                continue
            a, b = norm(t), norm(x)
            grams = {tuple(b[k : k + 13]) for k in range(len(b) - 12)}
            hit = any(tuple(a[k : k + 13]) in grams for k in range(len(a) - 12))
            if lang in ("ja", "zh"):
                p, q = "".join(a), "".join(b)
                hit |= any(q[k : k + 26] in p for k in range(len(q) - 25))
            if hit:
                out.add((d, i))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    rows = leaks.leaked_items(d, i).collect()
    assert len(rows) == len(set(rows))
    return {(r.doc_id, r.item_id) for r in rows}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300))
def test_suffix_array(symbols):
    text = np.array([*symbols, 0], dtype=np.int64)
    sa = leaks.suffix_array(text, 2)
    big = [(int(s), 0) if s else (-1, i) for i, s in enumerate(text)]
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: big[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=5, max_size=400), st.integers(1, 4))
def test_search_and_locate(symbols, k):
    text = np.array([*symbols, 0], dtype=np.int64)
    grams = np.array(sorted({tuple(text[i : i + k]) for i in range(len(text) - k) if text[i : i + k].all()} | {(5,) * k}), dtype=np.int64)
    index = leaks.FMIndex(text, 5)
    which, lo, hi = index.search(grams)
    got = {tuple(grams[w]): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
    want = {}
    for i in range(len(text) - k + 1):
        if text[i : i + k].all():
            want.setdefault(tuple(text[i : i + k]), []).append(i)
    assert got == {g: p for g, p in want.items() if g in got} and set(got) == set(want) & {tuple(g) for g in grams}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_SYMBOLS", 300)
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "Ünit", "x1", "見出し", "解析"])
    items = [(i, rng.choice(["en", "ja", "zh", None]), " ".join(word() for _ in range(rng.randint(3, 40)))) for i in range(30)] + [(99, "en", None), (98, "ja", "")]
    docs = []
    for d in range(120):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if d % 3 == 0:
            piece = rng.choice(items[:30])[2]
            text += " — " + (piece.upper() if d % 2 else piece.replace(" ", "​, ")) + " " + text
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (None, docs[0][1]), (503, "ＡＬＰＨＡ　" * 5 + docs[3][1])]
    assert found(spark, docs, items) == brute(docs, items)


def test_item_groups_and_empty_tables(spark, monkeypatch):
    items = [(1, "en", " ".join(f"w{i}" for i in range(20))), (2, "ja", "".join(chr(0x4E00 + i) for i in range(40)))]
    docs = [(1, items[0][2]), (2, "前" + items[1][2][5:35]), (3, "x")]
    assert found(spark, docs, items) == {(1, 1), (2, 2)}
    monkeypatch.setattr(leaks, "item_groups", lambda i, f=leaks.item_groups: f(i, 50))
    assert found(spark, docs, items) == {(1, 1), (2, 2)}
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()


def test_spans_merge(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[2:25]) + " c " + " ".join(words[:13]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, "en", " ".join(words))], "item_id long, lang string, text string")
    got = sorted((r.span_start, r.span_end) for r in leaks.leaked_spans(docs, items).collect())
    assert got == [(2, 25), (26, 39)]


def test_removal_spans_in_the_text(spark):
    words = [f"w{i}" for i in range(20)]
    leak = " ".join(w.upper() + ("\u200b" if i % 3 else " —") for i, w in enumerate(words[:15]))
    ja = "".join(chr(0x4E00 + i) for i in range(40))
    docs = spark.createDataFrame([(1, "Ünd ﬁrst " + leak + " tail"), (2, "前置き。" + ja[:15] + "、\n" + ja[15:33] + "後"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "en", " ".join(words)), (6, "ja", ja)], "item_id long, lang string, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: texts[r.doc_id][r.span_start : r.span_end] for r in leaks.removal_spans(docs, items).collect()}
    assert got == {1: leak.rstrip(" —\u200b"), 2: ja[:15] + "、\n" + ja[15:33] + "後"}


def test_offsets_of_words_whatever_the_text():
    for text in ("ΑΣ b", "x ΟΔΟΣ. Β", "İstanbul ﬁ ① x", "a\u00ad\u0301 b", "ｶﾞ ㍿ é e\u0301", "각 \u1100\u1161\u11a8", "한\r\n\u0301x\ny", ""):
        at = leaks.word_offsets(text)
        assert len(at) == len(leaks.normal_words(text)) == len(norm(text))
        assert all(0 <= a < z <= len(text) for a, z in at) and at == sorted(at)
    assert [("ΑΣ b")[a:z] for a, z in leaks.word_offsets("ΑΣ b")] == ["ΑΣ", "b"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aÅΣσİß\u0301\u0327\u00ad\u200dｶﾞ①ﬁ한\u1100\u1161 \n-", max_size=40))
def test_normal_words_and_their_places(text):
    assert leaks.normal_words(text) == norm(text)
    at = leaks.word_offsets(text)
    assert len(at) == len(norm(text))
    lines = text.split("\n")
    bounds, k = [], 0
    for line in lines:
        bounds.append((k, k + len(line)))
        k += len(line) + 1
    assert all(any(a <= s < z <= b for a, b in bounds) for s, z in at)


def test_a_final_sigma_removes_the_leak_only(spark):
    words = [f"w{i}" for i in range(15)]
    text = "ΑΣ stays here\n" + " ".join(words) + "\nΟΔΟΣ stays too"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "en", " ".join(words))], "item_id long, lang string, text string")
    got = [text[r.span_start : r.span_end] for r in leaks.removal_spans(docs, items).collect()]
    assert got == [" ".join(words)]
