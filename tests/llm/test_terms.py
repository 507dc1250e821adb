from collections import Counter

from docloom.llm import terms

SECTIONS = "section_id string, text string, term string"
ITEMS = "section_id string, identifiers array<string>"


def frequencies(spark, sections, items=()):
    s = spark.createDataFrame([(*r, "extra") for r in sections], SECTIONS)
    return {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in terms.corpus_terms(s, spark.createDataFrame(list(items), ITEMS)).collect()}


def test_against_brute_force(spark):
    rows = [(f"s{i}", " ".join(f"w{j}" for j in range(1, 40) if i % j == 0) + " Äb_1 Äb_1 日本語") for i in range(300)]
    got = frequencies(spark, rows * 2)
    occurrences, records = Counter(), Counter()
    for _, t in rows:
        words = t.lower().split()
        occurrences.update(words)
        records.update(set(words))
    assert {k[1]: v[:2] for k, v in got.items()} == {w: (occurrences[w], records[w]) for w in records}
    assert got["text", "äb_1"] == (600, 300, "common")


def test_marks_and_dirty_values(spark):
    sections = [("a", "one Two"), ("b", None), ("c", ""), (None, "ghost"), ("d", "two two"), *[(f"x{i}", "İ") for i in range(20)]]
    items = [("a", [" p ", "P", None, "  ", "p"]), ("a", [" p ", "P", None, "  ", "p"]), ("b", None), *[(f"y{i}", []) for i in range(30)]]
    got = frequencies(spark, sections, items)
    assert got["text", "one"] == (1, 1, "rare")
    assert got["text", "two"] == (3, 2, None)  # 2 of 24 records
    assert got["text", "İ".lower()][:2] == (20, 20)
    assert ("text", "ghost") not in got
    assert got["identifiers", "p"] == (2, 1, "rare") and got["identifiers", "P"] == (1, 1, "rare")
    assert ("identifiers", "") not in got


def test_empty_tables(spark):
    assert frequencies(spark, []) == {}


RECORDS = "field_name string, record_id string, terms array<string>"


def index(rows, spark):
    ids = rows.select("record_id")
    numbers = terms.record_numbers(ids, ids.distinct().count())
    return numbers, terms.term_bitmaps(rows.join(numbers, "record_id").repartition(6))


def test_a_record_that_meets_the_union_twice_is_one_bit(spark):
    rows = spark.createDataFrame([("text", f"r{i:04d}", [f"w{i % 7}"] * (i % 3 + 1)) for i in range(1000)], RECORDS)
    _, once = index(rows, spark)
    united = terms.unite_bitmaps(once.unionByName(once).unionByName(once.where("term <> 'w1'")))
    got = {r.term: r.records for r in terms.term_frequencies(united).collect()}
    assert got == {f"w{k}": len(range(k, 1000, 7)) for k in range(7)}
    assert united.groupBy("field_name", "term", "chunk").count().where("count > 1").count() == 0


def test_bits_are_the_records_of_the_map(spark, monkeypatch):
    monkeypatch.setattr(terms, "CHUNK_RECORDS", 64)
    rows = spark.createDataFrame([("text", f"r{i:04d}", ["all", f"w{i % 40}", f"only{i}"][: 1 + i % 3]) for i in range(1000)] + [("text", "none", None)], RECORDS).repartition(5)
    numbers, bitmaps = index(rows, spark)
    names = {(r.chunk, r.low): r.record_id for r in numbers.collect()}
    assert len(names) == 1001 and len({c for c, _ in names}) > 8
    assert bitmaps.groupBy("term", "chunk").count().where("count > 1").count() > 0  # several tasks meet in one chunk
    want, got = {}, {}
    for r in rows.collect():
        for t in r.terms or []:
            want.setdefault(t, set()).add(r.record_id)
    united = terms.unite_bitmaps(bitmaps).toArrow()
    row, low = terms.positions(united.column("dense").to_numpy(), united.column("bits").combine_chunks())
    chunk, term = united.column("chunk").to_pylist(), united.column("term").to_pylist()
    for r, x in zip(row.tolist(), low.tolist()):
        got.setdefault(term[r], set()).add(names[chunk[r], x])
    assert got == want and set(united.column("dense").to_pylist()) == {True, False}


def test_buckets_over_a_chunk_go_on_in_another(spark, monkeypatch):
    monkeypatch.setattr(terms, "LOW_BITS", 4)
    ids = spark.range(100).selectExpr("cast(id as string) record_id")
    got = [(r.chunk, r.low) for r in terms.record_numbers(ids, 100).collect()]
    assert len(set(got)) == 100 and max(x for _, x in got) == 15


def test_chunks_follow_the_shuffle():
    assert terms.chunk_buckets(10, 200) == 1
    assert terms.chunk_buckets(16384 * 7, 200) == 8 and terms.chunk_buckets(16384 * 201, 200) == 400
