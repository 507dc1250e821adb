import base64
import random

import pytest
from pyspark.sql import types as T

from docloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(bpe.vocabulary_path()))


TEXTS = ["", " ", "a", "Hello  world\n\n", "don't we'll I'M", "<|endoftext|> x", "見出し解析器が無い。", "é ﻿​ x", "🚧👩‍💻", "1234567890" * 30, "a" * 3000, "\t\r\n  x ", "ไทย ภาษา", "क्या समय"]


def test_same_ids_as_another_implementation(spark, reference):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}


def test_round_trip(spark):
    v = bpe.Vocabulary.load(bpe.vocabulary_path())
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in bpe.encode_corpus(df).collect():
        assert b"".join(v.tokens[i] for i in r.ids).decode() == TEXTS[r.doc_id]


def test_long_and_short_words_agree(encoder):
    rng = random.Random(3)
    for size in (2, 3, 17, 200):
        w = "".join(rng.choice("abcdefé見") for _ in range(size)).encode()
        assert encoder._matrix([w])[0].tolist() == encoder._heap(w).tolist()


def test_forgetting_words_changes_nothing(encoder, reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder.forget()
    lists = [["ab", " cd", " zz9"], None, [], [" zz9", "ab"], ["qx" * 40]]
    got = [encoder.encode_lists(pa.array([x], pa.list_(pa.string()))).to_pylist()[0] for x in lists]
    assert got == [[i for w in x or [] for i in reference.encode_ordinary(w)] for x in lists]


def test_empty_table_repeated_rows_and_other_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("k", T.StringType())])
    assert bpe.encode_corpus(spark.createDataFrame([], schema)).collect() == []
    twice = bpe.encode_corpus(spark.createDataFrame([(1, "ab", "x", "y")] * 2, schema)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
