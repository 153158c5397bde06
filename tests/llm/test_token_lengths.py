import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import token_lengths as tl

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=tl.default_model())


def brute(model, rows, limit=tl.LIMIT):
    out = []
    for i, t in rows:
        n = len(model.encode(t or ""))
        out.append((i, len((t or "").encode()), n, n > limit))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()], key=str)


def odd_texts(rng, n):
    bits = [" ", "  ", "\n", "\t", "▁", "a", "the", " The", "ing", "é", "ß", "漢字", "😀", "\x00", "\xa0", "</s>", "<s>", "<unk>", "<0x0A>",
            ".", ",", "...", "http://", "12", "3", "(", ")", "　", "Ａ", "é", "\x7f", "▀", "▁x", "—", "'s"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_odd_texts_match_the_library(spark, model):
    rows = list(enumerate(odd_texts(random.Random(5), 3000)))
    rows += [(9000, None), (9001, ""), (9002, " "), (9003, "\n"), (None, "null key"), (7, "twice"), (7, "twice"), (9004, "x" * 5000), (9005, "▁")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(tl.count_tokens(docs)) == brute(model, rows)


def test_documents_match_the_library(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(tl.count_tokens(docs)) == brute(model, rows)


def test_small_table_cache_and_strips_change_nothing(spark, model, monkeypatch):
    for name, value in (("TABLE", 5), ("TASK_TOP", 3), ("SUMMARY", 8), ("STRIP", 64), ("CACHE_BYTES", 300), ("CACHED_UNIT", 3)):
        monkeypatch.setattr(tl, name, value)
    rows = list(enumerate(odd_texts(random.Random(6), 300))) + [(1000, "word " * 500 + "y" * 900 + " end"), (1001, " " * 300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(tl.count_tokens(docs, limit=20)) == brute(model, rows, 20)


def test_table_is_exact():
    rng = np.random.default_rng(3)
    units = list({rng.integers(0, 4, rng.integers(1, 17)).astype(np.uint8).tobytes() for _ in range(3000)})
    held, others = units[::2], units[1::2]
    table = tl.Table(held, [i % 200 for i in range(len(held))])
    for group, want in ((held, [i % 200 for i in range(len(held))]), (others, [-1] * len(others))):
        sizes = np.array([len(u) for u in group])
        padded = np.frombuffer(b"".join(group) + bytes(16), np.uint8)
        keys = tl.unit_keys(padded, np.cumsum(sizes) - sizes, sizes)
        assert table.look_up(*keys, sizes).tolist() == want


def test_clashing_columns_and_empty_table(spark, model):
    docs = spark.createDataFrame([(1, "two words")], SCHEMA)
    for c in ("row", "body", "n_tokens", "over_limit", "unit", "a.b"):
        docs = docs.withColumn(c, F.lit("mine"))
    r = tl.count_tokens(docs, limit=1).first()
    assert (r["row"], r["body"], r["unit"], r["a.b"]) == ("mine",) * 4
    assert (r["n_tokens"], r["over_limit"]) == (len(model.encode("two words")), True)
    assert rows_of(tl.count_tokens(spark.createDataFrame([], SCHEMA))) == []
