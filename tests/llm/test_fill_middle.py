import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle as fm

SCHEMA = "doc_id long, text string"


def brute(doc_id, text, percent=100, spm=50):
    """By regular expression over code points."""
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fm.SENTINELS) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", *fm.ADDED.names).collect()], key=str)


def texts(rng, n):
    alphabet = ["\n", "\n", "a", "é", "漢", "😀", " ", " ", "\x0b", "\x8a", "<", "<P", "S>", "\x00", "ab\nc" * 3]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_marks_of_every_byte_and_place():
    rng = np.random.default_rng(1)
    for data in (np.arange(256, dtype=np.uint8), rng.integers(8, 13, 1000).astype(np.uint8), np.full(64, 10, np.uint8)):
        words = fm.words_of(data)
        for marks, want in ((fm.line_end_marks(words), data == 10), (fm.continuation_marks(words), (data & 0xC0) == 0x80)):
            index = fm.Marks(marks)
            assert index.rank(np.arange(len(data) + 1)).tolist() == np.concatenate([[0], np.cumsum(want)]).tolist()
            assert index.select(np.arange(want.sum())).tolist() == np.flatnonzero(want).tolist()


def test_matches_brute_force_and_is_restored(spark, monkeypatch):
    rng = random.Random(2)
    rows = list(enumerate(texts(rng, 400)))
    rows += [(1000, "\n"), (1001, "x"), (1002, "\n" * 50), (1003, "no <P> here"), (1004, "<S>\n\n"), (1005, "a\nb<M>"),
             (1006, ("long line é " * 50 + "\n") * 3000), (None, "a\nb\nc"), (None, None), (1007, None), (1008, ""), (7, "a\nb"), (7, "a\nb")]
    monkeypatch.setattr(fm, "SLICE", 200)
    out = fm.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(out) == sorted([brute(*r) for r in rows], key=str)
    back = out.select("text", fm.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_percent_and_order_parameters(spark):
    rows = [(i, f"a{i}\nb\nc\n") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(fm.fill_in_middle(docs, percent=30, spm_percent=0)) == sorted([brute(*r, percent=30, spm=0) for r in rows], key=str)
    with pytest.raises(ValueError):
        fm.fill_in_middle(docs, sentinels=("ab", "bc", "x"))


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb")], SCHEMA)
    for c in ("n", "form", "row", "body", "h", "output", "a.b"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = fm.fill_in_middle(docs).first()
    assert (out["row"], out["body"], out["h"], out["a.b"]) == ("mine",) * 4
    assert (out["n"], out["form"], out["output"]) == (2, brute(1, "a\nb")[2], brute(1, "a\nb")[5])
    assert rows_of(fm.fill_in_middle(spark.createDataFrame([], SCHEMA))) == []
