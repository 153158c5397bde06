import random

from pyspark.sql import functions as F

from tidemark.llm.line_runs import dedup_lines

SCHEMA = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(lower)
    last = 1 << 63
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), last + 1), last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str)


def test_batches_and_compaction_match_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line number {i} is long enough" for i in range(30)] + ["short", "", "  LINE number 3 is Long enough\t", "Éline number with É", "éline number with É"]
    rows = [(i, "\n".join(rng.choice(lines) + ("" if rng.random() < .6 else str(rng.random())) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    assert rows_of(dedup_lines(docs)) == expected
    assert rows_of(dedup_lines(docs, batch_bytes=200, max_batches=16, fan_out=2)) == expected


def test_nulls_repeats_and_clashing_columns(spark):
    same = "a line that two documents hold\nown"
    rows = [(2, same), (1, same), (1, same), (None, same), (3, None), (4, ""), (5, "\n\n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("__rest", "k1", "n_lines", "_id", "_gone", "size"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = dedup_lines(docs)
    assert rows_of(out) == brute(rows)
    assert {r["_gone"] for r in out.select("_gone").collect()} == {"mine"}


def test_empty_table(spark):
    assert rows_of(dedup_lines(spark.createDataFrame([], SCHEMA))) == []
