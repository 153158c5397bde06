"""The pipeline and the registered queries."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.common import connected_components, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tion ing her that with eat ore".split()


def prose(rng, n):
    return ". ".join(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(12)) + "\n" for _ in range(n)).strip()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(4, 9)), rng.choice(["en", "fr", None]), f"src{i % 5}") for i in range(120)]
    rows += [(200, rows[3][1], "en", "src1"), (201, rows[4][1].replace("\n", " \n "), "en", "src2")]           # copies
    rows += [(210, rows[5][1].replace(" ", "  ") + " one more", "en", "src3")]
    rows += [(220 + i, " | ".join(w.upper() + "!!" for w in prose(rng, 3).split()), "en", "src1") for i in range(8)]
    rows += [(300, None, None, None), (301, "", "en", "src0"), (None, "the of and her", "en", "src4"), (7, rows[7][1], rows[7][2], rows[7][3])]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], SCHEMA)
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(220, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("mine") for c in ("kept", "n", "id", "k1", "__rest2")})
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "copies", "mix", "pieces"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), "t")
        if name != "pieces":
            assert out.columns == docs.columns and {r.kept for r in out.select("kept").collect()} == {"mine"}
        seen[name] = [r.doc_id for r in out.collect()]
        docs = out
    assert not set(range(220, 228)) & set(seen["quality"])
    assert len(set(range(120)) & set(seen["quality"])) > 105 and {300, 301} <= set(seen["quality"])
    assert not {200, 201, 210} & set(seen["copies"])
    clean = set(range(120)) & set(seen["quality"])
    assert clean <= set(seen["copies"]) and seen["copies"].count(7) <= 1
    assert set(seen["mix"]) <= set(seen["copies"]) and sorted(seen["pieces"], key=str) == sorted(seen["mix"], key=str)


@pytest.mark.parametrize("odd", [[], [(None, "a text without an id"), (900, "one"), (900, "two")]])
def test_copies_between_the_bounds(spark, odd):
    """Five-word similarity at least .80, four-word similarity under .85."""
    rng = random.Random(3)

    def shingles(t, n):
        w = t.split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    rows = []
    for i in range(8):
        words = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(120)]
        one, two = " ".join(words[:100]), " ".join(words)
        for n, low, high in ((5, 0.8, 1), (4, 0, 0.85)):
            a, b = shingles(one, n), shingles(two, n)
            assert low <= len(a & b) / len(a | b) < high
        rows += [(i, one), (100 + i, two)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.copies(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([*range(8), *[i for i, _ in odd]], key=str)


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 50
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    tidy = lambda rows: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=str)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert tidy(got.select(*columns).collect()) == tidy(want.fetchall())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(a):
        while parent.get(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    ids = spark.range(140).select("id")
    out = connected_components(ids, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in out} == {i: root(i) for i in range(140)}


@pytest.mark.parametrize("turned", [False, True])
def test_of_rows_equal_in_id_and_text_one_stays_whatever_their_order(spark, turned):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "en", s, 48) for s in ("b", "a", None, "c")] + [(6, "", "en", "d", 0)] * 2
    docs = spark.createDataFrame(rows[::-1] if turned else rows, SCHEMA).repartition(3)
    out = corpus_pipeline.copies(spark, docs, "").collect()
    assert [r.source for r in out if r.doc_id == 5] == [None]      # the first as JSON text, which leaves nulls out
    assert [r.source for r in out if r.doc_id == 6] == ["d", "d"]
