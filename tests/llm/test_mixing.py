from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def fill(budget, caps, weights):
    """Water-filling by whole rounds, with exact fractions."""
    from fractions import Fraction
    names = [n for n in caps if weights[n] > 0]
    share, live, rest = {n: 0 for n in caps}, set(names), Fraction(min(budget, sum(caps[n] for n in names)))
    while live:
        w = sum(weights[n] for n in live)
        full = [n for n in live if caps[n] <= rest * weights[n] / w]
        if not full:
            for n in live:
                share[n] = rest * weights[n] / w
            break
        for n in full:
            share[n] = caps[n]
            rest -= caps[n]
            live.remove(n)
    return share


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 100), ("a", "en", "y", 5), ("a", "fr", "x", 3), ("b", "en", "z", 1000)],
                                   "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(
        leaves, (1, 2), 1, ({"a": 1, "b": 1}, {"en": 1, "fr": 1}, {})).collect()}
    total = 1108 // 2
    assert sum(got.values()) == total
    top = fill(total, {"a": 108, "b": 1000}, {"a": 1, "b": 1})
    assert got["b", "en", "z"] == top["b"] == 446
    assert (got["a", "en", "x"], got["a", "en", "y"], got["a", "fr", "x"]) == (100, 5, 3)


def test_budgets_match_water_filling(spark):
    import random
    rng = random.Random(5)
    caps = {f"s{i}": rng.randint(0, 300) for i in range(12)}
    weights = {n: rng.randint(0, 5) for n in caps}
    leaves = spark.createDataFrame([("a", "en", n, c) for n, c in caps.items()], "domain string, lang string, source string, tokens long")
    for num in (1, 3, 9):
        got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, (num, 10), 2, ({}, {}, weights)).collect()}
        want = fill(sum(caps.values()) * num // 10, {n: 2 * c for n, c in caps.items()}, weights)
        assert all(abs(got[n] - want[n]) < 1 for n in caps), (num, got, want)
        assert sum(got.values()) == sum(want.values())


def test_epochs_and_prefix(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 4), "en", "s0") for i in range(50)], SCHEMA)
    tokens = sum(1 + i % 4 for i in range(50))
    out = mixing.select_mix(docs, budget=(3, 2), max_epochs=2, domain=F.lit("d")).collect()
    epochs = Counter(r.mix_epoch for r in out)
    assert epochs[1] == 50 and 0 < epochs[2] < 50
    second = sum(r.mix_tokens for r in out if r.mix_epoch == 2)
    rest = tokens * 3 // 2 - tokens
    assert second <= rest and second > rest - 4
    again = mixing.select_mix(docs, budget=(3, 2), max_epochs=2, domain=F.lit("d")).collect()
    assert sorted((r.doc_id, r.mix_epoch) for r in again) == sorted((r.doc_id, r.mix_epoch) for r in out)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, None, None, None), (2, "", "en", "s1"), (3, "a b", "en", "s1"), (3, "a b", "en", "s1"), (None, "c", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("budget", "tokens", "share", "mix_epoch", "domain", "w", "root"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = mixing.select_mix(docs, budget=(1, 1), max_epochs=1)
    assert {r["share"] for r in out.collect()} == {"mine"}
    assert sorted(r.mix_tokens for r in out.collect()) == [0, 1, 2, 2]
    assert mixing.select_mix(spark.createDataFrame([], SCHEMA)).count() == 0
