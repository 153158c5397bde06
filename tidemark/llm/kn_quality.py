"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Units are UTF-8 bytes, so no text is out of vocabulary; an n-gram of up to
seven bytes is one long.  Tasks count the n-grams of the highest order,
sharded sums make the corpus counts; every lower order counts the distinct
left extensions, context statistics and the probabilities of the next lower
order are joined on by n-gram, shard by shard.  The model grows with the
trusted text and covers all of it, but for every ``HOLD_OUT``-th document, on
which the thresholds rest.

A document's perplexity is exp(-mean log p) over its bytes.  Probabilities
reach the documents in one of two ways, with equal results: a model of at most
``BROADCAST_GRAMS`` entries is broadcast as a hash table (a checked, bounded
size); beyond, the documents' counted n-grams are joined with the model's
shards, order by order.

A few insults vanish in the mean of a long document.  A second model, of the
documents labelled toxic or of quality 0, is therefore held against the
trusted one: a document's contrast is its largest sum of log p (second model)
- log p (trusted) over ``WINDOW`` consecutive bytes.  With fewer
than ``LEAST`` such documents there is no contrast.

A document is rejected if one of its two scores lies too far above those of
the held-out trusted documents of its language (of all languages, where one
has fewer than ``LEAST``).  Scores are counted in spreads from the language's
median; the spread of log perplexity is wider the fewer bytes a text has, so a
short text sets no threshold for long ones.  The bounds, in spreads, leave
``QUANTILE`` of the held-out documents of all languages together.  A trusted
document is never rejected.

Defined results: null or empty text has no perplexity and is kept; a null
language is the language ""; repeated label rows count if any is trusted;
without trusted text nothing is rejected; rows that repeat are judged alike;
other columns are untouched, but added names replace equal ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import stored

ORDER = 5
QUANTILE = 0.99
HOLD_OUT = 5
LEAST = 20                      # held-out documents a language needs, and a second model
BROADCAST_GRAMS = 4_000_000     # model entries, 12 to 24 bytes each
BROADCAST_IDS = 1_000_000       # trusted ids
WINDOW = 32                     # bytes of the worst passage
STRIP = 4 << 20                 # bytes of text counted at once
SCORED = 1 << 20                # bytes of text scored at once
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
FLOOR = 1.0 / 256               # below the unigrams: all bytes alike
LOWEST = 4 * float(np.log(FLOOR))   # of a byte's log p in a contrast


def gram_keys(data: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each byte after the first order - 1."""
    n = len(data) - order + 1
    key = data[:n].astype(np.uint64)
    for i in range(1, order):
        key <<= np.uint64(8)
        key |= data[i:i + n]
    return key


def _padded(texts: list[bytes], order: int) -> np.ndarray:
    pad = b"\0" * (order - 1)
    return np.frombuffer(b"".join(pad + t for t in texts), np.uint8)


def _inside(texts: list[bytes], order: int) -> np.ndarray:
    """Which n-grams of the joined texts end on a byte of a text."""
    keep, at = np.ones(sum(len(t) + order - 1 for t in texts), bool), 0
    for t in texts:
        keep[at:at + order - 1] = False
        at += len(t) + order - 1
    return keep[order - 1:]


def strips(column: pa.Array, order: int, most: int | None = None):
    """``(first row, texts)`` of bounded size; null is empty."""
    held, size, first, most = [], 0, 0, most or STRIP
    for i in range(len(column)):
        held.append((column[i].as_py() or "").encode())
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def text_grams(texts: list[bytes], order: int) -> np.ndarray:
    return gram_keys(_padded(texts, order), order)[_inside(texts, order)] if texts else np.zeros(0, np.uint64)


def count_grams(text: DataFrame, order: int) -> DataFrame:
    """``(gram, n)`` over all rows of the one text column."""

    def count(batches):
        keys, counts, size = [], [], 0

        def merge():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype("i8")
            return [k], [n]

        for b in batches:
            for _, texts in strips(b.column(0), order):
                k, n = np.unique(text_grams(texts, order), return_counts=True)
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > 1 << 22:
                    keys, counts = merge()
                    size = 0
        if keys:
            keys, counts = merge()
            for i in range(0, len(keys[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][i:i + (1 << 17)].astype("i8")),
                                                  pa.array(counts[0][i:i + (1 << 17)])], ["gram", "n"])

    return text.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D(0), D1, D2, D3+ from the counts of counts; where those are too few,
    half of the count."""
    n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [0.0] + [min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else i * 0.5 for i in (1, 2, 3)]


def train(text: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of one text column: ``(n, gram, p, g)``; ``p`` is the
    probability of a seen n-gram, ``g`` the back-off weight of a context that
    is the n-gram without its last byte (rows with null p)."""
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7 bytes")
    counts = {order: stored(count_grams(text, order), "kn-counts")}
    for n in range(order - 1, 0, -1):
        mask = (1 << (8 * n)) - 1
        counts[n] = stored(counts[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"))
                           .agg(F.count("*").alias("n")), "kn-counts")
    parts, below = [], None
    for n in range(1, order + 1):
        d = discounts(counts[n])
        level = counts[n].withColumns({
            "context": F.shiftright("gram", 8),
            "d": F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])})
        context = level.groupBy("context").agg(
            F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g"))
        level = level.join(context, "context")
        if n == 1:
            level = level.withColumn("low", F.lit(FLOOR))
        else:
            lower = below.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            level = level.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))).join(lower, "tail")
        below = stored(level.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("g") * F.col("low")).alias("p")),
                       "kn-grams")
        gone = F.lit(None).cast("double")
        parts += [below.select(F.lit(n).alias("n"), "gram", "p", gone.alias("g")),
                  context.select(F.lit(n).alias("n"), F.col("context").alias("gram"), gone.alias("p"), "g")]
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return stored(model, "kn-model")


# ---- scoring with a broadcast model ------------------------------------

def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype("i8")


def hash_table(keys: np.ndarray, values: np.ndarray):
    bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
    slots, held = np.full(1 << bits, EMPTY), np.zeros(1 << bits, "f4")
    at, todo = _slot(keys, bits), np.arange(len(keys))
    while len(todo):
        _, first = np.unique(at[todo], return_index=True)
        first = first[slots[at[todo[first]]] == EMPTY]
        put = todo[first]
        slots[at[put]], held[at[put]] = keys[put], values[put]
        todo = np.delete(todo, first)
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
    return bits, slots, held


def look_up(table, keys: np.ndarray):
    """Values and which keys were found."""
    bits, slots, held = table
    at = _slot(keys, bits)
    got = slots[at]
    hit = got == keys
    todo = np.flatnonzero(~hit & (got != EMPTY))
    while len(todo):
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        got = slots[at[todo]]
        same = got == keys[todo]
        hit[todo[same]] = True
        todo = todo[~same & (got != EMPTY)]
    return held[at], hit


def log_p(keys: np.ndarray, tables: dict, order: int) -> np.ndarray:
    out, back, todo, k = np.zeros(len(keys)), np.zeros(len(keys)), np.arange(len(keys)), keys
    for n in range(order, 0, -1):
        value, hit = look_up(tables[n, "p"], k)
        out[todo[hit]] = back[todo[hit]] + np.log(value[hit].astype("f8"))
        todo, k = todo[~hit], k[~hit]
        if not len(todo):
            return out
        g, seen = look_up(tables[n, "g"], k >> np.uint64(8))
        back[todo[seen]] += np.log(g[seen].astype("f8"))
        k = k & np.uint64((1 << (8 * (n - 1))) - 1)
    out[todo] = back[todo] + np.log(FLOOR)
    return out


def _tables(model: DataFrame, order: int) -> dict:
    rows = model.toArrow()          # at most BROADCAST_GRAMS rows
    n, gram = rows.column("n").to_numpy(), rows.column("gram").to_numpy().astype(np.uint64)
    p, g = rows.column("p").to_numpy(), rows.column("g").to_numpy()
    tables = {}
    for i in range(1, order + 1):
        tables[i, "p"] = hash_table(gram[(n == i) & ~np.isnan(p)], p[(n == i) & ~np.isnan(p)])
        tables[i, "g"] = hash_table(gram[(n == i) & np.isnan(p)], g[(n == i) & np.isnan(p)])
    return tables


def worst(x: np.ndarray) -> float:
    """The largest sum of ``WINDOW`` consecutive values, or of all of fewer."""
    total = np.concatenate([[0], np.cumsum(x)])
    v = min(WINDOW, len(x))
    return float((total[v:] - total[:len(total) - v]).max())


def _broadcast_scores(model: DataFrame, against: DataFrame | None, text: Column, order: int) -> Column:
    """``(perplexity, contrast)`` of a text in one pass over it, both models
    in one broadcast; the log p of the trusted model serves both."""
    held = model.sparkSession.sparkContext.broadcast((_tables(model, order), _tables(against, order) if against is not None else None))

    @F.arrow_udf("struct<perplexity:double,contrast:double>")
    def scores(column: pa.Array) -> pa.Array:
        good, bad = held.value
        perplexity, contrast = [], []

        def apart(keys, x):
            return np.maximum(log_p(keys, bad, order), LOWEST) - np.maximum(x, LOWEST)

        for _, texts in strips(column, order, SCORED):
            if sum(map(len, texts)) <= 2 * SCORED:
                keys = text_grams(texts, order)
                x = log_p(keys, good, order)
                z = apart(keys, x) if bad else None
                at = 0
                for t in texts:
                    end = at + len(t)
                    perplexity.append(float(np.exp(-x[at:end].sum() / len(t))) if t else None)
                    contrast.append(worst(z[at:end]) if t and bad else None)
                    at = end
                continue
            for t in texts:             # very long texts, in overlapping strips
                total, best, last, data = 0.0, None, np.zeros(0), _padded([t], order)
                for at in range(0, len(t), SCORED):
                    keys = gram_keys(data[at:at + SCORED + order - 1], order)
                    x = log_p(keys, good, order)
                    total += x.sum()
                    if bad:
                        z = np.concatenate([last, apart(keys, x)])
                        best = worst(z) if best is None else max(best, worst(z))
                        last = z[-(WINDOW - 1):]
                perplexity.append(float(np.exp(-total / len(t))) if t else None)
                contrast.append(best)
        return pa.StructArray.from_arrays([pa.array(perplexity, pa.float64()), pa.array(contrast, pa.float64())], ["perplexity", "contrast"])

    return scores(text)


# ---- scoring by joins ----------------------------------------------------

def _joined_logs(texts: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``(row, key, n, x)``: log p of each n-gram of ``texts(row, text)`` by
    joins with the model."""

    def grams(batches):
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, n = np.unique(text_grams([t.encode()], order), return_counts=True)
                for i in range(0, len(k), 1 << 16):
                    part = k[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(part), pa.string()), pa.array(part.astype("i8")),
                         pa.array(n[i:i + (1 << 16)].astype("i8"))], ["row", "gram", "n"])

    left = texts.where(F.length("text") > 0).mapInArrow(grams, "row string, gram long, n long").select(
        "row", F.col("gram").alias("key"), "gram", "n", F.lit(0.0).alias("back"))
    sums = []
    for n in range(order, 0, -1):
        p = model.where((F.col("n") == n) & F.col("p").isNotNull()).select("gram", "p")
        g = model.where((F.col("n") == n) & F.col("p").isNull()).select(F.col("gram").alias("context"), "g")
        both = left.join(p, "gram", "left")
        sums.append(both.where("p is not null").select("row", "key", "n", (F.col("back") + F.log("p")).alias("x")))
        left = (both.where("p is null").drop("p").withColumn("context", F.shiftright("gram", 8)).join(g, "context", "left")
                .select("row", "key", F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)).alias("gram"), "n",
                        (F.col("back") + F.coalesce(F.log("g"), F.lit(0.0))).alias("back")))
    sums.append(left.select("row", "key", "n", (F.col("back") + float(np.log(FLOOR))).alias("x")))
    whole = sums[0]
    for s in sums[1:]:
        whole = whole.unionByName(s)
    return whole


def _joined_scores(texts: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``(row, perplexity)`` of ``texts(row, text)``."""
    return _joined_logs(texts, model, order).groupBy("row").agg(
        F.exp(-F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("perplexity"))


def _joined_contrasts(texts: DataFrame, model: DataFrame, against: DataFrame, order: int) -> DataFrame:
    """``(row, contrast)`` of ``texts(row, text)``."""
    good = _joined_logs(texts, model, order).select("row", "key", "x")
    bad = _joined_logs(texts, against, order).select("row", "key", F.col("x").alias("z"))
    logs = good.join(bad, ["row", "key"]).groupBy("row").agg(
        F.collect_list(F.struct(
            "key", (F.greatest("z", F.lit(LOWEST)) - F.greatest("x", F.lit(LOWEST))).alias("x"))).alias("logs"))

    @F.arrow_udf("double")
    def contrast(text: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for t, k, x in zip(text.to_pylist(), keys.to_pylist(), values.to_pylist()):
            k, x = np.array(k, "i8"), np.array(x)
            at = np.argsort(k)
            grams = text_grams([t.encode()], order).astype("i8")
            out.append(worst(x[at][np.searchsorted(k[at], grams)]))
        return pa.array(out, pa.float64())

    return texts.join(logs, "row").select("row", contrast("text", "logs.key", "logs.x").alias("contrast"))


def with_perplexity(docs: DataFrame, model: DataFrame, text_col: str = "text", order: int = ORDER,
                    broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` with ``perplexity``."""
    if model.count() <= broadcast_grams:
        return docs.withColumn("perplexity", _broadcast_scores(model, None, F.col(text_col), order)["perplexity"])
    keyed = docs.withColumn("__kn_row", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    texts = keyed.groupBy(F.col("__kn_row").alias("row")).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    scores = _joined_scores(texts, model, order).withColumnRenamed("row", "__kn_row")
    return keyed.drop("perplexity").join(scores, "__kn_row", "left").drop("__kn_row")


def with_scores(docs: DataFrame, model: DataFrame, against: DataFrame, text_col: str = "text", order: int = ORDER,
                broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` with ``perplexity`` and ``__kn_contrast``; null for null or
    empty text."""
    if model.count() + against.count() <= broadcast_grams:
        both = docs.withColumn("__kn_scores", _broadcast_scores(model, against, F.col(text_col), order))
        return both.withColumns({"perplexity": F.col("__kn_scores.perplexity"), "__kn_contrast": F.col("__kn_scores.contrast")}).drop("__kn_scores")
    docs = with_perplexity(docs, model, text_col, order, broadcast_grams)
    keyed = docs.withColumn("__kn_row", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    texts = keyed.groupBy(F.col("__kn_row").alias("row")).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    scores = _joined_contrasts(texts, model, against, order).select(
        F.col("row").alias("__kn_row"), F.col("contrast").alias("__kn_contrast"))
    return keyed.join(scores, "__kn_row", "left").drop("__kn_row")


def _spreads(held: DataFrame) -> DataFrame:
    """Of each ``lang``: the median ``mu`` and variance ``a + b / bytes`` of the
    log perplexity, the median and spread of the contrast, and the count."""
    half = lambda c: F.percentile_approx(c, 0.5, 10_000)
    middle = held.groupBy("lang").agg(half("x").alias("mu"), half("bytes").alias("half"), half("contrast").alias("mid"),
                                      F.count("*").alias("n"))
    square = F.pow(F.col("x") - F.col("mu"), 2) / 0.455         # the median of a squared normal deviate
    return held.join(middle, "lang").groupBy("lang", "mu", "mid", "n").agg(
        F.coalesce(half(F.when(F.col("bytes") >= F.col("half"), square)), F.lit(0.0)).alias("a"),
        F.coalesce(half(F.when(F.col("bytes") < F.col("half"), square * F.col("bytes"))), F.lit(0.0)).alias("b"),
        (half(F.abs(F.col("contrast") - F.col("mid"))) * 1.4826).alias("mad"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", *, order: int = ORDER, quantile: float = QUANTILE,
             hold_out: int = HOLD_OUT, broadcast_grams: int = BROADCAST_GRAMS,
             broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` (null: none) and ``kept``.
    ``labels(id, quality, toxic)`` names trusted documents: quality 1, toxic 0."""
    trusted = stored(labels.where("quality = 1 and toxic = 0").select(F.col(id_col).alias("__kn_id")).distinct(), "kn-trusted")
    if trusted.count() <= broadcast_ids:
        trusted = F.broadcast(trusted)
    slim = docs.select(F.col(id_col).alias("__kn_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(lang_col), F.lit("")).alias("lang")).where(F.length("text") > 0)
    suspect = labels.where("quality = 0 or toxic = 1").select(F.col(id_col).alias("__kn_id")).distinct().join(
        trusted, "__kn_id", "left_anti")
    suspect = stored(suspect, "kn-suspect")
    if suspect.count() <= broadcast_ids:
        suspect = F.broadcast(suspect)
    bad = slim.join(suspect, "__kn_id", "left_semi").select("text")
    against = train(bad, order)
    slim = slim.join(trusted, "__kn_id", "left_semi")
    aside = F.pmod(F.xxhash64("__kn_id"), F.lit(hold_out)) == 0
    model = train(slim.where(~aside).select("text"), order)
    contrasted = bad.count() >= LEAST and not model.isEmpty()

    def scored(rows: DataFrame, text: str) -> DataFrame:
        if contrasted:
            return with_scores(rows, model, against, text, order, broadcast_grams)
        return with_perplexity(rows, model, text, order, broadcast_grams).withColumn("__kn_contrast", F.lit(None).cast("double"))

    held = stored(scored(slim.where(aside), "text").select(
        "lang", F.log("perplexity").alias("x"), F.octet_length("text").alias("bytes"),
        F.col("__kn_contrast").alias("contrast")), "kn-held-out")
    whole = _spreads(held.withColumn("lang", F.lit(""))).first()
    names = ("mu", "a", "b", "mid", "mad")
    by_lang = stored(_spreads(held).where(F.col("n") >= LEAST).select(
        F.col("lang").alias("__kn_lang"), *[F.col(c).alias(f"__kn_{c}") for c in names]), "kn-spreads")
    mu, a, b, mid, mad = [F.coalesce(f"__kn_{c}", F.lit(whole[c] if whole else None).cast("double")) for c in names]
    wide = lambda size: F.sqrt(F.greatest(a + b / size, F.lit(1e-12)))
    most = F.greatest(mad, F.lit(1e-6))
    share = 1 - (1 - quantile) / 2 if contrasted else quantile
    cut = held.withColumn("__kn_lang", F.col("lang")).join(by_lang, "__kn_lang", "left").agg(
        F.percentile_approx((F.col("x") - mu) / wide(F.col("bytes")), share, 10_000),
        F.percentile_approx((F.col("contrast") - mid) / most, share, 10_000)).first()
    cut = [F.lit(c).cast("double") for c in cut]
    out = scored(docs, text_col).withColumn("__kn_lang", F.coalesce(F.col(lang_col), F.lit("")))
    out = out.join(by_lang, "__kn_lang", "left").join(
        trusted.withColumn("__kn_trusted", F.lit(True)), F.col(id_col) == F.col("__kn_id"), "left")
    size = F.greatest(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1))
    out = out.withColumn("threshold", F.exp(mu + cut[0] * wide(size)))
    fine = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(
        F.col("__kn_contrast") <= mid + cut[1] * most, F.lit(True))
    return out.withColumn("kept", fine | F.coalesce("__kn_trusted", F.lit(False))).drop(
        "__kn_lang", "__kn_id", "__kn_trusted", "__kn_contrast", *[f"__kn_{c}" for c in names])
