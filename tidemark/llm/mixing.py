"""Mixing sources to target weights by hierarchical budgeting (native).

Documents hang below a tree domain -> language -> source.  A token budget is
propagated from the root: at every node the children share the node's budget
by integer weights; a child whose leaves cannot supply its share (tokens x
``max_epochs``) gives the shortage back, which goes to its siblings by weight
first, and only what a whole subtree cannot take moves to the ancestor's other
subtrees (a node's own capacity is the sum below it, so water-filling from
the root does exactly that).  All amounts are integers and add up.

Each leaf then takes whole seeded epochs (every document once) and, for the
rest of its budget, the token-prefix of one more epoch: documents in the order
of md5(seed:epoch:id) while the running token sum fits.  The running sum is
found in two steps, sums of 4,096 hash buckets and rows of the one bucket the
border falls in, so a leaf with a third of all rows is never sorted whole.

Defined results: null text has no tokens (such a document rides along at no
cost where the prefix reaches it); null language or source is the child "";
weights not named are ``DEFAULT_WEIGHT``; a weight of 0 takes nothing; equal
rows are interchangeable; empty input gives an empty result; columns of the
input that share a name with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import stored

DOMAIN_WEIGHTS = {"group0": 4, "group1": 3, "group2": 2, "group3": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
DEFAULT_WEIGHT = 1
BUDGET = (4, 5)             # of the tokens there are
MAX_EPOCHS = 2
SEED = 17
BUCKET_HEX = 3              # 16 ** 3 buckets for running sums

TREE = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words.cast("long")


def source_group(source: Column) -> Column:
    """Default domain: the number a source name ends in, modulo four."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(
        F.concat(F.lit("group"), (F.when(number != "", number).cast("int") % 4).cast("string")))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children(parent.., name, cap, w, budget)`` with ``budget`` (the
    parent's) replaced by the child's share."""
    # w > 0 here; the smallest cap per weight fills up first
    order = W.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")), F.col(name))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    c = children.withColumns({
        "left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("w").over(after), "at": F.row_number().over(order)})
    c = c.withColumn("short", F.expr("cap * weights <= left * w"))
    first = W.partitionBy(*parent)
    c = c.withColumn("stop", F.min(F.when(~F.col("short"), F.col("at"))).over(first))
    c = c.withColumns({
        "open": F.max(F.when(F.col("at") == F.col("stop"), F.col("left"))).over(first),
        "open_w": F.max(F.when(F.col("at") == F.col("stop"), F.col("weights"))).over(first)})
    c = c.withColumn("share", F.expr(
        "if(stop is null or at < stop, cap, open * w div open_w)"))
    spare = F.col("open") - F.sum(F.when(F.col("at") >= F.col("stop"), F.col("share"))).over(first)
    share = F.col("share") + F.when(
        F.col("stop").isNotNull() & (F.col("at") >= F.col("stop"))
        & (F.col("at") - F.col("stop") < spare), 1).otherwise(0)
    return c.withColumn("budget", share).drop(
        "left", "weights", "at", "short", "stop", "open", "open_w", "share")


def leaf_budgets(leaves: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS,
                 weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
                 ) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with each leaf's ``budget``."""
    usable = F.lit(True)
    for level, w in zip(TREE, weights):
        usable = usable & (_weight(F.col(level), w) > 0)
    live = leaves.where(usable).withColumn("cap", F.col("tokens") * max_epochs)
    above = leaves.agg(F.least(                              # one row
        F.expr(f"coalesce(sum(tokens), 0) * {budget[0]} div {budget[1]}"),
        F.coalesce(F.sum(F.when(usable, F.col("tokens") * max_epochs)), F.lit(0))).alias("budget"))
    above = above.withColumn("root", F.lit(0))
    live = live.withColumn("root", F.lit(0))
    keys = ["root"]
    for level, w in zip(TREE, weights):
        nodes = live.groupBy(*keys, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("w", _weight(F.col(level), w)).join(above, keys)
        above = water_fill(nodes, keys, level).drop("cap", "w")
        keys = [*keys, level]
    return leaves.join(above.drop("root"), list(TREE), "left").withColumn(
        "budget", F.coalesce("budget", F.lit(0)))


def select_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source", *, domain: Column | None = None,
               budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
               weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
               ) -> DataFrame:
    """``docs`` once per (row, epoch) taken, with ``mix_domain``, ``mix_epoch``
    (from 1), ``mix_tokens`` and ``mix_budget`` (the leaf's)."""
    blank = F.lit("")
    key = {"__mx_domain": F.coalesce(domain if domain is not None else source_group(F.col(source_col)), blank),
           "__mx_lang": F.coalesce(F.col(lang_col).cast("string"), blank),
           "__mx_source": F.coalesce(F.col(source_col).cast("string"), blank)}
    id_text = F.coalesce(F.col(id_col).cast("string"), blank)
    slim = stored(docs.select(*[c.alias(k) for k, c in key.items()], id_text.alias("__mx_id"),
                              token_count(F.col(text_col)).alias("__mx_tokens")), "mix-slim")
    leaves = slim.groupBy(*key).agg(F.sum("__mx_tokens").alias("tokens"))
    leaves = leaves.select(*[F.col(f"__mx_{k}").alias(k) for k in TREE], "tokens")
    plan = leaf_budgets(leaves, budget, max_epochs, weights).select(
        *[F.col(k).alias(f"__mx_{k}") for k in TREE], F.col("budget").alias("__mx_budget"),
        F.expr("coalesce(if(tokens = 0, 0, budget div tokens), 0)").alias("__mx_whole"),
        F.expr("coalesce(if(tokens = 0, 0, budget % tokens), 0)").alias("__mx_rest"))
    plan = stored(plan, "mix-plan")

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("__mx_whole") + 1).cast("string"), F.col("__mx_id")))
    bucket = F.substring(order, 1, BUCKET_HEX)
    # the leaf table has one row per source; Spark broadcasts it only if it is small
    sums = (slim.join(plan, list(key)).where("__mx_rest > 0").withColumn("__mx_bucket", bucket)
            .groupBy(*key, "__mx_bucket", "__mx_rest").agg(F.sum("__mx_tokens").alias("t")))
    run = F.sum("t").over(W.partitionBy(*key).orderBy("__mx_bucket"))
    border = (sums.withColumn("end", run).where(F.col("end") > F.col("__mx_rest"))
              .groupBy(*key).agg(F.min(F.struct("__mx_bucket", (F.col("end") - F.col("t")).alias("before"))).alias("b")))
    plan = stored(plan.join(border, list(key), "left").select(
        *plan.columns, F.col("b.__mx_bucket").alias("__mx_border"),
        F.coalesce("b.before", F.lit(0)).alias("__mx_before")), "mix-plan")

    full = (docs.withColumns({**key, "__mx_id": id_text}).join(plan, list(key))
            .withColumns({"__mx_order": order}).withColumn("__mx_bucket", F.substring("__mx_order", 1, BUCKET_HEX)))
    # epochs 1..whole are taken in full; the next one as far as its prefix goes
    inside = F.col("__mx_bucket") < F.col("__mx_border")
    at_border = F.col("__mx_bucket") == F.col("__mx_border")
    last = F.col("__mx_whole") + F.when(inside, 1).otherwise(0)
    whole = full.where(last > 0).withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    w = W.partitionBy(*key).orderBy("__mx_order", F.xxhash64(F.col(text_col))).rowsBetween(W.unboundedPreceding, 0)
    part = (full.where(at_border).withColumn("__mx_sum", F.col("__mx_before") + F.sum(token_count(F.col(text_col))).over(w))
            .where(F.col("__mx_sum") <= F.col("__mx_rest"))
            .withColumn("mix_epoch", F.col("__mx_whole") + 1).drop("__mx_sum"))
    out = whole.unionByName(part.select(*whole.columns))
    return out.withColumns({"mix_domain": F.col("__mx_domain"), "mix_epoch": F.col("mix_epoch").cast("int"),
                            "mix_tokens": token_count(F.col(text_col)), "mix_budget": F.col("__mx_budget")}
                           ).drop(*[c for c in out.columns if c.startswith("__mx_")])
