"""Line dedup with levelled sorted runs (native DataFrame work only).

Every line of every document gets a 128-bit key hash.  Documents are taken in
batches of ascending id.  The keys seen so far live in *runs*: Parquet tables
bucketed and sorted by key hash.  A batch's distinct keys are anti-joined
against every run (runs are bucketed, so they are merged without being
shuffled again); what is left is new and becomes a level-0 run.  When
``fan_out`` runs of one level have gathered they are compacted into one run
of the next level, so a key is rewritten only once per level.

A key held by an earlier batch, or by a smaller id of its own batch, makes
all its lines in the later document go.  Hot keys (one line in a third of all
documents) are met by a partial min aggregate and by an anti-join on (key,
document), which spreads them over the documents.

Defined results: null or empty text is one empty line; a null id counts as
one document after all others; rows that share an id are one document for
counting, and each row keeps its own lines; extra columns are untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import LAST_ID, SPACE, lower_ascii, scratch_path, stored

BATCH_BYTES = 256 << 20     # text of one batch, until MAX_BATCHES is reached
MAX_BATCHES = 16            # beyond, batches grow with the input
FAN_OUT = 4                 # runs of a level that are compacted into one


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _batch_bounds(docs: DataFrame, batch_bytes: int, max_batches: int) -> list[int]:
    """Upper ids of all batches but the last, from one aggregate."""
    cuts = [(i + 1) / max_batches for i in range(max_batches - 1)]
    size, ids = docs.agg(F.sum(F.octet_length("__lr_text")),
                         F.percentile_approx("__lr_id", cuts, 10_000) if cuts else F.lit(None)).first()
    wanted, n = (size or 0) / batch_bytes, 1
    while n < wanted and n < max_batches:
        n *= 2
    n = min(n, max_batches)
    return sorted({ids[round(j * max_batches / n) - 1] for j in range(1, n)}) if ids else []


class _Runs:
    """The levelled runs: lists of bucketed tables by level."""

    def __init__(self, spark, fan_out: int):
        self.spark, self.fan_out, self.levels = spark, fan_out, {}
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels.values() for t in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, "k1", "k2").write
             .option("path", scratch_path(self.spark, "line-run"))
             .bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").format("parquet").saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> str:
        name = self._write(keys)
        self.levels.setdefault(0, []).append(name)
        return name

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fan_out:
            full = self.levels.pop(level)
            merged = self.spark.table(full[0]).select("k1", "k2")
            for name in full[1:]:
                merged = merged.unionAll(self.spark.table(name).select("k1", "k2"))
            self.levels.setdefault(level + 1, []).append(self._write(merged))
            level += 1


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                min_chars: int = 10, batch_bytes: int = BATCH_BYTES,
                max_batches: int = MAX_BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """``docs`` with ``text_col`` without its repeated lines, plus ``n_lines``
    and ``n_dropped`` (both long)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("__lr_id"),
                       F.xxhash64(text).alias("__lr_row"), text.alias("__lr_text"))
    bounds = _batch_bounds(base, batch_bytes, max_batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + F.when(F.col("__lr_id") > b, 1).otherwise(0)

    key = F.col("__lr_key")
    lines = (base.select("__lr_id", "__lr_row", F.posexplode(F.split("__lr_text", "\n", -1)).alias("__lr_at", "__lr_line"))
             .select("__lr_id", "__lr_row", "__lr_at", line_key(F.col("__lr_line")).alias("__lr_key"))
             .where(F.char_length(key) >= min_chars)
             .select("__lr_id", "__lr_row", "__lr_at", F.xxhash64(key).alias("k1"),
                     F.xxhash64(F.lit("line"), key).alias("k2"), batch.alias("__lr_batch")))
    lines = stored(lines, "line-keys", partition_by="__lr_batch")

    runs, dropped = _Runs(spark, fan_out), None
    for b in range(len(bounds) + 1):
        here = lines.where(F.col("__lr_batch") == b).drop("__lr_batch")
        first = here.groupBy("k1", "k2").agg(F.min("__lr_id").alias("__lr_id"))
        for run in runs.tables():
            first = first.join(run, ["k1", "k2"], "left_anti")
        new = spark.table(runs.add(first))
        gone = here.join(new, ["k1", "k2", "__lr_id"], "left_anti").select("__lr_id", "__lr_row", "__lr_at")
        gone = stored(gone, "line-dropped") if len(bounds) else gone
        dropped = gone if dropped is None else dropped.unionAll(gone)
        if b < len(bounds):
            runs.compact()

    per_row = (dropped.groupBy("__lr_id", "__lr_row").agg(F.sort_array(F.collect_set("__lr_at")).alias("__lr_gone")))
    full = docs.withColumns({"__lr_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)),
                             "__lr_row": F.xxhash64(text)}).join(per_row, ["__lr_id", "__lr_row"], "left")
    split = full.withColumns({"__lr_lines": F.split(text, "\n", -1),
                              "__lr_gone": F.coalesce("__lr_gone", F.array().cast("array<int>"))})
    # what stays are the stretches between dropped positions
    kept = F.expr("""flatten(transform(sequence(0, size(__lr_gone)), j -> slice(__lr_lines,
                     if(j = 0, 1, element_at(__lr_gone, j) + 2),
                     if(j = size(__lr_gone), size(__lr_lines), element_at(__lr_gone, j + 1))
                       - if(j = 0, 0, element_at(__lr_gone, j) + 1))))""")
    return split.withColumns({
        "n_lines": F.size("__lr_lines").cast("long"), "n_dropped": F.size("__lr_gone").cast("long"),
        text_col: F.when(F.size("__lr_gone") == 0, text).otherwise(F.array_join(kept, "\n")),
    }).drop("__lr_id", "__lr_row", "__lr_lines", "__lr_gone")
