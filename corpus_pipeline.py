"""From raw documents to piece ids in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``docs``.

1. quality   documents that the Kneser-Ney classifier rejects go (op 6)
2. lines     lines that an earlier document has go; so does a document that
             loses its whole text that way (op 9)
3. copies    of every group of near copies the document with the smallest id
             stays (op 2)
4. mix       documents are taken to target weights, once per epoch (op 7)
5. pieces    N-best SentencePiece encoding (op 8)

Nulls in any column, empty texts, repeated rows and ids, empty tables and
further columns, whatever their names, pass through; each operator's
docstring says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import kn_quality, line_runs, mixing, ngram_jaccard, piece_nbest
from tidemark.llm.common import SPACE, stored, table

BROADCAST_IDS = 1_000_000
COPY_WORDS, COPY_PERCENT = 5, 80        # of the copies stage; op2 has its own


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside a struct of all others, which no operator's
    column can clash with."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, *names: str, **new: Column) -> DataFrame:
    return rows.select(*[
        (new[c] if c in new else F.col(c) if c in names else F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    judged = kn_quality.classify(_packed(docs, "doc_id", "text", "lang"), labels)
    return _unpacked(judged.where("kept"), docs, "doc_id", "text", "lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_runs.dedup_lines(_packed(docs, "doc_id", "text"))
    left = left.where((F.col("n_dropped") == 0) | (F.btrim(F.col("text"), F.lit(SPACE)) != ""))
    size = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _unpacked(left, docs, "doc_id", "text", **size)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    plain = rows == ids
    if plain:
        keyed, key = docs, F.col("doc_id")
    else:       # ids that are null or repeat: rows are told apart by a hash of id and text,
                # and of rows equal in both the first by its other columns stays
        key = F.xxhash64("doc_id", "text")
        has_text = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE)) != ""
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = docs.where(has_text).groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("__first"))
        keyed = first.select(*[F.col(f"__first.`{c}`") for c in docs.columns]).unionByName(docs.where(~has_text))
    found = ngram_jaccard.jaccard_components(keyed.select(key.alias("doc_id"), "text"), words=COPY_WORDS, percent=COPY_PERCENT)
    if plain:
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    else:       # a group's first by id, null last, then by the hash
        found = stored(found.select(F.col("doc_id").alias("k"), "component_id"), "copies-found")
        groups = found.where("k <> component_id").select("component_id").distinct()
        own = keyed.select(key.alias("k"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("k")).alias("place"))
        members = found.join(groups, "component_id", "left_semi").join(own, "k")
        first = members.groupBy("component_id").agg(F.min("place").alias("first"))
        gone = members.join(first, "component_id").where("k <> first.k").select(F.col("k").alias("__gone"))
    gone = stored(gone.distinct(), "copies-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return keyed.join(gone, key.eqNullSafe(F.col("__gone")), "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.select_mix(_packed(docs, "doc_id", "text", "lang", "source"))
    return _unpacked(taken, docs, "doc_id", "text", "lang", "source")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_nbest.encode(docs, keep=["doc_id", "lang", "source"])
    return coded.withColumn("n_pieces", F.size("ids"))


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("mix", mix), ("pieces", pieces)]

# Two stages hold a trained model and a lattice search; brute-force versions
# in tests/llm stand in for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
