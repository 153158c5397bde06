"""The queries of this subpackage and, where SQL can express them, their
DuckDB texts.  Each query reads whole tables through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import ann_tiles, fill_middle, kn_quality, line_runs, merkle, mixing, ngram_jaccard, nn_descent, piece_nbest, suffix_dedup, token_lengths, warc_zip, wrapper_html
from tidemark.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tiles.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"),
                             lambda vec_id: vec_id % 50 == 0, k=5)


SQL["op5_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.select_mix(docs).select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source",
        F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_budget").alias("leaf_budget"))


def _case(column: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {column} {whens} ELSE {mixing.DEFAULT_WEIGHT} END" if whens else str(mixing.DEFAULT_WEIGHT)


def _level_sql(level: int) -> str:
    """Water-filling of one tree level."""
    names = ["domain", "language", "src"]
    keys, name = names[:level], names[level]
    weights = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS)[level]
    cols = ", ".join(names[:level + 1])
    over = f"PARTITION BY {', '.join(keys)}" if keys else ""
    on = " AND ".join(f"n.{k} = p.{k}" for k in keys) or "TRUE"
    return f"""
n{level} AS (
  SELECT {cols}, sum(tokens) * {mixing.MAX_EPOCHS} AS cap, {_case(name, weights)} AS w
  FROM leaf GROUP BY {cols}
), o{level} AS (
  SELECT n.*, p.budget AS have,
         p.budget - coalesce(sum(n.cap) OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(n.w) OVER (ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
         row_number() OVER ord AS pos
  FROM n{level} n JOIN b{level} p ON {on}
  WINDOW ord AS ({over.replace('BY ', 'BY n.').replace(', ', ', n.')} ORDER BY CAST(n.cap AS DOUBLE) / n.w, n.{name})
), f{level} AS (
  SELECT *, min(pos) FILTER (WHERE cap * ws > rest * w) OVER ({over}) AS stop FROM o{level}
), g{level} AS (
  SELECT *, max(rest) FILTER (WHERE pos = stop) OVER ({over}) AS open,
         max(ws) FILTER (WHERE pos = stop) OVER ({over}) AS open_w FROM f{level}
), h{level} AS (
  SELECT *, CASE WHEN stop IS NULL OR pos < stop THEN cap ELSE (open * w) // open_w END AS share FROM g{level}
), b{level + 1} AS (
  SELECT {cols}, share + CASE WHEN stop IS NOT NULL AND pos >= stop AND pos - stop <
           open - sum(share) FILTER (WHERE pos >= stop) OVER ({over}) THEN 1 ELSE 0 END AS budget
  FROM h{level}
)"""


SQL["op7_mix_sources"] = f"""
WITH d AS (
  SELECT doc_id, lang, source, text,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
              ELSE 'group' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) END AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, language, src, sum(n_tokens) AS tokens FROM d GROUP BY ALL
), b0 AS (
  SELECT least(sum(tokens) * {mixing.BUDGET[0]} // {mixing.BUDGET[1]}, sum(tokens) * {mixing.MAX_EPOCHS}) AS budget
  FROM leaf
), {_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
p AS (
  SELECT domain, language, src, budget, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole,
         CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest
  FROM leaf JOIN b3 USING (domain, language, src)
), e AS (
  SELECT d.*, budget, whole, rest,
         md5('{mixing.SEED}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM d JOIN p USING (domain, language, src)
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, src ORDER BY place, md5(text)
                                ROWS UNBOUNDED PRECEDING) AS run FROM e
), t AS (
  SELECT *, unnest(range(1, CAST(whole + CASE WHEN rest > 0 AND run <= rest THEN 2 ELSE 1 END AS BIGINT))) AS epoch FROM c
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens,
       CAST(budget AS BIGINT) AS leaf_budget FROM t"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_runs.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op9_line_dedup"] = """
WITH t AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""


@query
def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


SQL["op4_warc_archives"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM h"""


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_html.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return kn_quality.classify(docs, labels).select("doc_id", "lang", "perplexity", "threshold", "kept")


@query
def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = piece_nbest.decode(piece_nbest.encode(docs))
    return coded.select(
        "doc_id", "ids", F.size("ids").alias("n_pieces"), "nbest",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL["op13_fill_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS k FROM d
), c AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, least(k[1] % (len(lines) + 1), k[2] % (len(lines) + 1)) AS a,
         greatest(k[1] % (len(lines) + 1), k[2] % (len(lines) + 1)) AS b FROM u
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 100
              THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))\
        .select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    tampered = {"text": merkle.without_line_ends(F.col("text"), F.col("doc_id"))}
    return merkle.manifest(docs, tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SQL["op11_merkle_manifest"] = """
WITH RECURSIVE crc_table AS (
  SELECT CAST(b AS BIGINT) AS b, list_reduce([CAST(b AS BIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(b)
), crc(doc_id, s, i, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, i + 1, xor(c // 256, v) FROM crc JOIN crc_table ON b = xor(c % 256, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT))
  WHERE i < length(s)
), changed AS (
  SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % 2 = 0
), d AS (
  SELECT *, CASE WHEN doc_id IN (FROM changed) THEN replace(text, chr(10), '') ELSE text END AS claim FROM documents
), f AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS front,
         coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(claim) || ':' || claim, '-') AS told FROM d
), leaf AS (
  SELECT r, doc_id, source, sha256(front || own) AS h, sha256(front || told) AS told FROM f
), tree AS (
  SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)
), placed AS (
  SELECT r, doc_id, tree, h, told, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos
  FROM leaf JOIN tree ON leaf.source IS NOT DISTINCT FROM tree.source
), up(level, tree, pos, h, n) AS (
  SELECT 0, tree, pos, h, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM up WHERE n > 1 GROUP BY level, tree, pos // 3
), subroot AS (
  SELECT tree, h, level FROM up WHERE n = 1
), over(level, pos, h, n) AS (
  SELECT 0, tree, h, count(*) OVER () FROM subroot
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM over WHERE n > 1 GROUP BY level, pos // 3
), nodes AS (
  SELECT 0 AS tier, level, tree, pos, h FROM up WHERE n > 1
  UNION ALL SELECT 1, level, 0, pos, h FROM over WHERE n > 1
), runs AS (
  SELECT a.tier, a.level, a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS rt
  FROM nodes a JOIN nodes b ON a.tier = b.tier AND a.level = b.level AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 GROUP BY ALL
), fold(r, tier, level, tree, pos, got, proof) AS (
  SELECT r, 0, 0, tree, pos, told, '' FROM placed
  UNION ALL
  SELECT r, CASE WHEN u.l IS NULL THEN 1 ELSE f.tier END, CASE WHEN u.l IS NULL THEN 0 ELSE f.level + 1 END,
         CASE WHEN u.l IS NULL THEN 0 ELSE f.tree END, CASE WHEN u.l IS NULL THEN f.tree ELSE f.pos // 3 END,
         CASE WHEN u.l IS NULL THEN got ELSE sha256(u.l || got || u.rt) END, proof || coalesce(u.l || u.rt, '')
  FROM fold f LEFT JOIN runs u ON f.tier = u.tier AND f.level = u.level AND f.tree = u.tree AND f.pos = u.pos
  WHERE u.l IS NOT NULL OR f.tier = 0
), ends AS (
  SELECT r, arg_max(got, tier * 1000 + level) AS got, arg_max(proof, tier * 1000 + level) AS proof FROM fold GROUP BY r
)
SELECT doc_id, p.h AS leaf, s.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, got AS folded_root, got = o.h AS verified
FROM placed p JOIN ends USING (r) JOIN subroot s ON p.tree = s.tree CROSS JOIN (SELECT h FROM over WHERE n = 1) o"""
