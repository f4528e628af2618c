"""The named queries of the training-data operators: name -> (query, SQL that must agree or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from buildlens.llm import chat, embeddings, html_text, leaks, near_dup, negatives, packing, pii, quality, rules, substrings, toxicity, whitening
from buildlens.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, from records of two layouts: rows by turn, and one record with its messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    said = '"</s>[INST] ok [/INST]"'
    record = f'{{"messages": [{{"role": "user", "content": {said}}}, {{"role": "assistant", "content": {said}}}]}}'
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.parse_json(F.lit(record)).alias("record"))
    return chat.digest(chat.chats(rows.unionByName(one), "conv_id", "record"))


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '&((amp|lt|lsqb|nl);)', '&amp;\1', 'g'),
      '<(\||/|<|s>|\w+\|>)', '&lt;\1', 'g'), '\[(/?[A-Z_]+\])', '&lsqb;\1', 'g') AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 17)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    return substrings.digest(substrings.removed(table(spark, sf_dir, "documents")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of the quality rules for every document."""
    return rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
runs AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM runs) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len([x FOR x IN w IF list_contains({stop_words}, trim(lower(x), '.,;:!?"''()'))]) AS n_stop_words
  FROM docs LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 10 * n_symbols <= 2 * n_words
    AND 100 * n_stop_words >= 6 * n_words AND 2 * n_dup_lines <= n_lines AND 2 * n_words >= 3 * n_lines AS kept
FROM judged
""".replace("{stop_words}", "[" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + "]")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened coordinates of every vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(rows, "embedding").select(
        "vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor, one in a hundred vectors, for each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


QUERIES = {
    "op1_minhash_near_dedup": (op1_minhash_near_dedup, None),
    "op2_chat_formatting": (op2_chat_formatting, OP2_SQL),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, None),
    "op6_html_extraction": (op6_html_extraction, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_embedding_near_dedup": (op8_embedding_near_dedup, None),
    "op9_best_fit_packing": (op9_best_fit_packing, None),
    "op10_substring_dedup": (op10_substring_dedup, None),
    "op11_quality_rules": (op11_quality_rules, OP11_SQL),
    "op12_embedding_whitening": (op12_embedding_whitening, None),
    "op13_hard_negative_mining": (op13_hard_negative_mining, OP13_SQL),
}
