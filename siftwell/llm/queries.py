"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import ann, bpe, langid, lm, packing, puquality, rules, sharding, simhash, suffixdedup
from siftwell.llm.common import table

TOKENIZER = "word_bpe_49k.json"
SHARDS = 40


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_nearest_neighbours, op4_packing, op5_bpe, op6_lm_scores, op7_quality_rules, op8_quality_classifier, op9_sharding, op10_suffix_dedup)}


def _rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
    tests = []
    for t in rules.THRESHOLDS:
        bounds = [f"{t.measure} >= {t.low}"] * (t.low is not None) + [f"{t.measure} <= {t.high}"] * (t.high is not None)
        tests.append(f"(n_words < {t.words} OR ({' AND '.join(bounds)}))")
    k = rules.WINDOW_WORDS
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {k - 2})) AS u(i)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, {k})) AS v(j) GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) AS n_shouts,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cover c USING (doc_id)),
    r AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word,
        n_shouts / greatest(n_words, 1)::DOUBLE AS shouts_per_word, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
        n_stop / greatest(n_words, 1)::DOUBLE AS stop_word_ratio,
        n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND {' AND '.join(tests)} AS kept FROM r"""


ORACLES = {"op7_quality_rules": _rules_sql()}
