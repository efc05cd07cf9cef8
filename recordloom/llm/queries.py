"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import chat, context_tree, frames, lexicon, packing, quality_model, rule_list, sharding, shingle_join, weighted_print
from recordloom.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_print.fingerprints(table(spark, sf_dir, "documents"))


def op6_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.token_files(table(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.components(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    return chat.format_and_read(turns.unionByName(control))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


#: Sets of words' shingles, links between different sets, and the least doc_id that links reach.
SHINGLE_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, s FROM sets WHERE len(s) > 0 GROUP BY s),
entries AS (SELECT rep, len(s) AS n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (SELECT rep, rep AS other FROM classes UNION SELECT r.rep, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT rep, min(other) AS component_id FROM reached GROUP BY rep)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN least l ON l.rep = c.rep"""


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express: trained models, tokenizers and checksums are tested against brute force instead."""
    return {"op9_shingle_join": SHINGLE_JOIN_SQL}
