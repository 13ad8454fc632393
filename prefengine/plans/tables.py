"""The record tables as the core queries read them, in Spark and in SQL: a record loaded twice is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa_loaded(spark: SparkSession, d: str) -> DataFrame:
    """(idx, question, answer) of the cleaned rows as loaded, some of them twice; nulls as ''."""
    t = read(spark, d, "sample_clean")
    return t.select("idx", F.coalesce("question_clean", F.lit("")).alias("question"), F.coalesce("answer_clean", F.lit("")).alias("answer"))


def qa(spark: SparkSession, d: str) -> DataFrame:
    """(idx, question, answer) of the cleaned rows, nulls as ''."""
    return qa_loaded(spark, d).distinct()


QA = "(SELECT DISTINCT idx, coalesce(question_clean, '') AS question, coalesce(answer_clean, '') AS answer FROM sample_clean)"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """(id, messages, cluster_id, question_type, source, source_ids) of the training records."""
    from prefengine.operators.records import to_messages

    t = read(spark, d, "sft_train").select("id", to_messages(F.col("conversations")).alias("messages"), F.col("metadata.cluster_id").alias("cluster_id"),
                                           F.col("metadata.question_type").alias("question_type"), "source", F.col("metadata.source_ids").alias("source_ids"))
    return t.dropDuplicates(["id"])


_ROLE = "CASE WHEN x.\"from\" IN ('human', 'user') THEN 'user' WHEN x.\"from\" IN ('gpt', 'assistant') THEN 'assistant' ELSE x.\"from\" END"
CONVERSATIONS = f"""(SELECT id, any_value(list_transform(conversations, lambda x: {{'role': {_ROLE}, 'content': x.value}})) AS messages,
  any_value(metadata.cluster_id) AS cluster_id, any_value(metadata.question_type) AS question_type, any_value(source) AS source,
  any_value(metadata.source_ids) AS source_ids FROM sft_train GROUP BY id)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """(id, cluster_id, question, answer, norm, answer_norm): first question and answer of each training record."""
    from prefengine.functions.text import squeezed
    from prefengine.operators.records import first_turn

    t = conversations(spark, d).filter("cluster_id is not null")
    t = t.select("id", "cluster_id", "source_ids", first_turn(F.col("messages"), "user").alias("question"), first_turn(F.col("messages"), "assistant").alias("answer"))
    return t.filter("question != '' and answer != ''").withColumns({"norm": squeezed(F.col("question")), "answer_norm": squeezed(F.col("answer"))})


_SP = "\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def squeezed_sql(c: str) -> str:
    edge = f"[{_SP},，.。!！?？~～:：;；、/\\\\|]"
    return (f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^{edge}+|{edge}+$', '', 'g'), '[{_SP}]+', '', 'g'), "
            "'[，,。.!！?？:：;；、/\\\\|()\\[\\]{}\"''`~\\-]+', '', 'g')")


def core_sql(c: str) -> str:
    edge = f"[{_SP},，.。!！?？~～:：;；、/\\\\|]"
    return f"regexp_replace({c}, '^{edge}+|{edge}+$', '', 'g')"


CLUSTERED = f"""(SELECT id, cluster_id, source_ids, question, answer, {squeezed_sql('question')} AS norm, {squeezed_sql('answer')} AS answer_norm FROM (
  SELECT id, cluster_id, source_ids, coalesce(list_filter(messages, lambda m: m.role = 'user')[1].content, '') AS question,
    coalesce(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '') AS answer FROM {CONVERSATIONS} WHERE cluster_id IS NOT NULL)
  WHERE question <> '' AND answer <> '')"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, chosen, rejected, reference, delta, chosen_index, rejected_index, question, question_type)."""
    from prefengine.operators.preference import last_content

    t = read(spark, d, "dpo_pairs")
    return t.select("id", last_content(F.col("prompt")).alias("question"), last_content(F.col("chosen")).alias("chosen"), last_content(F.col("rejected")).alias("rejected"),
                    "reference", F.col("metadata.score_delta").alias("delta"), F.col("metadata.chosen_index").alias("chosen_index"),
                    F.col("metadata.rejected_index").alias("rejected_index"), F.col("metadata.question_type").alias("question_type")).dropDuplicates(["id"])


PAIRS = """(SELECT id, any_value(prompt[-1].content) AS question, any_value(chosen[-1].content) AS chosen, any_value(rejected[-1].content) AS rejected,
  any_value(reference) AS reference, any_value(metadata.score_delta) AS delta, any_value(metadata.chosen_index) AS chosen_index,
  any_value(metadata.rejected_index) AS rejected_index, any_value(metadata.question_type) AS question_type FROM dpo_pairs GROUP BY id)"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "ranked").select("id", "scores", "rank_model").dropDuplicates(["id"])


RANKED = "(SELECT id, any_value(scores) AS scores, any_value(rank_model) AS rank_model FROM ranked GROUP BY id)"
#: One row for each score of a set in which every score is complete.
SCORES = f"""(SELECT id, rank_model, unnest(scores) AS s FROM {RANKED})"""
COMPLETE = """(s IS NOT NULL AND s."index" IS NOT NULL AND s.hallucination IN (0, 1) AND s.accuracy IN (0, 1) AND s.closure IN (0, 1) AND s.auto_resolve IN (0, 1)
  AND s.satisfaction BETWEEN 1 AND 5 AND s.overall_score BETWEEN 0 AND 100 AND NOT isnan(s.overall_score))"""
ALIGNED = """(CASE WHEN s.hallucination = 1 THEN -100.0::DOUBLE ELSE round(s.accuracy * 40.0::DOUBLE + s.closure * 25.0::DOUBLE + s.auto_resolve * 20.0::DOUBLE
  + s.satisfaction * 3.0::DOUBLE + s.overall_score * 0.02::DOUBLE, 4) END)"""
