"""Schemas of the records and the check that a table has what an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """'name type, ...' with the simple types below, which needs no running session."""
    simple = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, simple[k]) for n, k in (x.split() for x in ddl.split(","))])


MESSAGE = _struct("role string, content string")
MESSAGES = T.ArrayType(MESSAGE)
TURNS = T.ArrayType(_struct("from string, value string"))
SCORE = _struct("index int, hallucination int, accuracy int, closure int, auto_resolve int, satisfaction int, overall_score double, rationale string")

RAW_QA = _struct("row_idx bigint, question_raw string, answer_raw string")
SAMPLE = _struct("idx bigint, question_raw string, answer_raw string, question_clean string, answer_clean string, question_norm string, answer_norm string")
CONVERSATION = T.StructType([T.StructField("id", T.StringType()), T.StructField("conversations", TURNS)])
EDGE = _struct("src bigint, dst bigint, score double")
CLUSTER = _struct("idx bigint, cluster_id bigint")
CANDIDATE = _struct("index int, temperature double, top_p double, content string")
CANDIDATE_SET = T.StructType([T.StructField("id", T.StringType()), T.StructField("prompt", MESSAGES), T.StructField("candidates", T.ArrayType(CANDIDATE))])
RANKED = T.StructType([T.StructField("id", T.StringType()), T.StructField("scores", T.ArrayType(SCORE))])
PAIR = T.StructType([T.StructField("id", T.StringType()), *(T.StructField(n, MESSAGES) for n in ("prompt", "chosen", "rejected")), T.StructField("reference", T.StringType())])
REWRITE = _struct("id string, model string, original_chosen string, rewritten_chosen string, rationale string, original_length int, rewritten_length int")
JUDGEMENT = _struct("sample_index bigint, accuracy int, auto_resolve int, closure int, satisfaction int, judge_model string, rationale string")
AUDIT = _struct("stage string, reason string, record string, payload string")
RUN = _struct("run string, beta double, step bigint, metric double, checkpoint string")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df itself, or an error that names what it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(lacking)}; it has {', '.join(df.columns)}")
    return df
