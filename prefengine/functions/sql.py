"""The text functions under SQL names.

register(spark) adds composed(text), clean_text(text), norm_text(text), seq_ratio(a, b), parse_llm_json(text) and the table
function char_ngrams(text, lo, hi).  The SQL functions are made from the very Column expressions that DataFrames use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from prefengine.functions import text
from prefengine.operators.dedup import sequence_ratio


class CharNgrams:
    """Every run of lo to hi characters with its 1-based start."""

    def eval(self, text: str, lo: int, hi: int):
        for n in range(lo, hi + 1):
            for i in range(len(text or "") - n + 1):
                yield i + 1, text[i:i + n]


def expression_sql(spark: SparkSession, build: Callable[[Column], Column]) -> str:
    """SQL text of a Column expression over one string column x."""
    df = spark.createDataFrame([], "x string").select(build(F.col("x")).alias("out"))
    return df._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    spark.udf.register("composed", text.composed)
    spark.udf.register("seq_ratio", sequence_ratio)
    spark.udtf.register("char_ngrams", udtf(CharNgrams, returnType="start int, gram string"))
    for name, kind, build in (("clean_text", "STRING", text.clean_text), ("norm_text", "STRING", text.squeezed), ("parse_llm_json", "VARIANT", text.lenient_json)):
        body = expression_sql(spark, build)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
