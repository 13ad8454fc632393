"""Append-only caches: typed rows, last write wins, rows of the wrong shape are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from prefengine.operators.external import latest


def append(df: DataFrame, path: str, key: str) -> None:
    """Adds rows with the time of writing, which decides which row of a key is the last."""
    df.withColumn("cache_key", F.col(key).cast("string")).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, schema: T.StructType, needed: list[str]) -> DataFrame:
    """The last row of each key that has all the needed values; a missing cache is empty."""
    full = T.StructType([*schema.fields, T.StructField("cache_key", T.StringType()), T.StructField("written_at", T.TimestampType())])
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], full)
    for c in ["cache_key", *needed]:
        rows = rows.filter(F.col(c).isNotNull())
    return latest(rows, "cache_key", "written_at")
