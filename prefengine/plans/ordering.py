"""Total orders and ranks without a single-task sort.

Rows are range-partitioned, the partitions' totals (one number each) come to the driver, and every partition numbers its
own rows from there.  The ranges are cut once by a reliable checkpoint, so the numbering can't shift between readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefengine.plans.lineage import cut

#: Groups up to this size are ranked by a plain window; it is counted first.
GROUP_ROWS = 1_000_000


def running_total(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """df with the sum of the (whole-number) weights up to and including each row."""
    placed = cut(df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum("_weight").alias("n")).collect()}
    starts, run = [], 0
    for p in sorted(totals):
        starts.append((p, run))
        run += totals[p] or 0
    # a row for each partition
    start = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    upto = F.sum("_weight").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(start), "_part").withColumn(name, (upto + F.col("_start")).cast("bigint")).drop("_part", "_weight", "_start")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the 1-based rank in a total order."""
    return running_total(df, order, F.lit(1), name)


def group_rank(df: DataFrame, group: str, order: list[Column], name: str, most: int = GROUP_ROWS) -> DataFrame:
    """df with the 1-based rank within each group; a group of more than ``most`` rows is not sorted in one task."""
    largest = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint"))
    ranked = global_rank(df, [F.col(group), *order], "_rank")
    first = ranked.groupBy(group).agg(F.min("_rank").alias("_first"))
    return (ranked.join(first, ranked[group].eqNullSafe(first[group])).drop(first[group])
            .withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first"))
