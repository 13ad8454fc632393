"""Splits, samples and quotas by hash order: seeded, exact in size, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.plans.ordering import global_rank, group_rank


def shuffled(record: Column, seed: int) -> Column:
    """A seeded order: the SHA-256 of 'seed:record', which any other engine can compute, too."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), record.cast("string")), 256)


def split(df: DataFrame, record: str, ratio: float, seed: int, rounding: str = "floor", least: int = 1) -> DataFrame:
    """df with ``split``: exactly floor (or ceil) of n * ratio rows, at least ``least``, are 'val'."""
    n = df.count()
    size = -int(-n * ratio // 1) if rounding == "ceil" else int(n * ratio)
    size = min(n, max(least, size)) if n else 0
    ranked = global_rank(df.withColumn("_h", shuffled(F.col(record), seed)), [F.col("_h"), F.col(record)], "_at")
    return ranked.withColumn("split", F.when(F.col("_at") <= size, "val").otherwise("train")).drop("_h", "_at")


def sample(df: DataFrame, record: str, n: int, seed: int) -> DataFrame:
    """n rows (all, if n is not positive) in seeded order: a top-k, not a sort."""
    return df if n <= 0 else df.orderBy(shuffled(F.col(record), seed), record).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows by an order; a negative n gives none, None all."""
    return df if n is None else df.orderBy(*order).limit(max(0, n))


def _round_of(df: DataFrame, record: str, cluster: str, seed: int) -> DataFrame:
    h = shuffled(F.col(record), seed)
    return group_rank(df.withColumn("_h", h), cluster, [F.col("_h"), F.col(record)], "_round").drop("_h")


def coverage_sample(df: DataFrame, record: str, cluster: str, ratio: float, seed: int) -> DataFrame:
    """round(n * ratio) rows, one of every cluster before a second of any."""
    n = df.count()
    budget = min(n, round(n * ratio))
    order = [F.col("_round"), shuffled(F.col(cluster), seed + 1), F.col(record)]
    return _round_of(df, record, cluster, seed).orderBy(*order).limit(budget).drop("_round")


def cluster_sample(df: DataFrame, record: str, cluster: str, ratio: float, least: int, seed: int) -> DataFrame:
    """Of each cluster round(n * ratio) rows (half to even), at least ``least``, at most all."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    quota = F.least(F.col("_n"), F.greatest(F.lit(least), F.bround(F.col("_n") * F.lit(ratio)).cast("bigint")))
    return _round_of(df.join(sizes, cluster), record, cluster, seed).filter(F.col("_round") <= quota).drop("_round", "_n")
