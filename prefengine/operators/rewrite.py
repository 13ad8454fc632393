"""Gating, overlaying and summarising model rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.text import strip, strip_thinking


def rewrite_reason(new: Column, old: Column, terms: tuple[str, ...], patterns: tuple[str, ...], least: int = 8) -> Column:
    """Why a rewrite is refused, or null: empty, unchanged, short, or it brings in terms or patterns that were not there."""
    text = strip_thinking(strip(F.coalesce(new, F.lit(""))))
    was = F.coalesce(old, F.lit(""))
    added = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t) & ~F.contains(was, t)) if terms else F.lit(False)
    brought = F.lit(False)
    for p in patterns:
        brought = brought | (text.rlike(p) & ~was.rlike(p))
    return (F.when(text == "", "empty").when(text == strip(was), "unchanged").when(F.length(text) < least, "too_short")
            .when(added, "adds_terms").when(brought, "adds_patterns"))


def overlaid(rows: DataFrame, cache: DataFrame, record: str, column: str, rewritten: str, keep: list[str]) -> DataFrame:
    """rows with ``column`` replaced where the cache has a rewrite; ``rewrite`` tells what was replaced and by what."""
    c = cache.select(F.col(record), F.col(rewritten).alias("_new"), F.struct(*keep).alias("_info")).filter(F.coalesce(F.col("_new"), F.lit("")) != "")
    joined = rows.join(c, record, "left")
    info = F.when(F.col("_new").isNotNull(), F.struct(F.col(column).alias("original"), F.col("_info").alias("by")))
    return joined.withColumn("rewrite", info).withColumn(column, F.coalesce("_new", column)).drop("_new", "_info")


def length_ratio(original: Column, rewritten: Column) -> Column:
    """How much longer a rewrite is; null where the original is empty."""
    return F.when(original != 0, rewritten / original)
