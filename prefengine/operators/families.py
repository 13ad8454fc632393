"""Answers of one question cluster: canonical question, families of alike answers, contradictions, selection, emission."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from prefengine.functions.rules import ZH_SHOP, RulePack, answer_quality, ranges_overlap, stance, time_ranges
from prefengine.functions.text import contains_any
from prefengine.plans.ordering import group_rank


def canonical_questions(rows: DataFrame, cluster: str, record: str, question: str, norm: str) -> DataFrame:
    """(cluster, record, question, norm) of each cluster: most frequent wording, then nearest to 12 characters, longer, first."""
    counts = rows.groupBy(cluster, norm).agg(F.count("*").alias("n"))
    order = F.struct(F.col("n"), -F.abs(F.length(question) - 12), F.length(question), -F.col(record))
    best = F.max_by(F.struct(record, question, norm), order)
    return rows.join(counts, [cluster, norm]).groupBy(cluster).agg(best.alias("b")).select(cluster, "b.*")


def scored_answers(rows: DataFrame, answer: str, kind: str, pack: RulePack = ZH_SHOP) -> DataFrame:
    return rows.withColumns({"stance": stance(F.col(answer), pack), "quality": answer_quality(F.col(answer), F.col(kind), pack)})


def merged_families(rows: DataFrame, cluster: str, record: str, answer: str, norm: str, threshold: float = 0.82) -> DataFrame:
    """rows with ``family``: longest answers first, each joins the first family of its stance whose founder it resembles.

    Order matters, so a cluster is scanned in one place; ``split_paths`` keeps the clusters that come here below a
    stated size.  ``rows`` needs ``stance``.
    """
    kind = StructType([*rows.schema.fields, StructField("family", IntegerType())])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_n=-group[answer].str.len()).sort_values(["_n", record], kind="stable").drop(columns="_n")
        founders: list[tuple[str, str]] = []
        family = []
        for text, view in zip(group[norm], group["stance"], strict=True):
            for i, (founder, theirs) in enumerate(founders):
                if view != theirs and theirs != "unknown":
                    continue
                if 2 * min(len(text), len(founder)) / max(len(text) + len(founder), 1) < threshold:
                    continue
                if SequenceMatcher(None, text, founder).ratio() >= threshold:
                    family.append(i)
                    break
            else:
                family.append(len(founders))
                founders.append((text, view))
        return group.assign(family=family)

    return rows.groupBy(cluster).applyInPandas(scan, kind)


def singleton_families(rows: DataFrame, cluster: str, record: str) -> DataFrame:
    """One family for each row, numbered by position."""
    return group_rank(rows, cluster, [F.col(record)], "_at").withColumn("family", (F.col("_at") - 1).cast("int")).drop("_at")


def split_paths(rows: DataFrame, cluster: str, kind: str, apart: list[str], large: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, rows to keep apart): large clusters and the types in ``apart`` are not merged."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("_size"))
    marked = rows.join(sizes, cluster).withColumn("_apart", F.col(kind).isin(*apart) | (F.col("_size") >= large))
    return (marked.filter(~F.col("_apart")).drop("_size", "_apart"), marked.filter("_apart").drop("_size", "_apart"))


def family_table(rows: DataFrame, cluster: str, record: str, answer: str, bonus: bool = True) -> DataFrame:
    """A row for each family: its best answer, support and score (with a bonus that grows with the support)."""
    best = F.max_by(F.struct(F.col(record).alias("rep"), F.col(answer).alias("rep_answer"), "stance", "quality"),
                    F.struct(F.col("quality"), F.length(answer), -F.col(record)))
    out = rows.groupBy(cluster, "family").agg(best.alias("b"), F.count("*").alias("support"))
    score = F.col("b.quality") + (F.log2(F.col("support") + 1) * 0.35 if bonus else F.lit(0.0))
    return out.select(cluster, "family", "b.rep", "b.rep_answer", "b.stance", "support", score.alias("score"),
                      time_ranges(F.col("b.rep_answer")).alias("ranges"))


def ranked_families(families: DataFrame, cluster: str) -> DataFrame:
    """families with ``rank``: support, score, length of the answer, then the family's number."""
    order = W.partitionBy(cluster).orderBy(F.desc("support"), F.desc("score"), F.desc(F.length("rep_answer")), "family")
    return families.withColumn("rank", F.row_number().over(order))


def contradictions(ranked: DataFrame, cluster: str, kind: str, timed: list[str], policy: list[str], pack: RulePack = ZH_SHOP) -> DataFrame:
    """ranked with ``contradiction``: why a family contradicts the dominant one, or null.

    A dominant family of support 1 rules nothing out.
    """
    first = ranked.filter("rank = 1").select(cluster, F.struct("support", "stance", "ranges", "rep_answer").alias("top"))
    both = ranked.join(first, cluster)
    opposite = F.col("stance").isin("positive", "negative") & F.col("top.stance").isin("positive", "negative") & (F.col("stance") != F.col("top.stance"))
    firm = ~contains_any(F.col("rep_answer"), pack.conditional) & ~contains_any(F.col("top.rep_answer"), pack.conditional)
    apart = (F.size("ranges") > 0) & (F.size("top.ranges") > 0) & ~ranges_overlap(F.col("ranges"), F.col("top.ranges"))
    reason = (F.when((F.col("rank") == 1) | (F.col("top.support") < 2), F.lit(None))
              .when(F.col(kind).isin(*timed) & apart, F.lit("non_overlapping_time_ranges"))
              .when(F.col(kind).isin(*policy) & opposite & firm, F.concat(F.lit("policy_conflict:"), F.col("top.stance"), F.lit("->"), F.col("stance"))))
    return both.withColumn("contradiction", reason).drop("top")


def consolidated(families: DataFrame, cluster: str, kind: str, texts: DataFrame) -> DataFrame:
    """One family per cluster with the text that ``texts`` (kind, text) has for its type: supports added, best score raised."""
    merged = families.groupBy(cluster, kind).agg(F.sum("support").alias("support"), F.max("score").alias("best"), F.min("rep").alias("rep"))
    return (merged.join(F.broadcast(texts), kind)  # one row for each question type
            .select(cluster, kind, F.lit(0).alias("family"), "rep", F.col("text").alias("rep_answer"), "support",
                    (F.col("best") + F.log2(F.col("support") + 1) * 0.2).alias("score"),
                    F.when(contains_any(F.col("text"), ZH_SHOP.conditional), "conditional").otherwise("unknown").alias("stance"),
                    time_ranges(F.col("text")).alias("ranges")))


def hour_window(ranges: Column, upper: float = 0.85) -> Column:
    """(lo, hi) of many spans: the 15 % quantile of positive lows and the given one of positive highs, between hours."""
    upper = min(1.0, max(0.5, upper))
    low = F.filter(F.transform(ranges, lambda r: r["lo"]), lambda x: x > 0)
    high = F.filter(F.transform(ranges, lambda r: r["hi"]), lambda x: x > 0)

    def quantile(values: Column, p: float) -> Column:
        ordered = F.array_sort(values)
        at = F.greatest(F.size(values) - 1, F.lit(0)) * F.lit(p)
        below = F.try_element_at(ordered, (F.floor(at) + 1).cast("int"))
        above = F.try_element_at(ordered, (F.ceil(at) + 1).cast("int"))
        return F.when(F.size(values) > 0, below + (above - below) * (at - F.floor(at)))

    return F.struct(quantile(low, 0.15).alias("lo"), quantile(high, upper).alias("hi"))


def rounded_hours(hours: Column, up: bool) -> Column:
    """Whole hours, from a day on whole days; at least one unit, nothing below zero."""
    unit = F.when(hours >= 24, 24.0).otherwise(1.0)
    count = F.ceil(hours / unit) if up else F.greatest(F.lit(1), F.floor(hours / unit))
    return F.when(hours <= 0, 0.0).otherwise((count * unit).cast("double"))


def top_families(ranked: DataFrame, cluster: str, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, cut off) of the families without a contradiction, re-ranked."""
    order = W.partitionBy(cluster).orderBy(F.desc("support"), F.desc("score"), "family")
    again = ranked.filter("contradiction is null").withColumn("place", F.row_number().over(order))
    return again.filter(F.col("place") <= n), again.filter(F.col("place") > n)


def question_variants(members: DataFrame, cluster: str, record: str, question: str, norm: str, canonical: DataFrame, limit: int = 4) -> DataFrame:
    """Rows (cluster, family, place, record, question): the canonical wording first, then the shortest other wordings."""
    one = members.groupBy(cluster, "family", norm).agg(F.min_by(F.struct(record, question), F.struct(F.length(question), F.col(record))).alias("m"))
    own = canonical.select(cluster, F.col(norm).alias("_norm"), F.struct(record, question).alias("_canonical"))
    families = members.select(cluster, "family").distinct().join(own, cluster)
    others = (one.join(own, cluster).filter(F.col(norm) != F.col("_norm"))
              .select(cluster, "family", F.lit(1).alias("late"), F.col("m").alias("v")))
    every = families.select(cluster, "family", F.lit(0).alias("late"), F.col("_canonical").alias("v")).unionByName(others)
    order = W.partitionBy(cluster, "family").orderBy("late", F.length(F.col(f"v.{question}")), F.col(f"v.{record}"))
    return (every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(1, limit))
            .select(cluster, "family", "place", f"v.{record}", f"v.{question}"))


def first_ids(members: DataFrame, keys: list[str], record: str, order: list[Column], n: int = 20) -> DataFrame:
    """(keys, ids): the first n ids of each group; the group is cut before it is collected."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    few = members.withColumn("_at", at).filter(F.col("_at") <= n)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_at", record))), lambda x: x[record])
    return few.groupBy(*keys).agg(ids.alias("ids"))


def records_of(variants: DataFrame, families: DataFrame, cluster: str, question: str) -> DataFrame:
    """A conversation record for each kept family and variant."""
    joined = variants.join(families, [cluster, "family"])
    return joined.select(
        F.format_string("cluster_%05d_ans_%02d_q_%02d", F.col(cluster).cast("int"), F.col("family").cast("int"), (F.col("place") - 1).cast("int")).alias("id"),
        F.array(F.struct(F.lit("user").alias("from"), F.col(question).alias("value")),
                F.struct(F.lit("assistant").alias("from"), F.col("rep_answer").alias("value"))).alias("conversations"),
        F.struct(F.col(cluster), F.col("support").alias("support_count"), F.col("score").alias("quality_score"), F.col("stance")).alias("metadata"))


def first_variants(members: DataFrame, keys: list[str], value: str, order: list[Column], n: int = 10) -> DataFrame:
    """(keys, variants): the first n distinct values of each group in the order of their first occurrence.

    Occurrences are aggregated by value before the group is ranked, and the group is cut before it is collected.
    """
    once = members.groupBy(*keys, value).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_first"))
    few = once.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy("_first"))).filter(F.col("_at") <= n)
    found = F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value])
    return few.groupBy(*keys).agg(found.alias("variants"))
