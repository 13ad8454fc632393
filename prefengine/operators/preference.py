"""From judged candidates to preference pairs: validation, best and worst, weak pairs, statistics, quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefengine.plans.ordering import global_rank, running_total


def unique_candidates(rows: DataFrame, record: str, index: str, content: str) -> DataFrame:
    """(record, index, content): trimmed, without empty ones, the first of equal texts, numbered anew from 0."""
    text = F.regexp_replace(F.col(content), "(?U)^\\s+|\\s+$", "")
    first = rows.withColumn(content, text).filter(F.col(content) != "").groupBy(record, content).agg(F.min(index).alias("_old"))
    return first.select(record, (F.row_number().over(W.partitionBy(record).orderBy("_old")) - 1).alias(index), content)


def enough_candidates(candidates: DataFrame, record: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(records with enough different candidates, the skipped ones with their number)."""
    n = candidates.groupBy(record).agg(F.count("*").alias("n"))
    least = max(2, least)
    return n.filter(F.col("n") >= least), n.filter(F.col("n") < least).withColumn("reason", F.lit("low_diversity"))


def sampling_grid(temperatures: list[float], top_ps: list[float]) -> list[tuple[int, float, float]]:
    if len(temperatures) != len(top_ps):
        raise ValueError("temperatures and top_ps must be of one length")
    if len(temperatures) < 2:
        raise ValueError("at least two temperatures are needed")
    return [(i, t, p) for i, (t, p) in enumerate(zip(temperatures, top_ps, strict=True))]


# --- validation of scores -------------------------------------------------------------------------------------------

def binary_score(v: Column) -> Column:
    """0 or 1 of a VARIANT (booleans, numbers by their whole part, '0' and '1'), else null."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).otherwise(_whole(v, 0, 1, "[01]"))


def whole_score(v: Column, low: int, high: int) -> Column:
    """A whole number in [low, high] of a VARIANT: numbers by their whole part, strings of digits, else null."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", _within(F.try_variant_get(v, "$", "boolean").cast("int"), low, high)).otherwise(_whole(v, low, high, "\\d+"))


def _within(n: Column, low: int, high: int) -> Column:
    return F.when(n.between(low, high), n)


def _whole(v: Column, low: int, high: int, pattern: str) -> Column:
    text = F.trim(F.try_variant_get(v, "$", "string"))
    number = F.try_variant_get(v, "$", "double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int")
    return F.when(F.schema_of_variant(v) == "STRING", F.when(text.rlike(f"^{pattern}$"), _within(text.try_cast("int"), low, high))).otherwise(_within(whole, low, high))


def overall_score(v: Column) -> Column:
    """A number in [0, 100] of a VARIANT number or numeric string, rounded to 4 places, else null."""
    n = F.coalesce(F.try_variant_get(v, "$", "double"), F.trim(F.try_variant_get(v, "$", "string")).try_cast("double"))
    return F.when(n.between(0, 100) & ~F.isnan(n), F.round(n, 4))


def complete(score: Column) -> Column:
    """Whether every field of a score is there and in its range."""
    ok = score["index"].isNotNull() & score["satisfaction"].between(1, 5) & score["overall_score"].between(0, 100) & ~F.isnan(score["overall_score"])
    for name in ("hallucination", "accuracy", "closure", "auto_resolve"):
        ok = ok & score[name].isin(0, 1)
    return F.coalesce(ok, F.lit(False))


def aligned_score(s: Column) -> Column:
    """-100 for a severe hallucination, else a weighted sum of at most 102."""
    total = s["accuracy"] * 40.0 + s["closure"] * 25.0 + s["auto_resolve"] * 20.0 + s["satisfaction"] * 3.0 + s["overall_score"] * 0.02
    return F.when(s["hallucination"] == 1, F.lit(-100.0)).otherwise(F.round(total, 4))


def missing_scores(candidates: Column, scores: Column) -> Column:
    """The candidate indexes that no score has."""
    return F.array_except(candidates, F.transform(scores, lambda s: s["index"]))


def judged_pairs(ranked: DataFrame, record: str = "id", scores: str = "scores") -> DataFrame:
    """(record, status, best_index, worst_index, best_score, worst_score, score_delta) of each judged set.

    Best: the highest by accuracy, closure, auto_resolve, satisfaction, overall, aligned score, lower index, without a
    severe hallucination.  Worst: among accurate but unfinished ones, else among any without a severe hallucination,
    else among all others, the one that fails most.  Sets are arrays of a few candidates, so all of this stays in a row.
    """
    s = F.col(scores)
    valid = (F.size(s) >= 2) & F.forall(s, lambda x: x.isNotNull() & complete(x))
    def key(x: Column) -> Column:
        return F.struct(x["accuracy"].alias("a"), x["closure"].alias("b"), x["auto_resolve"].alias("c"), x["satisfaction"].alias("d"),
                        x["overall_score"].alias("e"), aligned_score(x).alias("f"), (-x["index"]).alias("g"), x.alias("x"))
    def fail(x: Column) -> Column:
        return F.struct((1 - x["closure"]).alias("b"), (1 - x["auto_resolve"]).alias("c"), (5 - x["satisfaction"]).alias("d"),
                        (100.0 - x["overall_score"]).alias("e"), (-x["index"]).alias("g"), x.alias("x"))
    best = F.array_max(F.transform(F.filter(s, lambda x: x["hallucination"] == 0), key))["x"]
    step = ranked.select(F.col(record), s.alias("_s"), valid.alias("_valid"), F.when(valid, best).alias("_best"))
    others = F.filter(F.col("_s"), lambda x: x["index"] != F.col("_best")["index"])
    calm = F.filter(others, lambda x: x["hallucination"] == 0)
    vague = F.filter(calm, lambda x: (x["accuracy"] == 1) & ((x["closure"] == 0) | (x["auto_resolve"] == 0)))
    pool = F.when(F.size(vague) > 0, vague).when(F.size(calm) > 0, calm).otherwise(others)
    step = step.withColumn("_worst", F.when(F.col("_best").isNotNull(), F.array_max(F.transform(pool, fail))["x"]))
    status = (F.when(~F.coalesce(F.col("_valid"), F.lit(False)), F.lit("invalid_scores"))
              .when(F.col("_best").isNull(), F.lit("all_hallucinated"))
              .when(F.col("_worst").isNull(), F.lit("no_rejected")).otherwise(F.lit("ok")))
    hi, lo = aligned_score(F.col("_best")), aligned_score(F.col("_worst"))
    return step.select(record, status.alias("status"), F.col("_best.index").alias("best_index"), F.col("_worst.index").alias("worst_index"),
                       hi.alias("best_score"), lo.alias("worst_score"), F.round(hi - lo, 4).alias("score_delta"))


# --- pairs ----------------------------------------------------------------------------------------------------------

def last_content(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))["content"]


def usable_pair(chosen: Column, rejected: Column, delta: Column) -> Column:
    """'kept', or why a pair is skipped."""
    a, b = (F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)^\\s+|\\s+$", "") for x in (chosen, rejected))
    return F.when(a == b, "equal_texts").when(delta.isNull() | F.isnan(delta), "no_delta").otherwise("kept")


def weakest_dropped(pairs: DataFrame, delta: str, record: str, fraction: float = 0.1) -> DataFrame:
    """pairs with ``kept``: the weakest fraction (half to even) by (delta, record) is dropped; ties there may be kept."""
    fraction = min(1.0, max(0.0, fraction))
    ranked = global_rank(pairs, [F.col(delta), F.col(record)], "_rank")
    drop = round(ranked.count() * fraction)
    return ranked.withColumn("kept", F.col("_rank") > drop).drop("_rank")


def nth_stats(df: DataFrame, value: str, at: dict[str, float], half_even: bool = False) -> DataFrame:
    """One row: for each name the element at the whole position (n - 1) * p of the ordered values, and their mean.

    Positions come from running totals of the value counts, so no task sees all values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = running_total(counts, [F.col("v")], F.col("n"), "upto")
    total = upto.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    def position(p: float) -> Column:
        x = F.lit((total - 1) * p)
        return F.bround(x) if half_even else F.floor(x + 1e-9)
    picks = [F.min(F.when(F.col("upto") > position(p), F.col("v"))).alias(name) for name, p in at.items()]
    return upto.agg(F.sum("n").alias("count"), *picks, (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))


def quality_reasons(chosen: Column, rejected: Column, risky: Column) -> Column:
    """Why a pair is not of high quality; reasons do not exclude each other."""
    weak = (rejected["closure"] == 0) | (rejected["auto_resolve"] == 0)
    return F.array_compact(F.array(
        F.when(chosen["accuracy"] != 1, F.lit("chosen_not_accurate")), F.when(chosen["closure"] != 1, F.lit("chosen_not_closed")),
        F.when(chosen["auto_resolve"] != 1, F.lit("chosen_not_resolved")), F.when(chosen["satisfaction"] < 4, F.lit("chosen_low_satisfaction")),
        F.when(risky, F.lit("chosen_risky_content")), F.when(rejected["hallucination"] == 1, F.lit("rejected_hallucinated")),
        F.when(rejected["accuracy"] != 1, F.lit("rejected_not_accurate")), F.when(~weak, F.lit("rejected_not_weak"))))


def reward_margin(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """(margin, accuracy): the mean reward difference and the share of pairs with a positive one."""
    d = F.col(chosen) - F.col(rejected)
    return df.agg(F.avg(d).alias("margin"), F.avg((d > 0).cast("double")).alias("accuracy"))
