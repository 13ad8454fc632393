"""A sample that meets target category proportions (problem 6).

1. Records of a wanted category are counted by cell (category and the other margins), aggregated before shuffling.
2. For every plan the cell weights are raked by iterative proportional fitting over all margins: the category margin to
   the targets, each other margin to its share of the corpus.  Cells are kept sparse.  Up to ``max_cells`` of them are
   fitted on the driver; more are fitted as a table, by the same sweeps over aggregates and joins.
3. Quotas are whole numbers that together never exceed ``sample_rows``: a category gets its share times one common
   factor, but at least its minimum and at most its supply, so what a short category leaves goes to the others and what
   a minimum takes comes from the others.  Minimums that exceed the sample together are cut in proportion, and reported.
4. Within a category the records with the smallest weighted exponential keys -ln(u) / weight are drawn.  Keys are counted
   in ``buckets`` ranges first; all records below the range where the quota is reached are in, and only the records of
   that one range are ranked, so no task sorts a category.
5. The report gives targets, supply, what was drawn, the residual gap and whether minimums conflict, by plan and category.

Defined results: names are compared in lower case without outer blanks of any kind; null names are no category; a
record loaded twice counts once; a target without records has supply 0; a plan without targets draws nothing; null
shares and minimums count as 0; null margins are a value of their own; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefengine.plans.lineage import written

_BLANK = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u200b\\u2060\\ufeff]"


def category_name(c: Column) -> Column:
    """Lower case, without outer blanks of any kind; an empty name is null."""
    return F.nullif(F.lower(F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")), F.lit(""))


def rake(counts: np.ndarray, places: list[np.ndarray], margins: list[np.ndarray], most: int = 200, near: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting of sparse cells: cell i lies at ``places[m][i]`` of margin m, whose shares are ``margins[m]``."""
    w = counts.astype(float)
    if not w.sum():
        return w
    w = w / w.sum()
    for _ in range(most):
        before = w
        for at, target in zip(places, margins, strict=True):
            have = np.bincount(at, w, len(target))
            w = w * np.divide(target, have, out=np.zeros(len(target)), where=have > 0)[at]
        if np.abs(w - before).max() < near:
            break
    return w


def quotas(share: np.ndarray, least: np.ndarray, supply: np.ndarray, rows: int) -> np.ndarray:
    """Whole numbers, together ``rows`` where supply and shares allow, never more: one factor times the share, at least the
    minimum (where all minimums fit), at most the supply."""
    low = np.minimum(np.ceil(least - 1e-9), supply).astype(np.int64)
    rows = max(0, int(rows))
    if low.sum() > rows:  # they exclude each other
        return _whole(low * rows / low.sum(), np.zeros(len(low), np.int64), low, rows)
    high = np.where(share > 0, supply, low)
    if high.sum() <= rows:
        return high.astype(np.int64)

    def at(factor: float) -> np.ndarray:
        return np.clip(share * factor, low, high)

    lo, hi = 0.0, 1.0
    while at(hi).sum() < rows:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid).sum() < rows else (lo, mid)
    return _whole(at(hi), low, high, rows)


def _whole(wish: np.ndarray, low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """Whole numbers near the wishes, by largest remainders, within the bounds and together ``rows`` where those allow."""
    out = np.clip(np.floor(wish + 1e-6).astype(np.int64), low, high)
    while (left := rows - int(out.sum())) != 0:
        room = out < high if left > 0 else out > low
        if not room.any():
            break
        order = np.argsort(np.where(room, (out - wish) * np.sign(left), np.inf), kind="stable")[:min(abs(left), int(room.sum()))]
        out[order] += int(np.sign(left))
    return out


def quota_sample(records: DataFrame, record: str, category: Column, margins: list[Column], targets: DataFrame, plans: DataFrame,
                 seed: int = 7, buckets: int = 4096, max_cells: int = 200_000, sweeps: int = 25) -> tuple[DataFrame, DataFrame]:
    """(sample, report): (plan, record, category) of the drawn records, and a row for each plan and target category.

    ``targets`` has (plan, category, target_share, min_rows) and ``plans`` (plan, sample_rows); both are small and read by
    the driver.
    """
    spark = records.sparkSession
    names = [f"margin{i}" for i in range(len(margins))]
    wanted = targets.select("plan", category_name(F.col("category")).alias("category"), "target_share", "min_rows").collect()
    kinds = sorted({r["category"] for r in wanted if r["category"]})
    kind_table = F.broadcast(spark.createDataFrame([(k,) for k in kinds], "category string"))
    known = (records.filter(F.col(record).isNotNull())
             .select(F.col(record).alias("record"), category_name(category).alias("category"),
                     *[F.coalesce(m.cast("string"), F.lit("\0")).alias(n) for m, n in zip(margins, names, strict=True)])
             .filter("category is not null").dropDuplicates(["record"]))
    cells = known.join(kind_table, "category").groupBy("category", *names).agg(F.count("*").alias("n"))
    supply_of = {r["category"]: r["n"] for r in cells.groupBy("category").agg(F.sum("n").alias("n")).collect()}
    supply = np.array([supply_of.get(k, 0) for k in kinds], np.int64)
    plan_rows = {r["plan"]: int(r["sample_rows"] or 0) for r in plans.select("plan", "sample_rows").collect()}
    at = {k: i for i, k in enumerate(kinds)}
    drawn_rows, shares, conflicts = [], [], []
    for plan, rows in plan_rows.items():
        share, least = np.zeros(len(kinds)), np.zeros(len(kinds))
        for r in wanted:
            if r["plan"] == plan and r["category"]:
                share[at[r["category"]]] += r["target_share"] or 0.0
                least[at[r["category"]]] = max(least[at[r["category"]]], r["min_rows"] or 0)
        quota = quotas(share, least, supply, rows)
        conflicts.append((plan, bool(np.minimum(np.ceil(least - 1e-9), supply).sum() > rows)))
        # what is to be drawn, so that minimums without a share have a weight, too
        reached = quota / max(1, quota.sum())
        drawn_rows += [(plan, k, int(quota[i])) for k, i in at.items() if quota[i]]
        shares += [(plan, k, float(reached[i])) for k, i in at.items() if quota[i]]
    few = cells.limit(max_cells + 1).collect()
    if len(few) <= max_cells:
        weights = spark.createDataFrame(_fitted_here(few, names, shares), "plan string, category string, " + "".join(f"{n} string, " for n in names) + "weight double")
        weights = F.broadcast(weights)
    else:
        weights = _fitted_as_table(cells, names, spark.createDataFrame(shares, "plan string, category string, share double"), sweeps)
    quota_table = F.broadcast(spark.createDataFrame(drawn_rows, "plan string, category string, quota long"))
    sample = _smallest_keys(known, names, weights, quota_table, seed, buckets)
    drawn = sample.groupBy("plan", "category").agg(F.count("*").alias("drawn"))
    total = spark.createDataFrame([(k, int(n)) for k, n in zip(kinds, supply, strict=True)], "category string, supply long")
    # the product in decimals: 0.07 x 400 is 28, not a little more
    need = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("decimal(28,9)"),
                      F.coalesce(F.col("target_share"), F.lit(0.0)).cast("decimal(14,9)") * F.col("sample_rows").cast("decimal(14,0)"))
    report = (targets.select("plan", F.col("category").alias("name"), category_name(F.col("category")).alias("category"), "target_share", "min_rows")
              .join(plans.select("plan", "sample_rows"), "plan").join(F.broadcast(spark.createDataFrame(conflicts, "plan string, conflict boolean")), "plan")
              .join(F.broadcast(total), "category", "left").join(drawn, ["plan", "category"], "left")
              .select("plan", "name", "target_share", "min_rows", "sample_rows", F.coalesce("supply", F.lit(0)).alias("supply"),
                      F.coalesce("drawn", F.lit(0)).alias("drawn"), need.alias("needed"), "conflict")
              .withColumn("gap", F.greatest(F.col("needed") - F.col("drawn"), F.lit(0))))
    return sample, report


def _fitted_here(cells: list, names: list[str], shares: list[tuple[str, str, float]]) -> list[tuple]:
    """(plan, category, margins, weight of one record) of all cells, raked on the driver."""
    n = np.array([c["n"] for c in cells], float)
    values = [sorted({c[x] for c in cells}) for x in names]
    where = [{v: i for i, v in enumerate(vs)} for vs in values]
    places = [np.array([w[c[x]] for c in cells], np.int64) for x, w in zip(names, where, strict=True)]
    margins = [np.bincount(p, n, len(v)) / n.sum() for p, v in zip(places, values, strict=True)] if len(n) else []
    out = []
    for plan in sorted({p for p, *_ in shares}):
        share = {k: s for p, k, s in shares if p == plan}
        order = {k: i for i, k in enumerate(share)}
        mine = [i for i, c in enumerate(cells) if c["category"] in share]
        fitted = rake(n[mine], [p[mine] for p in places] + [np.array([order[cells[i]["category"]] for i in mine], np.int64)],
                      [*margins, np.array(list(share.values()))])
        out += [(plan, cells[i]["category"], *[cells[i][x] for x in names], float(max(w, 1e-300) / n[i])) for i, w in zip(mine, fitted.tolist(), strict=True)]
    return out


def _fitted_as_table(cells: DataFrame, names: list[str], shares: DataFrame, sweeps: int) -> DataFrame:
    """The same for any number of cells: every sweep scales the weights to each margin in turn."""
    total = cells.agg(F.sum("n").alias("_total"))
    aims = [(n, cells.groupBy(n).agg(F.sum("n").alias("_n")).join(F.broadcast(total)).select(n, (F.col("_n") / F.col("_total")).alias("_aim"))) for n in names]
    w = written(cells.join(F.broadcast(shares), "category").withColumn("w", F.col("n").cast("double")))
    for _ in range(sweeps):
        for n, aim in aims:
            have = w.groupBy("plan", n).agg(F.sum("w").alias("_have")).join(aim, n)
            w = w.join(have, ["plan", n]).withColumn("w", F.when(F.col("_have") > 0, F.col("w") * F.col("_aim") / F.col("_have")).otherwise(0.0)).drop("_have", "_aim")
        have = w.groupBy("plan", "category").agg(F.sum("w").alias("_have"))
        w = written(w.join(have, ["plan", "category"]).withColumn("w", F.when(F.col("_have") > 0, F.col("w") * F.col("share") / F.col("_have")).otherwise(0.0)).drop("_have"))
    return w.select("plan", "category", *names, (F.greatest("w", F.lit(1e-300)) / F.col("n")).alias("weight"))


def _smallest_keys(known: DataFrame, names: list[str], weights: DataFrame, quota: DataFrame, seed: int, buckets: int) -> DataFrame:
    """(plan, record, category) of the ``quota`` smallest keys of each plan and category."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "plan", "record"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = known.join(weights, ["category", *names]).join(quota, ["plan", "category"]).withColumn("key", -F.log(u) / F.col("weight"))
    # ranges of keys by their logarithm, where a heavier record's keys are only shifted
    keyed = keyed.withColumn("bucket", F.floor(F.log("key") * (buckets / 32.0))).select("plan", "category", "record", "quota", "key", "bucket")
    counts = keyed.groupBy("plan", "category", "quota", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("plan", "category").orderBy("bucket"))
    border = (counts.withColumn("before", upto - F.col("n")).filter((F.col("before") < F.col("quota")) & (F.col("before") + F.col("n") >= F.col("quota")))
              .select("plan", "category", F.col("bucket").alias("border"), "before"))
    # a row for each plan and category; where the supply is the quota the border is the last range
    near = keyed.join(F.broadcast(border), ["plan", "category"]).filter(F.col("bucket") <= F.col("border"))
    within = near.filter("bucket = border").withColumn("place", F.row_number().over(W.partitionBy("plan", "category").orderBy("key", "record")))
    return (near.filter("bucket < border").select("plan", "record", "category")
            .unionByName(within.filter(F.col("place") <= F.col("quota") - F.col("before")).select("plan", "record", "category")))


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/sft_train.parquet")
    targets = spark.read.parquet(f"{sf_dir}/type_targets.parquet").withColumnRenamed("question_type", "category")
    return quota_sample(rows, "id", F.col("metadata.question_type"), [F.col("source"), F.col("metadata.stance")], targets, spark.read.parquet(f"{sf_dir}/sample_plans.parquet"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # exact check: the gap stands where the supply itself falls short
    return (_drawn(spark, sf_dir)[1].filter((F.col("gap") > 0) & (F.col("supply") < F.col("needed")))
            .select("plan", F.col("name").alias("question_type")))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records drawn for every plan."""
    return _drawn(spark, sf_dir)[0].select("plan", F.col("record").alias("id"), F.col("category").alias("question_type"))


P6_SQL = """
WITH t AS (SELECT lower(regexp_replace(metadata.question_type, '^[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}\\x{200b}\\x{2060}\\x{feff}]+|[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}\\x{200b}\\x{2060}\\x{feff}]+$', '', 'g')) AS k, count(DISTINCT id) AS n
  FROM sft_train GROUP BY 1)
SELECT p.plan, g.question_type FROM type_targets g JOIN sample_plans p USING (plan)
LEFT JOIN t ON t.k = lower(trim(g.question_type))
WHERE coalesce(t.n, 0) < greatest(g.min_rows::DECIMAL(28,9), g.target_share::DECIMAL(14,9) * p.sample_rows::DECIMAL(14,0))
"""
