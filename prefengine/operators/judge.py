"""Judge metrics, training-log series and experiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "auto_resolve", "closure")


def half_up(c: Column, places: int) -> Column:
    return F.round(c.cast("decimal(38,18)"), places).cast("double")


def judge_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the judged rows as shares, percentages (2 places) and satisfaction (3 places); sums are whole numbers."""
    n = F.count("*")
    out = [n.alias("samples")]
    for m in METRICS:
        share = F.sum(F.col(m).cast("bigint")) / n
        out += [F.round(share, 6).alias(m), F.round(share * 100, 2).alias(f"{m}_percent")]
    out.append(F.round(F.sum(F.col("satisfaction").cast("bigint")) / n, 3).alias("csat"))
    return rows.groupBy(*(by or [])).agg(*out)


def series(log: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """(step, metric, value) of a wide log, where both are there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return log.filter(F.col(step).isNotNull()).select(F.col(step).alias("step"), pairs.alias("p")).select("step", "p.*").filter("value is not null")


def wide_log(records: DataFrame, step: str, values: str, metrics: list[str]) -> DataFrame:
    """One column per metric of a (step, map) log; records without a step or any of the metrics are left out."""
    have = F.filter(F.array(*[F.col(values)[m] for m in metrics]), lambda x: x.isNotNull())
    return (records.filter(F.col(step).isNotNull() & (F.size(have) > 0))
            .select(step, *[F.col(values)[m].alias(m.replace("/", "_")) for m in metrics]))


def best_step(log: DataFrame, run: str, step: str, metric: str, lower_is_better: bool = True) -> DataFrame:
    """(run, best_step, best_value) with ties going to the earlier step."""
    rows = log.filter(F.col(metric).isNotNull() & F.col(step).isNotNull())
    sign = 1 if lower_is_better else -1
    return rows.groupBy(run).agg(F.min_by(F.struct(F.col(step).alias("s"), F.col(metric).alias("v")),
                                          F.struct(F.col(metric) * sign, F.col(step))).alias("b")).select(run, F.col("b.s").alias("best_step"), F.col("b.v").alias("best_value"))


def best_checkpoint(summary: Column, state: Column, folder: Column) -> Column:
    """The best checkpoint's path: what the run's summary says, else the trainer's state, else the output folder; blank is none."""
    said = [F.nullif(F.trim(c), F.lit("")) for c in (summary, state, folder)]
    return F.coalesce(*said)


def experiment_summary(runs: DataFrame, training: DataFrame, judged: DataFrame, run: str, default: Column) -> DataFrame:
    """Every run with what is known of it; a missing setting is read from the run's name."""
    joined = runs.join(training, run, "left").join(judged, run, "left")
    return joined.withColumn("beta", F.coalesce("beta", default))


def config_grid(base: DataFrame, axes: dict[str, list]) -> DataFrame:
    """The base configuration times every combination of the axes: a chain of explodes, no join."""
    out = base
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def term_counts(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, n): rows that contain each term, in one pass."""
    found = F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col(text), t)))
    hits = rows.select(found.alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return every.join(hits, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def parameter_summary(parameters: DataFrame, size: str, trainable: str) -> DataFrame:
    total, on = F.sum(size), F.sum(F.when(F.col(trainable), F.col(size)).otherwise(0))
    return parameters.agg(total.alias("total"), on.alias("trainable"), (total - on).alias("frozen"), F.round(on / total * 100, 6).alias("percent"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """One row with a Markdown table; nulls are empty cells.  For reports: the rows are collected into one text."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    lines = rows.select(F.struct(*order, cells.alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return lines.agg(F.concat(F.lit(head), body).alias("markdown"))
