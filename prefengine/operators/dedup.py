"""Filtering, audit, exact and fuzzy de-duplication of question-answer rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from prefengine.functions.text import low_value_answer, low_value_question
from prefengine.plans.lineage import cut, written


def drop_reason(question: Column, answer: Column, min_question: int = 2, min_answer: int = 4) -> Column:
    """Why a cleaned row is dropped, or null: emptiness first, then the question, then the answer."""
    return (F.when((F.coalesce(question, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == ""), F.lit("empty_after_clean"))
            .when(low_value_question(question, min_question), F.lit("low_value_question"))
            .when(low_value_answer(answer, min_answer), F.lit("low_value_answer")))


def audit_sample(dropped: DataFrame, reason: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each reason; the counts of ``funnel`` are not limited."""
    return (dropped.withColumn("_at", F.row_number().over(W.partitionBy(reason).orderBy(order)))
            .filter(F.col("_at") <= limit).drop("_at"))


def keep_best(df: DataFrame, keys: list[str], best: list[Column], record: str) -> DataFrame:
    """df with ``duplicate_of``: null for the best row of each key, else the best row's record.

    The best row is found by a partial aggregation and joined back, so a key of a third of all rows is never sorted in
    one task.
    """
    top = df.groupBy(*keys).agg(F.max_by(F.col(record), F.struct(*best)).alias("_best"))
    out = df.join(top, keys)
    return out.withColumn("duplicate_of", F.when(F.col("_best") != F.col(record), F.col("_best"))).drop("_best")


def best_of(df: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """(keys, rank) of the best row of each key, in one shuffle; it is sorted by a hash of the key, not by its texts."""
    top = df.groupBy(F.xxhash64(*keys).alias("_h"), *keys).agg(F.max(F.struct(*rank)).alias("_best"))
    return top.select(*keys, "_best.*")


def block_keys(text: str | Column) -> Column:
    """Two keys of a text: length band with the first, and with the last eight characters."""
    c = F.col(text) if isinstance(text, str) else text
    band = F.least(F.floor(F.length(c) / 4), F.lit(50)).cast("string")
    return F.when(F.length(c) == 0, F.array(F.lit("empty"))).otherwise(F.array(
        F.concat(F.lit("p:"), band, F.lit(":"), F.substring(c, 1, 8)),
        F.concat(F.lit("s:"), band, F.lit(":"), F.right(c, F.lit(8)))))


def ratio_bound(a: Column, b: Column) -> Column:
    """The highest sequence ratio that the lengths allow."""
    return 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; order matters, as junk is taken from the second text."""
    out = []
    for x, y in zip(a, b, strict=True):
        out.append(1.0 if x == y else SequenceMatcher(None, x, y).ratio())
    return pd.Series(out)


def ratio_reaches(least: float):
    """A function of two texts: whether their sequence ratio is at least ``least``, with the cheap upper bounds first."""
    @F.pandas_udf(BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if x == y:
                out.append(True)
                continue
            m = SequenceMatcher(None, x, y)
            out.append(m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least)
        return pd.Series(out, dtype=bool)

    return reaches


def rows_reach(q_least: float, a_least: float, pair_least: float):
    """A function of question, answer, question, answer: near questions, and near answers or both together near."""
    def near(x: str, y: str, least: float) -> bool:
        return x == y or SequenceMatcher(None, x, y).ratio() >= least

    @F.pandas_udf(BooleanType())
    def reach(qa: pd.Series, aa: pd.Series, qb: pd.Series, ab: pd.Series) -> pd.Series:
        out = [near(q, p, q_least) and (near(a, b, a_least) or near(f"{q}||{a}", f"{p}||{b}", pair_least)) for q, a, p, b in zip(qa, aa, qb, ab, strict=True)]
        return pd.Series(out, dtype=bool)

    return reach


@F.pandas_udf(StructType([StructField("s0", LongType()), StructField("s1", LongType())]))
def parities(text: pd.Series) -> pd.DataFrame:
    """128 bits of a text: whether the characters of each of 128 hash slots occur an odd number of times.

    A character that only one of two texts has changes one bit, so the bits that differ are at most the unmatched
    characters; the bits of two texts in a row are the exclusive or of both.
    """
    texts = ["" if t is None else t for t in text]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    at = np.repeat(np.arange(len(texts), dtype=np.int64) * 128, [len(t) for t in texts])
    odd = np.bincount(at + ((code * np.uint32(2654435761)) >> np.uint32(25)), minlength=128 * len(texts)) & 1
    bits = np.packbits(odd.astype(np.uint8).reshape(-1, 128), axis=1).view("<i8")
    return pd.DataFrame({"s0": bits[:, 0], "s1": bits[:, 1]})


def parity_allows(bits: tuple[Column, Column], n: Column, other: Column, least: float) -> Column:
    """Whether texts of these lengths, whose parities differ in these bits, may have a sequence ratio >= least."""
    apart = F.greatest(F.bit_count(bits[0]) + F.bit_count(bits[1]), F.abs(n - other))
    return apart <= (n + other) * (1 - least) + 1e-6


def _pairs_of(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; a shorter text is its own."""
    n = F.length(text)
    return F.when(n < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))))


def pair_counts(texts: DataFrame, columns: list[str], slots: int = 4_096) -> DataFrame:
    """One row with ``_counts``: how often the character pairs of each of ``slots`` hash slots occur; it only orders pairs."""
    some = None
    for c in columns:
        one = texts.select(F.explode(_pairs_of(F.col(c))).alias("p"))
        some = one if some is None else some.unionByName(one)
    counts = some.groupBy(F.pmod(F.xxhash64("p"), F.lit(slots)).alias("slot")).agg(F.count("*").alias("n"))
    every = texts.sparkSession.range(slots).withColumnRenamed("id", "slot").join(counts, "slot", "left")
    inner = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("n", F.lit(0)).alias("n"))))
    return every.agg(F.transform(inner, lambda x: x["n"]).alias("_counts"))


def prefix_pairs(text: Column, least: float, other: Column, counts: Column) -> Column:
    """The character pairs of a text of which any text with a sequence ratio >= least must have one.

    A ratio of ``least`` leaves at most (1 - least) of both texts' characters unmatched, and every unmatched one parts at
    most one pair, so the distinct pairs that both share are few less than all; in a fixed order (the rarest first) the
    first ones, of the number that may be missing and one more, must meet.  ``other``: the least length of the other text.
    """
    n, pairs = F.length(text), _pairs_of(text)
    shared = F.ceil((n + other) * (least / 2 - (1 - least)) - 1 - 1e-9) - (n - 1 - F.size(pairs))
    first = F.greatest(F.size(pairs) - F.greatest(shared, F.lit(1)) + 1, F.lit(1)).cast("int")

    def place(p: Column) -> Column:
        h = F.xxhash64(p)
        return F.struct(F.element_at(counts, (F.pmod(h, F.size(counts)) + 1).cast("int")).alias("n"), h.alias("h"), p.alias("p"))

    return F.transform(F.slice(F.array_sort(F.transform(pairs, place)), F.lit(1), first), lambda x: x["p"])


SAMPLE = 16  # one text of so many tells which blocks and questions are crowded; that only chooses the way
FEW = 1_000_000  # pairs of rows whose records are broadcast to the texts


def near_candidates(texts: DataFrame, least: float, crowd: int = 512) -> DataFrame:
    """(ha, hb), ha < hb: hashes of all texts of a common block that may have a ratio >= least.  ``texts`` has t, s0, s1.

    In a block of fewer than ``crowd`` texts every two are compared by length and parity; those of a crowded one meet only
    on the rarest character pairs, by an exact prefix filter.
    """
    numbers = [F.xxhash64("t").alias("h"), F.length("t").alias("n"), "s0", "s1"]
    keyed = texts.select(F.explode(block_keys("t")).alias("k"), *numbers).withColumn("k", F.xxhash64("k"))
    crowded = cut(keyed.filter(F.pmod("h", F.lit(SAMPLE)) == 0).select("k", "h").distinct().groupBy("k").count().filter(F.col("count") * SAMPLE >= crowd).select("k"))

    def met(some: DataFrame, on: list[str]) -> DataFrame:
        a, b = (some.select(*on, *[F.col(c).alias(c + x) for c in ("h", "n", "s0", "s1")]) for x in "ab")
        bits = F.col("s0a").bitwiseXOR(F.col("s0b")), F.col("s1a").bitwiseXOR(F.col("s1b"))
        return a.join(b, on).filter((F.col("ha") < F.col("hb")) & parity_allows(bits, F.col("na"), F.col("nb"), least)).select("ha", "hb")

    if crowded.isEmpty():
        return met(keyed.repartition("k").distinct(), ["k"]).distinct()
    plain = met(keyed.join(F.broadcast(crowded), "k", "left_anti").repartition("k").distinct(), ["k"])
    some = texts.select("t", *numbers, F.explode(block_keys("t")).alias("k")).withColumn("k", F.xxhash64("k")).join(F.broadcast(crowded), "k")
    some = some.groupBy("h", "t", "n", "s0", "s1").agg(F.collect_set("k").alias("ks"))
    counts = cut(pair_counts(some.filter(F.pmod("h", F.lit(SAMPLE)) == 0), ["t"]))
    other = F.greatest(F.col("n") - 3, F.col("n") * least / (2 - least))  # texts of a block differ by 3 characters or, beyond 200, by what the ratio allows
    some = (some.join(F.broadcast(counts)).select("h", "n", "s0", "s1", "ks", F.explode(prefix_pairs(F.col("t"), least, other, F.col("_counts"))).alias("p"))  # counts is one row
            .select("h", "n", "s0", "s1", F.explode("ks").alias("k"), F.xxhash64("p").alias("p")))
    return plain.unionByName(met(some, ["k", "p"])).distinct()


def near_texts(texts: DataFrame, text: str, least: float, crowd: int = 512) -> DataFrame:
    """(ta, tb): all ordered pairs of distinct texts (and each with itself) of a common block with a ratio >= least."""
    one = texts.select(F.col(text).alias("t")).distinct().filter("t is not null")
    ids = one.withColumn("h", F.xxhash64("t"))
    pairs = near_candidates(one.select("t", parities("t").alias("s")).select("t", "s.*"), least, crowd)
    pairs = pairs.unionByName(pairs.select(F.col("hb").alias("ha"), F.col("ha").alias("hb")))
    both = pairs.join(ids.select(F.col("h").alias("ha"), F.col("t").alias("ta")), "ha").join(ids.select(F.col("h").alias("hb"), F.col("t").alias("tb")), "hb")
    near = both.filter(F.arrays_overlap(block_keys("ta"), block_keys("tb")) & ratio_reaches(least)("ta", "tb")).select("ta", "tb")
    return near.unionByName(one.select(F.col("t").alias("ta"), F.col("t").alias("tb")))


def greedy_survivors(rows: DataFrame, edges: DataFrame, record: str, most: int = 50) -> DataFrame:
    """What a scan in rank order keeps, if a row is dropped as soon as a kept one has an edge to it.

    That is the first maximal independent set by rank: in every round a row without an undecided winner is decided
    (dropped, if any winner is kept).  ``edges`` has (loser, winner).  Returns (record, kept).
    """
    decided = cut(rows.select(record).join(edges.select(F.col("loser").alias(record)).distinct(), record, "left_anti")
                  .withColumn("kept", F.lit(True)))
    open_edges = cut(edges.select("loser", "winner"))
    for _ in range(most):
        state = open_edges.join(decided.select(F.col(record).alias("winner"), "kept"), "winner", "left")
        by_row = state.groupBy("loser").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"),
                                            F.min(F.col("kept").isNotNull()).alias("all_known"))
        done = by_row.filter("hit or all_known").select(F.col("loser").alias(record), (~F.col("hit")).alias("kept"))
        done = cut(done)
        if done.isEmpty():
            break
        decided = cut(decided.unionByName(done))
        open_edges = cut(open_edges.join(done.select(F.col(record).alias("loser")), "loser", "left_anti"))
        if open_edges.isEmpty():
            break
    else:
        raise RuntimeError(f"not settled after {most} rounds")
    return decided


def fuzzy_dedup(df: DataFrame, record: str, question: str, answer: str, rank: list[str], q_least: float = 0.96,
                a_least: float = 0.92, pair_least: float = 0.95, crowd: int = 512) -> DataFrame:
    """(record, kept): a row goes when a kept, better one of a common block has nearly its question and its answer.

    Hashes, lengths and parities of the texts choose the pairs of rows, by bounds that lose none; only those pairs fetch
    their texts.  Rows of a question of ``crowd`` answers or more meet on the rarest character pairs of their answers, by
    exact prefix filters, so it does not give all their pairs.
    """
    rows = df.select(F.col(record).alias("r"), F.col(question).alias("q"), F.col(answer).alias("a"), F.struct(*rank).alias("rank"))
    rows = written(rows.select("*", parities("q").alias("s"), parities("a").alias("t")))
    known = rows.filter("q is not null and a is not null")
    numbers = ["r", "rank", F.length("q").alias("n"), F.length("a").alias("m"), "s.s0", "s.s1", F.col("t.s0").alias("t0"), F.col("t.s1").alias("t1")]
    short = known.select(F.xxhash64("q").alias("h"), *numbers)
    pairs = cut(near_candidates(known.select(F.col("q").alias("t"), "s.*"), q_least, crowd))
    crowded = cut(short.filter(F.pmod(F.xxhash64("r"), F.lit(SAMPLE)) == 0).groupBy("h").count().filter(F.col("count") * SAMPLE >= crowd).select("h"))

    def sides(some: DataFrame, *on: str) -> list[DataFrame]:
        return [some.select(*[F.col(c).alias(f"h{x}" if c == "h" else c) for c in on], *[F.col(c).alias(c + x) for c in ("r", "rank", "n", "m", "s0", "s1", "t0", "t1")]) for x in "ab"]

    def chosen(both: DataFrame) -> DataFrame:
        """(loser, winner) of the pairs of rows whose answers, or both texts together, may be near."""
        apart = {c: F.col(c + "a").bitwiseXOR(F.col(c + "b")) for c in ("s0", "s1", "t0", "t1")}
        joined = apart["s0"].bitwiseXOR(apart["t0"]), apart["s1"].bitwiseXOR(apart["t1"])
        may = (parity_allows((apart["t0"], apart["t1"]), F.col("ma"), F.col("mb"), a_least)
               | parity_allows(joined, F.col("na") + F.col("ma") + 2, F.col("nb") + F.col("mb") + 2, pair_least))
        less = F.col("ranka") < F.col("rankb")
        return (both.filter(may & (less | (F.col("ranka") > F.col("rankb"))))
                .select(F.when(less, F.col("ra")).otherwise(F.col("rb")).alias("loser"), F.when(less, F.col("rb")).otherwise(F.col("ra")).alias("winner")))

    def same(some: DataFrame) -> DataFrame:
        a, b = sides(some, "h")
        return chosen(a.join(b, (F.col("ha") == F.col("hb")) & (F.col("ranka") < F.col("rankb"))))

    def across(some: DataFrame, which: DataFrame) -> DataFrame:
        a, b = sides(some, "h")
        return chosen(which.join(a, "ha").join(b, "hb"))

    if crowded.isEmpty():
        met = same(short).unionByName(across(short, pairs))
    else:
        many = F.broadcast(crowded)
        hot = (pairs.join(many.withColumnRenamed("h", "ha"), "ha", "left_semi").unionByName(pairs.join(many.withColumnRenamed("h", "hb"), "hb", "left_semi")).distinct()
               .unionByName(crowded.select(F.col("h").alias("ha"), F.col("h").alias("hb"))))
        met = (same(short.join(many, "h", "left_anti"))
               .unionByName(across(short, pairs.join(many.withColumnRenamed("h", "ha"), "ha", "left_anti").join(many.withColumnRenamed("h", "hb"), "hb", "left_anti"))))
        near = hot.select(F.col("ha").alias("h")).unionByName(hot.select(F.col("hb").alias("h"))).distinct()
        some = known.withColumns({"h": F.xxhash64("q"), "b": F.concat("q", F.lit("||"), "a")}).join(near, "h")
        counts = cut(pair_counts(some.filter(F.pmod(F.xxhash64("r"), F.lit(SAMPLE)) == 0), ["q", "a"]))

        def rare(c: str, least: float) -> Column:
            """Prefix pairs of a column, whatever the other text's length, with a letter that says of which column."""
            found = prefix_pairs(F.col(c), least, F.length(c) * (least / (2 - least)), F.col("_counts"))
            return F.transform(found, lambda p: F.xxhash64(F.lit(c), p))

        keyed = some.join(F.broadcast(counts)).select("h", F.explode(F.concat(rare("a", a_least), rare("b", pair_least))).alias("g"), *numbers)
        a, b = sides(keyed, "h", "g")
        met = met.unionByName(chosen(hot.join(a, "ha").join(b, ["hb", "g"])).distinct())
    met = cut(met)
    texts = known.select("r", "q", "a")
    if met.count() <= FEW:  # else all texts are shuffled
        ids = met.select(F.col("loser").alias("r")).unionByName(met.select(F.col("winner").alias("r"))).distinct()
        texts = texts.join(F.broadcast(ids), "r", "left_semi")
    one, two = (texts.select(F.col("r").alias(name), F.col("q").alias(f"q{x}"), F.col("a").alias(f"a{x}")) for name, x in (("loser", "a"), ("winner", "b")))
    both = met.join(one, "loser").join(two, "winner")
    edges = cut(both.filter(F.arrays_overlap(block_keys("qa"), block_keys("qb")) & rows_reach(q_least, a_least, pair_least)("qa", "aa", "qb", "ab")).select("loser", "winner"))
    return greedy_survivors(rows.select(F.col("r").alias(record)), edges, record)


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of each stage, counted where it runs."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("at"), F.lit(name).alias("stage"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def filter_funnel(df: DataFrame, kept: Column, keys: list[Column]) -> DataFrame:
    """(at, stage, rows) of all rows, those kept and the distinct keys of those, in one pass and one shuffle."""
    own = [F.when(kept, k).alias(f"_k{i}") for i, k in enumerate(keys)]
    groups = df.select(kept.alias("_kept"), *own).groupBy("_kept", *[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = groups.agg(n(F.col("n")).alias("raw"), n(F.when(F.col("_kept"), F.col("n"))).alias("kept"), n(F.when(F.col("_kept"), 1)).cast("bigint").alias("distinct"))
    return one.selectExpr("stack(3, 0, 'raw', raw, 1, 'after_filter', kept, 2, 'after_exact_dedup', distinct) as (at, stage, rows)")


def top_values(df: DataFrame, value: Column, n: int = 10) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)
