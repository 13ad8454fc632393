"""Vector neighbours, key edges and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefengine.plans.lineage import written
from prefengine.plans.ordering import global_rank


def key_edges(df: DataFrame, record: str, key: Column) -> DataFrame:
    """(src, dst) from every row of a key to the key's first row: a star, never all pairs; null keys are no key."""
    keyed = df.select(F.col(record).alias("dst"), key.alias("k")).filter("k is not null")
    first = keyed.groupBy("k").agg(F.min("dst").alias("src"))
    return keyed.join(first, "k").filter("src != dst").select("src", "dst")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, most: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component, by alternating large-star and small-star steps.

    Both steps keep a star per node, so the number of edges never grows and a component of a third of all rows is no
    single task's load: the groups only need a minimum, found by partial aggregation.
    """
    now = written(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct())
    for _ in range(most):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("x"), "m"))  # larger neighbours to the minimum
        large = large.filter("x != m").distinct()
        down = large.groupBy("x").agg(F.min("m").alias("m2"))  # smaller neighbours and oneself to their minimum
        small = large.join(down, "x").select(F.explode(F.array(F.struct(F.col("x").alias("b"), F.col("m2").alias("a")),
                                                               F.struct(F.col("m").alias("b"), F.col("m2").alias("a")))).alias("e"))
        then = written(small.select("e.a", "e.b").filter("a != b").distinct())
        same = (then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
                == now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now = then
        if same:
            break
    else:
        raise RuntimeError(f"components are not settled after {most} rounds")
    return (nodes.select(F.col(node).alias("node")).join(now.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left")
            .select("node", F.coalesce("root", "node").alias("component")))


def number_clusters(components: DataFrame) -> DataFrame:
    """(component, size, cluster_id): largest first, ties by smallest member."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return global_rank(sizes, [F.desc("size"), F.col("component")], "_rank").withColumn("cluster_id", F.col("_rank") - 1).drop("_rank")


def nearest(queries: DataFrame, rows: DataFrame, record: str, vector: str, k: int, least: float, block: int = 5_000) -> DataFrame:
    """(src, dst, score): the k most similar rows of each query by cosine, score >= least, ties by dst.

    The queries are sent to all rows in blocks of at most ``block`` (a stated bound); each batch of rows keeps its own k
    best for every query, and only those are shuffled.
    """
    total = queries.count()
    out = None
    numbered = queries.select(record, vector).withColumn("_block", F.pmod(F.xxhash64(record), F.lit(max(1, -(-total // block)))))
    for b in range(max(1, -(-total // block))):
        mine = numbered.filter(F.col("_block") == b).drop("_block").toPandas()
        ids = mine[record].to_numpy()
        unit = _unit(mine[vector])

        def best(batches, ids=ids, unit=unit):
            for rows_ in batches:
                if not len(rows_) or not len(ids):
                    continue
                rows_ = rows_.sort_values(record)  # so the stable sort below cuts equal scores by dst
                score = unit @ _unit(rows_[vector]).T
                other = rows_[record].to_numpy()
                score[ids[:, None] == other[None, :]] = -2.0
                take = np.argsort(-score, axis=1, kind="stable")[:, :k] if len(other) > k else np.broadcast_to(np.arange(len(other)), score.shape)
                s = np.take_along_axis(score, take, 1).ravel()
                keep = s >= least
                yield pd.DataFrame({"src": np.repeat(ids, take.shape[1])[keep], "dst": other[take.ravel()][keep], "score": s[keep]})

        part = rows.select(record, vector).mapInPandas(best, "src bigint, dst bigint, score double")
        out = part if out is None else out.unionByName(part)
    return (out.withColumn("at", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst")))
            .filter(F.col("at") <= k).drop("at"))


def _unit(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    m = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cell_plan(least: float, recall: float, most_tables: int = 24) -> tuple[int, int]:
    """(bits of a cell, tables) of random hyperplanes for which a pair at cosine ``least`` meets with probability ``recall``,
    at the fewest expected comparisons; (0, 1), one cell for all, where no such plan compares fewer than half of the pairs."""
    same = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi  # two vectors lie on one side of a hyperplane
    best = (0.5, 0, 1)
    for bits in range(1, 25):
        meet = same ** bits
        tables = int(np.ceil(np.log(1 - recall) / np.log1p(-meet))) if meet < 1 else 1
        if tables <= most_tables:
            best = min(best, (tables / 2.0 ** bits, bits, tables))
    return best[1], best[2]


def similar_vectors(rows: DataFrame, record: str, vector: str, least: float, recall: float | None = None, block_rows: int = 8_000,
                    seed: int = 7) -> DataFrame:
    """(src, dst, score), src < dst: pairs with cosine >= least.

    Exactly all of them by default: rows are cut into blocks of about ``block_rows`` and every two blocks are compared by
    one matrix product, which is quadratic work.  With ``recall`` rows meet in cells of random hyperplanes instead, in as
    many tables as a pair at ``least`` needs to meet with that probability (pairs above it more surely); a crowded cell is
    cut into blocks like the whole table, so no task holds it.  Rows without an id or a vector are left out.
    """
    bits, tables = cell_plan(least, recall) if recall else (0, 1)
    known = rows.filter(F.col(record).isNotNull() & F.col(vector).isNotNull()).select(F.col(record).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def in_cells(batches):
        for b in batches:
            unit = _unit_rows(b.column(1))
            ids = b.column(0)
            for t in range(tables):
                normals = np.random.default_rng(seed * 1000 + t).standard_normal((unit.shape[1], bits))
                cell = (unit @ normals > 0) @ (1 << np.arange(bits, dtype=np.int64)) if len(unit) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell * tables + t), ids, b.column(1)], names=["cell", "id", "v"])

    placed = known.mapInArrow(in_cells, "cell bigint, id bigint, v array<double>") if bits else known.select(F.lit(0).cast("bigint").alias("cell"), "id", "v")
    # a row for each cell, of which the plan has at most tables * 2 ** bits
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    spread = (placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("cell", "block", "id", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    def compare(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        block, ids = group["block"].to_numpy(), group["id"].to_numpy()
        unit = _unit_rows(group["v"].combine_chunks())
        mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        src, dst, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(mine), 2_000):
            some = mine[at:at + 2_000]
            s = unit[some] @ unit[other].T
            a, b = np.nonzero(s >= least)
            x, y = ids[some[a]], ids[other[b]]
            keep = x < y if i == j else x != y
            src.append(np.minimum(x, y)[keep])
            dst.append(np.maximum(x, y)[keep])
            score.append(s[a, b][keep])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "score": np.concatenate(score)})

    found = spread.groupBy("cell", "i", "j").applyInArrow(compare, "src bigint, dst bigint, score double")
    # a pair may meet in several tables, and its product may differ in the last digit there
    return found.groupBy("src", "dst").agg(F.max("score").alias("score"))


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """Arrow lists of one length as rows of length 1."""
    if not len(vectors):
        return np.zeros((0, 0))
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def knn_graph(rows: DataFrame, record: str, vector: str, least: float, k: int = 24, recall: float | None = None) -> DataFrame:
    """Directed (src, dst, score): the k best neighbours of each row with cosine >= least, ties by dst; all by default."""
    pairs = similar_vectors(rows, record, vector, least, recall)
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    return (both.withColumn("at", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst")))
            .filter(F.col("at") <= k).drop("at"))


def char_tfidf(df: DataFrame, record: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """(record, gram, weight): tf * (ln((1 + n) / (1 + df)) + 1) of character n-grams, each text of length 1."""
    grams = None
    for n in range(low, high + 1):
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        some = df.filter(F.length(text) >= n).select(record, F.lower(text).alias("_t"), F.explode(starts).alias("_i"))
        some = some.select(record, F.substring("_t", F.col("_i"), F.lit(n)).alias("gram"))
        grams = some if grams is None else grams.unionByName(some)
    tf = grams.groupBy(record, "gram").agg(F.count("*").alias("tf"))
    freq = tf.groupBy("gram").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("n"))
    raw = tf.join(freq, "gram").join(F.broadcast(total)).select(
        record, "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # total is one row
    norm = raw.groupBy(record).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, record).select(record, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def rare_prefix(vectors: DataFrame, record: str, frequency: DataFrame, least: float) -> DataFrame:
    """(record, gram): of each unit vector the rarest grams, up to where the rest is shorter than ``least``.

    Two vectors with a dot product >= least have a gram in common among these: what is left of the one whose grams end
    earlier in the order of rarity is too short to reach it.  So frequent grams hardly ever join.
    """
    order = W.partitionBy(record).orderBy(F.desc("df"), F.desc("gram")).rowsBetween(W.unboundedPreceding, 0)
    tail = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(order))
    return vectors.join(frequency, "gram").withColumn("_tail", tail).filter(F.col("_tail") >= least - 1e-9).select(record, "gram")


def sparse_matches(queries: DataFrame, rows: DataFrame, q: str, r: str, least: float, k: int = 24) -> DataFrame:
    """(q, r, score): the k best rows of each query by the dot product of unit vectors over common grams, score >= least."""
    frequency = queries.select("gram").unionByName(rows.select("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    pairs = rare_prefix(queries, q, frequency, least).join(rare_prefix(rows, r, frequency, least), "gram").select(q, r).distinct()
    score = (pairs.join(queries.select(q, "gram", F.col("weight").alias("wq")), q)
             .join(rows.select(r, "gram", F.col("weight").alias("wr")), [r, "gram"])
             .groupBy(q, r).agg(F.sum(F.col("wq") * F.col("wr")).alias("score")).filter(F.col("score") >= least))
    return (score.withColumn("at", F.row_number().over(W.partitionBy(q).orderBy(F.desc("score"), r)))
            .filter(F.col("at") <= k).drop("at"))
