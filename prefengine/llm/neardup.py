"""Near-duplicate records with small edits (problem 5): order min-hash, then verification.

1. The compared columns are joined without a separator and folded; shorter texts than ``min_chars`` take no part.
   Exact copies of a folded form are one text from here on.
2. Every text gets ``sketches`` order min-hash keys (see ``_sketch``): each hashes a few occurrence-labelled k-mers, the
   first ``ordered`` of them in text order.  Moved blocks break that order, so the others leave it out.  Keys and text
   ids travel as packed arrays, one row per block and target partition, since a row per key would cost many times its
   12 bytes.
3. Texts with an equal key are candidates.  A key shared by more than ``hot`` texts is not paired off: its texts go
   through an exact prefix-filter join on their rarest trigrams instead, so no candidate of such a key is lost.  Keys
   that a sample shows to have more than ``split`` texts take that way without ever meeting in one task.
4. Candidates are verified on whole texts: ``verify="trigrams"`` keeps S >= threshold exactly; ``verify="alignment"``
   keeps those whose banded alignment needs at most ``(1 - threshold)`` edits per character, and reports the edits.

Order min-hash is probabilistic: of random texts with edits and moved blocks about 3 % of the links at S = 0.70 to 0.75
share no key, 0.7 % at 0.75 to 0.80 and none of 2,000 above (measured, see README).

Defined results: null columns count as empty; rows without an id, with empty or short texts are in no link; a record loaded twice
(same id) is one record; several records of one text are all linked to each other with S = 1; an empty table gives an
empty result; very long texts are used whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.llm._packed import ID_BITS, fold_batch, folded_texts, frequent, of_text, packed_parts, prefix_keys, source_texts, text_hash, text_tables, to_text, unpacked, within
from prefengine.llm._sketch import order_sketches
from prefengine.llm._text import trigrams
from prefengine.operators.graph import connected_components
from prefengine.plans.lineage import written


def _packed_keys(min_chars: int, how: tuple, parts: int, hot_keys: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(dict.fromkeys(fold_batch(b, min_chars)[1]))
            if not texts:
                continue
            keys = order_sketches(texts, *how)
            docs = np.repeat(text_hash(texts, bits), keys.shape[1])
            keys = keys.reshape(-1)
            apart = within(keys, hot_keys)
            rows = [(*r, False) for r in packed_parts(keys[~apart], docs[~apart], parts)]
            rows += [(*r, True) for r in packed_parts(keys[apart], docs[apart], parts, by=docs[apart])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                              pa.array([r[2] for r in rows], pa.bool_())], names=["part", "packed", "apart"])
    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, texts, starts, sizes) of the keys that several texts of a partition share, each text once for a key."""
    chunks = [x for b in batches for x, apart in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if not apart]
    keys, docs = unpacked(chunks)
    chunks.clear()
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(keys), bool)
    shared[1:] = same
    shared[:-1] |= same
    order = order[shared]
    keys, docs = keys[order], docs[order]
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])  # copies of a text meet here
    keys, docs = keys[new], docs[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys, docs, starts, np.diff(np.concatenate([starts, [len(keys)]]))


def _same_key(hot: int):
    """Pairs (a, b), a < b, of texts that share a key of at most ``hot`` texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, starts, sizes = _by_key(batches)
        few = sizes <= hot
        left, right = [], []
        for d in range(1, int(sizes[few].max(initial=1))):  # the d-th next text of the same key
            s, n = starts[few & (sizes > d)], sizes[few & (sizes > d)] - d
            at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            left.append(docs[at])
            right.append(docs[at + d])
        if left:
            pairs = np.stack([np.concatenate(left), np.concatenate(right)], 1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].astype(np.int64)
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
            for at in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at:at + 50_000, i]) for i in (0, 1)], names=["a", "b"])
    return run


def _crowded(hot: int):
    """(key, doc) of the keys of more than ``hot`` texts, and of those kept apart before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for b in batches:
            kept.append(b)
            for packed, apart in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if apart:
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in unpacked([packed])], names=["key", "doc"])
        keys, docs, starts, sizes = _by_key(iter(kept))
        for s, n in zip(starts[sizes > hot].tolist(), sizes[sizes > hot].tolist(), strict=True):
            for at in range(s, s + n, 50_000):
                end = min(s + n, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[at:end].astype(np.int64)) for x in (keys, docs)],
                                                 names=["key", "doc"])
    return run


def banded_edits(a: str, b: str, most: int) -> int | None:
    """Edits that turn a into b, or None beyond ``most``: furthest-reaching points on the diagonals of a band."""
    if abs(len(a) - len(b)) > most:
        return None
    reach = {0: 0}
    for used in range(most + 1):
        if used:
            then: dict[int, int] = {}
            for d, i in reach.items():
                for dd, ii in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):
                    if ii <= len(a) and 0 <= ii - dd <= len(b) and ii > then.get(dd, -1):
                        then[dd] = ii
            reach = then
        for d, i in reach.items():
            j = i - d
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            reach[d] = i
        if reach.get(len(a) - len(b)) == len(a):
            return used
    return None


def _verified(threshold: float, verify: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: bytes | None = None
        mine: set[str] = set()
        for b in batches:
            keep, score = [], []
            for i, (text_a, text_b) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if verify == "alignment":
                    x, y = map(to_text, (text_a, text_b))
                    n = max(len(x), len(y))
                    edits = banded_edits(x, y, int((1 - threshold) * n + 1e-9))
                    s = -1.0 if edits is None else 1 - edits / n
                else:
                    if text_b != last:
                        last, mine = text_b, trigrams(to_text(text_b))
                    other = trigrams(to_text(text_a))
                    n, m = len(mine), len(other)
                    if min(n, m) < threshold * max(n, m) - 1e-9:
                        continue
                    common = len(mine & other)
                    s = common / (n + m - common)
                if s >= threshold - 1e-12:
                    keep.append(i)
                    score.append(s)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(keep) for k in range(4)], pa.array(score, pa.float64())],
                                             names=["a", "more_a", "b", "more_b", "similarity"])
    return run


def similar_texts(texts: DataFrame, source: DataFrame, threshold: float = 0.8, min_chars: int = 40, k: int = 4,
                  length: int = 4, sketches: int = 28, bottom: int = 64, ordered: int = 8, hot: int = 1024, split: int = 200_000,
                  verify: str = "trigrams", bits: int = ID_BITS) -> DataFrame:
    """(a, more_a, b, more_b, similarity) of all different texts found similar; ``source`` has (record, text), ``texts`` (doc, more, text)."""
    spark = source.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    how = (k, length, sketches, bottom, ordered)
    hot_keys, _, order = frequent(source, min_chars, lambda x: order_sketches(x, *how).reshape(-1), split)
    packed = (source.mapInArrow(_packed_keys(min_chars, how, parts, hot_keys, bits), "part int, packed binary, apart boolean")
              .repartitionById(parts, "part"))
    pairs = packed.mapInArrow(_same_key(hot), "a bigint, b bigint")
    crowded = packed.mapInArrow(_crowded(hot), "key bigint, doc bigint")
    prefix = (crowded.join(texts, "doc").select("key", "doc", "text")
              .mapInArrow(prefix_keys(threshold, order), "key bigint, doc bigint").distinct())
    more = (prefix.withColumnRenamed("doc", "a").join(prefix.withColumnRenamed("doc", "b"), "key")
            .filter(F.col("a") < F.col("b")).select("a", "b"))
    candidates = pairs.unionByName(more).repartition("a").distinct()  # lies by a for the join, too
    a, b = (texts.select(F.col("doc").alias(x), F.col("more").alias(f"more_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return (candidates.join(a, "a").join(b, "b").select("a", "more_a", "b", "more_b", "text_a", "text_b")
            .mapInArrow(_verified(threshold, verify), "a bigint, more_a bigint, b bigint, more_b bigint, similarity double"))


def near_duplicates(df: DataFrame, record: str, columns: list[str], threshold: float = 0.8, **how) -> DataFrame:
    """(record_a, record_b, similarity), record_a < record_b: all pairs of records found similar, copies included."""
    source = source_texts(df, record, F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    texts, members = text_tables(source, how.get("min_chars", 40), how.get("bits", ID_BITS))
    links = similar_texts(texts, source, threshold, **how)
    apart = of_text(of_text(links, members, "a", "more_a", "ra"), members, "b", "more_b", "rb").select("ra", "rb", "similarity")
    copies = members.groupBy("doc", "more").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "more")
    copies = of_text(of_text(copies, members, "doc", "more", "ra"), members, "doc", "more", "rb")
    # coalesce keeps a null check from being inferred, which would part this exchange from the shared one
    alike = copies.filter(F.coalesce(F.col("ra") < F.col("rb"), F.lit(False))).select("ra", "rb", F.lit(1.0).alias("similarity"))
    return apart.unionByName(alike).select(
        F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"), "similarity")


def duplicate_groups(df: DataFrame, record: str, columns: list[str], threshold: float = 0.8, **how) -> DataFrame:
    """(record, group, links) of every record: the smallest record of its group, and to how many other texts it is linked.

    Groups are the connected components of the texts' links; the records of one text share a group, and are never paired.
    """
    source = source_texts(df, record, F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    fold_how = how.get("min_chars", 40), how.get("bits", ID_BITS)
    texts = text_tables(source, *fold_how)[0]
    node = lambda doc, more: F.struct(F.col(doc).alias("doc"), F.col(more).alias("more"))
    links = written(similar_texts(texts, source, threshold, **how).select(node("a", "more_a").alias("src"), node("b", "more_b").alias("dst")))
    # a pass of its own, which moves ids and no texts
    members = written(folded_texts(source, *fold_how).select(node("doc", "more").alias("text"), "record").distinct())
    parts = connected_components(members.select("text").distinct(), links, "text")
    degree = (links.select(F.col("src").alias("text")).unionByName(links.select(F.col("dst").alias("text"))).groupBy("text").agg(F.count("*").alias("links")))
    placed = written(members.join(parts.withColumnRenamed("node", "text"), "text").join(degree, "text", "left"))
    first = placed.groupBy("component").agg(F.min("record").alias("group"))
    alone = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record")).distinct().join(placed.select("record"), "record", "left_anti")
    return (placed.join(first, "component").select("record", "group", F.coalesce("links", F.lit(0)).alias("links"))
            .unionByName(alone.select("record", F.col("record").alias("group"), F.lit(0).cast("bigint").alias("links"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sample_clean.parquet")
    found = near_duplicates(rows, "idx", ["question_clean", "answer_clean"], threshold=0.7)
    return found.select(F.col("record_a").alias("idx_a"), F.col("record_b").alias("idx_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group of near-duplicates and its number of links."""
    rows = spark.read.parquet(f"{sf_dir}/sample_clean.parquet")
    return duplicate_groups(rows, "idx", ["question_clean", "answer_clean"], threshold=0.7).withColumnRenamed("record", "idx")
