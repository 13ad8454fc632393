"""Evaluation passages that stand in training text (problem 8): q-gram lemma filtering and banded alignment.

A passage of ``window`` folded characters that occurs in a document with at most ``edits`` edits shares at least
``window + 1 - q * (edits + 1)`` of its q-grams with the region, all on diagonals at most ``edits`` apart (the q-gram
lemma).

1. Every ``step``-th q-gram of a document is looked up among the items' q-grams.  Of the lemma's q-grams, which lie in
   at most ``edits + 1`` intact stretches, at least ``bound`` are then met; ``step`` is the widest one that keeps the
   bound at ``least_hits``.
2. Hits are counted in overlapping diagonal bands, each ``2 * (edits + 1)`` diagonals wide, so that any ``edits + 1``
   neighbouring ones lie in one of them; within a band a region is kept only where ``bound`` hits stand within
   ``window + edits`` characters of the document.  All else is dropped without being read again.
3. What is kept is verified by a banded alignment of ``edits`` edits; with ``edits=0`` that is the exact common run.

Items whose folded texts have at most ``max_index_chars`` characters together (which is counted first) are broadcast,
and each Python worker indexes them once.  Of larger sets only a Bloom filter of ``filter_bits`` bits is broadcast; the
documents' q-grams that pass it are joined with the items' q-grams, hits are counted by document, item, band and region
with SQL aggregates, and only the kept pairs meet with their texts.  Both ways give the same rows.

Defined results: null, empty and short texts (folded shorter than ``window``) match nothing; repeated documents are
reported under each of their ids; repeated items each count; rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.llm._text import fold


class Lemma:
    """The numbers of the filter: step, bound, band and region."""

    def __init__(self, window: int, edits: int, q: int, least_hits: int = 3):
        promised = window + 1 - q * (edits + 1)
        if promised < 1:
            raise ValueError("q is too long for this window and these edits")
        self.window, self.edits, self.q = window, edits, q
        # each intact stretch of g q-grams holds at least (g - step + 1) / step sampled ones
        bounds = {s: -(-(promised - (edits + 1) * (s - 1)) // s) for s in range(1, promised + 1)}
        self.step = max((s for s, b in bounds.items() if b >= min(least_hits, bounds[1])), default=1)
        self.bound = max(1, bounds[self.step])
        self.shift = edits + 1  # each diagonal lies in two bands of 2 * shift diagonals; without edits one is enough
        self.span = window + edits - q  # the places of the first and last hit of a region are at most so far apart

    def bands(self, diagonal: int) -> tuple[int, ...]:
        if not self.edits:
            return (diagonal,)
        band = diagonal // self.shift
        return band, band - 1

    def dense(self, places: list[int]) -> list[int]:
        """Of the rising places of a band's hits those that lie in a region of at least ``bound`` hits."""
        n, bound, span = len(places), self.bound, self.span
        if n < bound:
            return []
        out, first = [], 0
        for i in range(n - bound + 1):
            if places[i + bound - 1] - places[i] <= span:
                out += places[max(first, i):i + bound]
                first = i + bound
        return out


class PassageIndex:
    """The q-grams of a set of folded items, and the search for their passages in a folded document."""

    def __init__(self, items: list[tuple[int, str]], lemma: Lemma):
        self.lemma, q = lemma, lemma.q
        self.items = [(i, t) for i, t in items if len(t) >= lemma.window]
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            for p in range(len(text) - q + 1):
                self.index[text[p:p + q]].append((k, p))
        self.index = dict(self.index)

    def search(self, doc: str) -> list[tuple[int, int, int, int]]:
        """(item id, length of the shared passage, its start in the document, edits): the best region per item."""
        lemma, q, index = self.lemma, self.lemma.q, self.index
        if len(doc) < lemma.window:
            return []
        bands: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at in range(0, len(doc) - q + 1, lemma.step):
            hits = index.get(doc[at:at + q])
            if hits:
                for k, p in hits:
                    for band in lemma.bands(at - p):
                        bands.setdefault((k, band), []).append((at, p))
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[tuple[int, int, int], tuple[int, int, int]] = {}  # a diagonal lies in two bands
        for (k, _), seeds in bands.items():
            if len(seeds) < lemma.bound:
                continue
            kept = set(lemma.dense(sorted({at for at, _ in seeds})))
            done = -1
            for at, p in seeds:
                if at < done or at not in kept:
                    continue
                found = tried.get((k, at, p))
                if found is None:
                    found = tried[k, at, p] = aligned(doc, self.items[k][1], at, p, q, lemma.edits, lemma.window)
                n, start, used = found
                done = start + n - q + 1
                if n >= lemma.window and (k not in best or (n, -used) > (best[k][0], -best[k][2])):
                    best[k] = (n, start, used)
        return [(self.items[k][0], n, start, used) for k, (n, start, used) in best.items()]


def aligned(doc: str, item: str, at: int, p: int, q: int, edits: int, least: int = 0) -> tuple[int, int, int]:
    """(length, start, edits) of the longest region through a seed within the budget, in a band of ``edits`` diagonals.

    Where the side read first leaves no room for a region of ``least`` characters, the other one is not read.
    """
    if not edits:
        back = _common(doc[:at][:-p - 1:-1], item[:p][::-1], 0, 0)
        return back + q + _common(doc, item, at + q, p + q), at - back, 0
    right = _reach(doc[at + q:at + len(item) - p + edits], item[p + q:], edits)
    if right[edits] + q + min(at, p + edits) < least:
        return right[edits] + q, at, edits
    left = _reach(doc[max(0, at - p - edits):at][::-1], item[:p][::-1], edits)
    n, lost, back = max((left[x] + right[y] + q, -(x + y), left[x]) for x in range(edits + 1) for y in range(edits + 1 - x))
    return n, at - back, -lost


def _common(a: str, b: str, i: int, j: int) -> int:
    """How many characters a from i and b from j have in common."""
    start, n, m = i, len(a), len(b)
    while i < n and j < m and a[i] == b[j]:
        if a[i:i + 32] == b[j:j + 32] and i + 32 <= n and j + 32 <= m:
            i, j = i + 32, j + 32
        else:
            i, j = i + 1, j + 1
    return i - start


def _reach(a: str, b: str, e: int) -> list[int]:
    """For 0..e edits the furthest prefix of ``a`` aligned with a prefix of ``b`` (furthest-reaching diagonals)."""
    n, m = len(a), len(b)
    at = {0: _common(a, b, 0, 0)}
    out = [at[0]]
    for _ in range(e):
        then: dict[int, int] = {}
        for d, i in at.items():  # i characters of a against i - d of b
            for dd, ii in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):
                jj = ii - dd
                if ii <= n and 0 <= jj <= m and ii > then.get(dd, -1):
                    while ii < n and jj < m and a[ii] == b[jj]:
                        ii, jj = ii + 1, jj + 1
                    then[dd] = ii
        at = then or at
        out.append(max(out[-1], max(at.values())))
    return out


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                    text: str = "text", window: int = 40, edits: int = 0, q: int = 16, least_hits: int = 3,
                    max_index_chars: int = 2_000_000, filter_bits: int = 1 << 27) -> DataFrame:
    """Rows (doc_id, item_id, shared, start, edits): each document and item that share a passage.

    ``shared`` is the longest shared passage's length in folded characters and ``start`` its place in the folded document.
    """
    lemma = Lemma(window, edits, q, least_hits)
    folded = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text).alias("text")).mapInArrow(_fold_items, "item bigint, folded string")
    folded = folded.filter((F.length("folded") >= window) & F.col("item").isNotNull())
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull())
    total = folded.agg(F.sum(F.length("folded"))).first()[0] or 0
    if total <= max_index_chars:
        held = _Held(docs.sparkSession, [(r[0], r[1]) for r in folded.collect()])
        found = source.mapInArrow(_search(held, lemma), _FOUND)
    else:
        found = _joined(source, folded, lemma, filter_bits)
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "shared", "start", "edits")


_FOUND = "doc bigint, item bigint, shared int, start int, edits int"
_INDEXES: dict[str, object] = {}


class _Held:
    """A value broadcast to the workers, and what each of them makes of it once."""

    def __init__(self, spark: SparkSession, value):
        self.name, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def made(self, make):
        if self.name not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[self.name] = make(self.held.value)
        return _INDEXES[self.name]


def _fold_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(t) for t in b.column(1).to_pylist()], pa.string())], names=["item", "folded"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 3), strict=True)],
                                      names=["doc", "item", "shared", "start", "edits"])


def _search(held: _Held, lemma: Lemma):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.made(lambda items: PassageIndex(items, lemma))
        for b in batches:
            yield _batch([(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t
                          for hit in index.search(fold(t))])
    return run


# --- item sets beyond the broadcast bound -----------------------------------------------------------------------------

def _joined(source: DataFrame, folded: DataFrame, lemma: Lemma, filter_bits: int) -> DataFrame:
    """The same through joins: q-grams that pass a Bloom filter of the items', counted by band and region."""
    grams = folded.mapInArrow(_item_grams(lemma.q), "item bigint, p int, gram bigint")
    words = np.zeros(filter_bits // 8, np.uint8)
    for r in grams.select("gram").coalesce(16).mapInArrow(_bitmap(filter_bits), "bits binary").toLocalIterator():
        words |= np.frombuffer(r[0], np.uint8)
    held = _Held(source.sparkSession, words.tobytes())
    hits = source.mapInArrow(_doc_grams(held, lemma), "doc bigint, at int, gram bigint").join(grams, "gram")
    shift, span = lemma.shift, max(1, lemma.span)
    diagonal = F.floor((F.col("at") - F.col("p")) / F.lit(shift))
    bands = F.array(diagonal, diagonal - 1) if lemma.edits else F.array(F.col("at") - F.col("p"))
    block = F.floor(F.col("at") / F.lit(span))  # any region of the span lies in one of the overlapping pairs of blocks
    dense = (hits.select("doc", "item", "at", F.explode(bands).alias("band")).distinct()
             .select("doc", "item", "band", F.explode(F.array(block, block - 1)).alias("region"))
             .groupBy("doc", "item", "band", "region").agg(F.count("*").alias("n")).filter(F.col("n") >= lemma.bound)
             .select("doc", "item").distinct())
    return (dense.join(source, "doc").join(folded, "item").select("doc", "item", "text", "folded").mapInArrow(_verified(lemma), _FOUND).distinct())


def _gram_hashes(text: str, q: int, step: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(text[p:p + q].encode("utf-8", "surrogatepass")) for p in range(0, len(text) - q + 1, step)], np.uint64).view(np.int64)


def _item_grams(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams = _gram_hashes(text, q, 1)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(grams), pa.int64()), pa.array(np.arange(len(grams), dtype=np.int32)), pa.array(grams)],
                                                 names=["item", "p", "gram"])
    return run


def _bitmap(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])
    return run


def _doc_grams(held: _Held, lemma: Lemma):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.made(lambda x: np.frombuffer(x, np.uint8))
        for b in batches:
            docs, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = fold(text)
                if doc is None or len(text) < lemma.window:
                    continue
                grams = _gram_hashes(text, lemma.q, lemma.step)
                at = grams.view(np.uint64) % np.uint64(8 * len(bits))
                keep = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                docs.append(np.full(len(keep), doc, np.int64))
                places.append((keep * lemma.step).astype(np.int32))
                found.append(grams[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, places, found)], names=["doc", "at", "gram"])
    return run


def _verified(lemma: Lemma):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, text, folded in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(doc, *hit) for hit in PassageIndex([(item, folded)], lemma).search(fold(text))]
            yield _batch(rows)
    return run


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    return leaked_passages(docs, items).select("doc_id", "item_id").distinct()


def p8_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest shared passage of each document and item, two edits allowed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaked_passages(docs, spark.read.parquet(f"{sf_dir}/eval_items.parquet"), edits=2, q=10)
