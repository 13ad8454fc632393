"""Records of one split that occur again in another (problem 3): winnowing fingerprints.

1. Each record's turns are joined and folded; of every window of ``window`` successive k-mer hashes the smallest is a
   fingerprint, so any common run of ``window + k - 1`` characters gives a common fingerprint (winnowing).
2. Fingerprints travel packed, by fingerprint, each with its text's number of distinct trigrams and a parity sketch:
   ``_BITS`` bits, each the parity of how many of the text's trigrams hash to it.
3. A held-out text meets every training text that shares a fingerprint, however many have it.  Two texts of
   S >= ``threshold`` differ in at most (1 - threshold) / (1 + threshold) of both texts' trigrams, and every bit in
   which the sketches differ is caused by another differing trigram; so a pair with more such bits is dropped without
   loss.  ``rare`` only chooses the way: fingerprints of more training texts are compared block by block.  The training
   texts of a fingerprint that a sample shows to have more than ``split`` of them are cut into slices by their hash, and
   its held-out texts visit every slice, so no task holds them all.
4. Candidates are verified on whole texts.  S >= ``threshold`` decides; of what is kept, the common fingerprints are
   chained where they are collinear, the chain is extended by alignment (the seeds to their full common runs, the gaps
   between them by a banded alignment), and the report gives the characters that come out aligned on either side.

Defined results: null or empty conversations, null values and short texts give no row; turns of the role ``system``
are left out, a null role is not ``system``; a record loaded twice is one record; records of equal text each come out;
an empty table gives an empty result; texts are used whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.llm._packed import ID_BITS, fold_batch, frequent, of_text, packed_parts, source_texts, text_hash, text_tables, to_text, unpacked_more, within
from prefengine.llm._sketch import kmer_hashes, mix
from prefengine.llm._text import trigrams


def _slide(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every ``width`` successive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = f(a[:-step], a[step:])
        done += step
    return a


def winnow(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, number of its text, place) of all texts; a text shorter than a window keeps its smallest k-mer."""
    h, owner, place = kmer_hashes(texts, k)
    if not len(h):
        return h, owner, place
    count = np.bincount(owner, minlength=len(texts))
    low = np.zeros(max(0, len(h) - window + 1), np.uint64)
    if len(low):
        low = np.where(owner[:len(low)] == owner[window - 1:], _slide(h, window, np.minimum), np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    chosen = _slide(np.concatenate([edge, low, edge]), window, np.maximum)[:len(h)] == h if len(low) else np.zeros(len(h), bool)
    short = (count > 0) & (count < window)
    if short.any():
        start = np.cumsum(count) - count
        for i in np.flatnonzero(short):
            chosen[start[i] + int(np.argmin(h[start[i]:start[i] + count[i]]))] = True
    return h[chosen], owner[chosen], place[chosen]


_BITS = 192


def distinct_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram as a number, number of its text): each text's distinct trigrams."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(0, len(codes) - 2)
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    inside = owner == np.repeat(np.arange(len(texts)), size)[2:]
    used = np.zeros(0x110000, bool)
    used[codes] = True
    letters = np.flatnonzero(used).astype(np.uint64)
    bits = max(1, int(len(letters)).bit_length())
    if 3 * bits + len(texts).bit_length() > 64:  # too many letters for one number: halves, down to single texts
        if len(texts) == 1:
            grams = np.unique(_gram(*(codes[i:n + i].astype(np.uint64) for i in range(3))))
            return grams, np.zeros(len(grams), np.int64)
        half = len(texts) // 2
        (g, o), (h, p) = distinct_trigrams(texts[:half]), distinct_trigrams(texts[half:])
        return np.concatenate([g, h]), np.concatenate([o, p + half])
    rank = (np.cumsum(used) - 1).astype(np.uint64)[codes]
    b = np.uint64(bits)
    key = owner.astype(np.uint64)
    for i in range(3):
        key = key << b | rank[i:n + i]
    key = np.sort(key[inside])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    low = np.uint64((1 << bits) - 1)
    return (_gram(letters[key >> b + b & low], letters[key >> b & low], letters[key & low]),
            (key >> np.uint64(3 * bits)).astype(np.int64))


def _gram(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a << np.uint64(42) | b << np.uint64(21) | c


def parity_sketches(texts: list[str]) -> np.ndarray:
    """Of each text 4 bytes of its number of distinct trigrams and ``_BITS`` / 8 bytes of their parity sketch."""
    grams, owner = distinct_trigrams(texts)
    size = np.bincount(owner, minlength=len(texts)).astype("<u4")
    bit = (mix(grams) % np.uint64(_BITS)).astype(np.int64)
    odd = np.bincount(owner * _BITS + bit, minlength=len(texts) * _BITS).reshape(-1, _BITS) & 1
    return np.concatenate([size.view(np.uint8).reshape(-1, 4), np.packbits(odd.astype(np.uint8), axis=1)], axis=1)


def _packed_keys(min_chars: int, k: int, window: int, parts: int, held: bool, hot: np.ndarray, slices: np.ndarray, bits: int):
    """(part, held, packed): the fingerprints of each text, with the text's sketch; those of hot ones by slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(dict.fromkeys(fold_batch(b, min_chars)[1]))
            if not texts:
                continue
            h, owner, _ = winnow(texts, k, window)
            docs, by, far = text_hash(texts, bits)[owner], h >> np.uint64(48), within(h, hot)
            if far.any():
                many = np.ones(len(h), np.int64)
                many[far] = slices[np.searchsorted(hot, h[far])]
                if held:  # a visit to every slice
                    at = np.repeat(np.arange(len(h)), many)
                    part = (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
                    h, owner, docs, by, far = h[at], owner[at], docs[at], by[at], far[at]
                else:
                    part = mix(docs) % many.astype(np.uint64)
                by = np.where(far, mix(h ^ mix(part + np.uint64(1))), by)
            rows = packed_parts(h, docs, parts, parity_sketches(texts)[owner], by)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([held] * len(rows), pa.bool_()),
                 pa.array([r[1] for r in rows], pa.binary())], names=["part", "held", "packed"])
    return run


def _side(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, texts, trigrams, sketches) by fingerprint, each text once for a fingerprint."""
    keys, docs, more = unpacked_more(chunks, 4 + _BITS // 8)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    more = more[order]
    # copies of a text meet here
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | (more[1:] != more[:-1]).any(axis=1)
    more = more[new]
    size = np.ascontiguousarray(more[:, :4]).view("<u4").reshape(-1).astype(np.int64)
    return keys[new], docs[new], size, np.ascontiguousarray(more[:, 4:]).view("<u8")


def _near(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts of a and b trigrams, with sketches x and y, can have S >= threshold."""
    differ = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for i in range(1, x.shape[-1]):
        differ += np.bitwise_count(x[..., i] ^ y[..., i])
    # the difference in size is one of trigrams, too
    most = (a + b) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (differ <= most) & (np.abs(a - b) <= most)


def _same_key(rare: int, threshold: float):
    """(v, t) for each held-out and training text that share a key and can have S >= threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: tuple[list[bytes], ...] = ([], [])
        for b in batches:
            for held, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                chunks[held].append(packed)
        known, texts, size, sketch = _side(chunks[False])
        keys, docs, held_size, held_sketch = _side(chunks[True])
        low = np.searchsorted(known, keys, "left")
        count = np.searchsorted(known, keys, "right") - low
        found = [np.zeros((0, 2), np.int64)]
        few = np.flatnonzero((count > 0) & (count <= rare))
        for at in range(0, len(few), 50_000):
            some = few[at:at + 50_000]
            i, j = np.repeat(some, count[some]), _spread(low[some], count[some])
            ok = _near(held_size[i], size[j], held_sketch[i], sketch[j], threshold)
            found.append(np.stack([docs[i[ok]], texts[j[ok]]], 1).astype(np.int64))
        many = np.flatnonzero(count > rare)
        starts = many[np.concatenate([[True], keys[many[1:]] != keys[many[:-1]]])] if len(many) else many
        waiting = 0
        for s, e in zip(starts.tolist(), np.searchsorted(keys, keys[starts], "right").tolist(), strict=True):
            first, last = int(low[s]), int(low[s] + count[s])
            for at in range(first, last, 4_096):
                t = slice(at, min(last, at + 4_096))
                for start in range(s, e, 256):
                    v = slice(start, min(e, start + 256))
                    i, j = np.nonzero(_near(held_size[v, None], size[None, t], held_sketch[v, None], sketch[None, t], threshold))
                    if len(i):
                        found.append(np.stack([docs[v][i], texts[t][j]], 1).astype(np.int64))
                        waiting += len(i)
                if waiting > 2_000_000:  # a pair that shares several keys is kept once
                    found, waiting = [_distinct(np.concatenate(found))], 0
        yield from _pairs(np.concatenate(found))
    return run


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (count of them) for each."""
    return np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _distinct(both: np.ndarray) -> np.ndarray:
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    return both[new]


def _pairs(both: np.ndarray) -> Iterator[pa.RecordBatch]:
    both = _distinct(both)
    for at in range(0, len(both), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(both[at:at + 50_000, i]) for i in (0, 1)], names=["v", "t"])


def collinear_chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seeds (place in a, place in b) that rises in both texts."""
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    where: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, b) in enumerate(seeds):
        at = bisect_left(tails, b)
        back[i] = where[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            where.append(i)
        else:
            tails[at], where[at] = b, i
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def chain_coverage(a: str, b: str, k: int, window: int) -> tuple[float, float]:
    """Shares of a's and of b's characters that the alignment along their collinear common fingerprints pairs."""
    h, owner, place = winnow([a, b], k, window)
    at: dict[int, list[int]] = {}
    for x, p in zip(h[owner == 1].tolist(), place[owner == 1].tolist(), strict=True):
        at.setdefault(x, []).append(p)
    seeds = [(p, q) for x, p in zip(h[owner == 0].tolist(), place[owner == 0].tolist(), strict=True) for q in at.get(x, [])]
    covered, end_a, end_b = 0, 0, 0
    for p, q in collinear_chain(seeds):
        if p < end_a or q < end_b:
            continue
        i, j = p, q
        while i > end_a and j > end_b and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        p, q = p + k, q + k
        while p < len(a) and q < len(b) and a[p] == b[q]:
            p, q = p + 1, q + 1
        covered += p - i + gap_matches(a[end_a:i], b[end_b:j])
        end_a, end_b = p, q
    if seeds:
        covered += gap_matches(a[end_a:], b[end_b:])
    return covered / max(1, len(a)), covered / max(1, len(b))


def gap_matches(a: str, b: str, band: int = 16) -> int:
    """The most characters of two gaps that pair in order, within ``band`` diagonals of the way between their ends."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    n, m = len(a), len(b)
    low, high = min(0, m - n) - band, max(0, m - n) + band  # places in b less places in a
    last: dict[int, int] = {}
    for i, x in enumerate(a):
        row: dict[int, int] = {}
        best = 0
        for j in range(max(0, i + low), min(m, i + high + 1)):
            best = max(last.get(j, 0), best, (last.get(j - 1, 0) + 1) if x == b[j] else 0)
            row[j] = best
        # beyond the band a row goes on as it ended
        last = row if row else last
    return max(last.values(), default=0)


def _verified(threshold: float, k: int, window: int, coverage: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: bytes | None = None
        mine: set[str] = set()
        for b in batches:
            keep, rows = [], []
            for i, (text_v, text_t) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if text_t != last:
                    last, mine = text_t, trigrams(to_text(text_t))
                n, theirs = len(mine), trigrams(to_text(text_v))
                m = len(theirs)
                if min(n, m) < threshold * max(n, m) - 1e-9:
                    continue
                common = len(mine & theirs)
                s = common / (n + m - common)
                if s >= threshold - 1e-12:
                    keep.append(i)
                    rows.append((s, *(chain_coverage(to_text(text_v), to_text(text_t), k, window) if coverage else (None, None))))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(keep, pa.int64())) for i in range(4)], *[pa.array(c, pa.float64()) for c in columns]],
                                             names=["v", "more_v", "t", "more_t", "similarity", "coverage_val", "coverage_train"])
    return run


def conversation_text(turns: str = "conversations") -> Column:
    """The values of all turns but system ones, in order, without a separator."""
    spoken = F.filter(F.col(turns), lambda x: x.isNotNull() & ~x["from"].eqNullSafe("system"))
    return F.array_join(F.transform(spoken, lambda x: F.coalesce(x["value"], F.lit(""))), "")


def split_overlaps(train: DataFrame, held: DataFrame, record: str, text: Column, threshold: float = 0.8,
                   min_chars: int = 40, k: int = 8, window: int = 16, rare: int = 16, split: int = 20_000,
                   coverage: bool = True, bits: int = ID_BITS) -> DataFrame:
    """(train_id, val_id, similarity, coverage_val, coverage_train) of all overlapping records of the two tables.

    Without ``coverage`` the two shares are null, and nothing is chained or aligned for them.
    """
    spark = train.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = [source_texts(x, record, text) for x in (train, held)]
    (texts_t, members_t), (texts_v, members_v) = (text_tables(x, min_chars, bits) for x in sources)
    hot, texts_of, _ = frequent(sources[0], min_chars, lambda x: winnow(x, k, window)[0], split, grams=False)
    slices = -(-texts_of // max(1, split))
    keyed = [x.mapInArrow(_packed_keys(min_chars, k, window, parts, is_held, hot, slices, bits), "part int, held boolean, packed binary")
             for x, is_held in zip(sources, (False, True), strict=True)]
    packed = keyed[0].unionByName(keyed[1]).repartitionById(parts, "part")
    candidates = packed.mapInArrow(_same_key(rare, threshold), "v bigint, t bigint")
    own, theirs = (x.select(F.col("doc").alias(d), F.col("more").alias(f"more_{d}"), F.col("text").alias(f"text_{d}")) for x, d in ((texts_v, "v"), (texts_t, "t")))
    links = (candidates.repartition("v").distinct().join(own, "v").join(theirs, "t").select("v", "more_v", "t", "more_t", "text_v", "text_t")
             .mapInArrow(_verified(threshold, k, window, coverage),
                         "v bigint, more_v bigint, t bigint, more_t bigint, similarity double, coverage_val double, coverage_train double"))
    return (of_text(of_text(links, members_v, "v", "more_v", "val_id"), members_t, "t", "more_t", "train_id")
            .select("train_id", "val_id", "similarity", "coverage_val", "coverage_train"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = spark.read.parquet(f"{sf_dir}/sft_train.parquet").select("id", "conversations")
    held = spark.read.parquet(f"{sf_dir}/sft_val.parquet").select("id", "conversations")
    return split_overlaps(train, held, "id", conversation_text(), threshold=0.7, coverage=False).select("train_id", "val_id")


def overlap_counts(links: DataFrame, train: DataFrame, held: DataFrame, record: str, split: str, source: str) -> DataFrame:
    """(split, source, train_source, records, pairs, coverage): held-out records that occur in each training source."""
    theirs = train.select(F.col(record).alias("train_id"), F.col(source).alias("train_source")).filter("train_id is not null").dropDuplicates(["train_id"])
    ours = held.select(F.col(record).alias("val_id"), F.col(split).alias("split"), F.col(source).alias("source")).filter("val_id is not null").dropDuplicates(["val_id"])
    return (links.join(theirs, "train_id").join(ours, "val_id").groupBy("split", "source", "train_source")
            .agg(F.countDistinct("val_id").alias("records"), F.count("*").alias("pairs"), F.round(F.avg("coverage_val"), 6).alias("coverage")))


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps counted by split and by the sources of both sides."""
    train = spark.read.parquet(f"{sf_dir}/sft_train.parquet").select("id", "conversations", "source")
    held = spark.read.parquet(f"{sf_dir}/sft_val.parquet").select("id", "conversations", "source", "split")
    return overlap_counts(split_overlaps(train, held, "id", conversation_text(), threshold=0.7), train, held, "id", "split", "source")
