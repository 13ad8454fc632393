"""Packed 48-bit key and text-id arrays, the folded text table and the parts that the similarity joins share.

A text is known by 112 bits of a hash of its folded form: ``doc``, 48 bits, travels with the packed keys and only joins;
``more``, 64 further bits, tells texts of one ``doc`` apart wherever texts, records and links meet.  So two texts that
share a ``doc`` both keep their text, both reach the verification and keep their own records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefengine.llm._sketch import mix
from prefengine.llm._text import fold

LOW48 = np.uint64(0xFFFFFFFFFFFF)


#: Bits of ``doc``; tests narrow it to force texts to share one.
ID_BITS = 48


def text_hashes(texts: list[str]) -> np.ndarray:
    """128 bits of each text, as two numbers."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), ">u8").reshape(-1, 2).astype(np.uint64)


def text_hash(texts: list[str], bits: int = ID_BITS) -> np.ndarray:
    return text_hashes(texts)[:, 1] & np.uint64((1 << bits) - 1)


def pack48(a: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, as 6 bytes."""
    return np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def unpack48(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.reshape(-1).view("<u8")


def packed_parts(keys: np.ndarray, docs: np.ndarray, parts: int, more: np.ndarray | None = None, by: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """(part, 12 bytes for each key and text of the part), parts by the key's high bits or by ``by``; ``more``: further bytes of each row."""
    by = keys >> np.uint64(48) if by is None else by
    part = (by % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.uint32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    width = 12 + (0 if more is None else more.shape[1])
    both = np.empty((len(keys), width), np.uint8)
    both[:, :6], both[:, 6:12] = pack48(keys), pack48(docs)
    if more is not None:
        both[:, 12:] = more
    both = both.view(f"V{width}").reshape(-1)[order]
    return [(p, both[cuts[p]:cuts[p + 1]].tobytes()) for p in range(parts) if cuts[p + 1] > cuts[p]]


def unpacked(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return unpacked_more(chunks, 0)[:2]


def unpacked_more(chunks: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, texts and the ``width`` further bytes of each row."""
    rows = np.frombuffer(b"".join(chunks), np.uint8).reshape(-1, 12 + width)
    return unpack48(rows[:, :6]), unpack48(rows[:, 6:12]), rows[:, 12:]


def to_bytes(text: str) -> bytes:
    """Two bytes for most Chinese characters, four for any other; reversible."""
    return text.encode("gb18030", "surrogatepass")


def to_text(data: bytes) -> str:
    return data.decode("gb18030", "surrogatepass")


def fold_batch(b: pa.RecordBatch, min_chars: int) -> tuple[pa.Array, list[str]]:
    """The ids (column 0) and folded texts (column 1) of the rows that are long enough."""
    folded = [fold(t) for t in b.column(1).to_pylist()]
    long = [i for i, t in enumerate(folded) if len(t) >= min_chars]
    return b.column(0).take(pa.array(long, pa.int64())), [folded[i] for i in long]


def source_texts(df: DataFrame, record: str, text: Column) -> DataFrame:
    return df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), text.alias("text"))


def text_tables(source: DataFrame, min_chars: int, bits: int = ID_BITS) -> tuple[DataFrame, DataFrame]:
    """((doc, more, text), (doc, more, record)) of a (record, text) table: each text once, and the records that have it.

    Both come from one exchange by text id: as both use all of its columns, neither is pruned to another one, and the
    texts are folded only once.
    """
    folded = folded_texts(source, min_chars, bits).repartition("doc")
    texts = (folded.groupBy("doc", "more").agg(F.first("text").alias("text"), F.count("record").alias("_n")).filter("_n > 0")
             .select("doc", "more", "text"))
    members = folded.groupBy("doc", "more", "record").agg(F.count("text").alias("_n")).filter("_n > 0").select("doc", "more", "record")
    return texts, members


def folded_texts(source: DataFrame, min_chars: int, bits: int = ID_BITS) -> DataFrame:
    """(doc, more, record, text) of a (record, text) table: text id, record and folded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = fold_batch(b, min_chars)
            h = text_hashes(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array((h[:, 1] & np.uint64((1 << bits) - 1)).astype(np.int64)), pa.array(h[:, 0].view(np.int64)), ids,
                 pa.array(map(to_bytes, texts), pa.binary())],
                names=["doc", "more", "record", "text"])

    # ids are not null, so that no null check of a join parts the exchange of these rows from its reuse
    return source.mapInArrow(run, T.StructType([T.StructField("doc", T.LongType(), False), T.StructField("more", T.LongType(), False),
                                                T.StructField("record", source.schema["record"].dataType), T.StructField("text", T.BinaryType())]))


def of_text(df: DataFrame, members: DataFrame, doc: str, more: str, name: str) -> DataFrame:
    """df with the records (``name``) of the text (doc, more).

    Both sides lie by ``doc`` already; ``more`` is compared as a condition, as a second join key would move them again.
    """
    own = members.select(F.col("doc").alias(doc), F.col("more").alias("_more"), F.col("record").alias(name))
    return df.join(own, doc).filter(F.coalesce(F.col(more) == F.col("_more"), F.lit(False))).drop("_more")


# --- keys of very many texts --------------------------------------------------------------------------------------------

#: Counters of trigrams that are kept; a trigram without one of its own shares it.
_SLOTS = 1 << 15


def gram_numbers(text: str) -> np.ndarray:
    """The distinct trigrams of a folded text, as mixed numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    return np.unique(mix(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]))


def frequent(source: DataFrame, min_chars: int, keys_of, split: int, grams: bool = True, of: int = 64, most: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of more than about ``split`` texts, their texts, how often the trigrams of each slot occur), from every ``of``-th text by hash.

    The counts only choose the way in which the texts of a key are compared, and an order of trigrams that makes a prefix
    filter selective; any counts give the same result.  ``most`` bounds the keys that are broadcast.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(dict.fromkeys(fold_batch(b, min_chars)[1]))
            keys, n = np.unique(keys_of(texts), return_counts=True)
            each = [(gram_numbers(t) % np.uint64(_SLOTS)).astype(np.int64) for t in texts] if grams else []
            slots = np.bincount(np.concatenate([np.zeros(0, np.int64), *each]), minlength=_SLOTS)
            used = np.flatnonzero(slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(keys), bool), np.ones(len(used), bool)])), pa.array(np.concatenate([keys.view(np.int64), used])),
                 pa.array(np.concatenate([n, slots[used]]))], names=["gram", "key", "n"])

    some = source.filter(F.pmod(F.xxhash64("text"), F.lit(of)) == 0)
    counts = (some.mapInArrow(run, "gram boolean, key bigint, n bigint").groupBy("gram", "key").agg(F.sum("n").alias("n"))
              .filter(F.col("gram") | (F.col("n") * of > split)).orderBy("gram", F.desc("n")).limit(most + _SLOTS).collect())
    order = np.zeros(_SLOTS, np.int32)
    for r in counts:
        if r["gram"]:
            order[r["key"]] = r["n"]
    hot = sorted((r["key"] % (1 << 64), r["n"] * of) for r in [r for r in counts if not r["gram"]][:most])
    return np.array([k for k, _ in hot], np.uint64), np.array([n for _, n in hot], np.int64), order


def within(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each key is one of the hot ones."""
    if not len(hot):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def prefix_keys(threshold: float, order: np.ndarray):
    """(key and prefix trigram hashed, doc) of (key, doc, text): texts of one key with S >= threshold share one of these.

    The prefix holds a text's rarest trigrams, so what all texts of a key have in common is no prefix of theirs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hots, docs = [], []
            for key, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grams = gram_numbers(to_text(text))
                grams = grams[np.lexsort((grams, order[(grams % np.uint64(_SLOTS)).astype(np.int64)]))]
                n = len(grams)
                grams = grams[:n - int(np.ceil(threshold * n - 1e-9)) + 1]
                hots.append(mix(grams ^ mix(np.array([key], np.int64).view(np.uint64))))
                docs.append(np.full(len(grams), doc, np.int64))
            if hots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hots).view(np.int64)), pa.array(np.concatenate(docs))], names=["key", "doc"])
    return run
