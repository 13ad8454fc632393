"""Corpus encoding with a public byte-level BPE vocabulary (problem 7).

The encoder is exact and linear: a byte automaton lists every vocabulary token that occurs in a piece, the longest
token at each position is tried first, and a compatibility test on neighbouring tokens (would BPE ever have left these
two side by side?) drives backtracking.  The result equals applying the merges in rank order, without a merge queue.
Decoding gathers token bytes through an offset table.

Defined results: null and empty texts give an empty list; blank texts have their own ids; strings that look like
special tokens are ordinary text; one row per input row; lone surrogates cannot occur in Spark strings; every other
column of the input is carried along only when asked for.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Distinct pieces whose ids a Python worker remembers; only a memory bound, results do not depend on it.
CACHE_PIECES = 400_000


def default_vocabulary() -> str:
    """Place of byte_bpe_50k in the public tokenizer files; any other file of ranks may be given instead."""
    try:
        import public_tokenizers as public

        return public.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class BacktrackingEncoder:
    """Byte-pair encoder over a vocabulary of ranks (token id = merge rank)."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.single = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.single.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        # the token that a token backs off to: its longest proper prefix in the vocabulary (-1: none)
        self.shorter = [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for n in range(len(t) - 1, 0, -1):
                if (j := self.id_of.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(t) for t in tokens]
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        self.fits: dict[int, bool] = {}
        self._learn_splits()
        self.fits.clear()
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[str, bytes] = {}
        size = np.array(self.length, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _learn_splits(self) -> None:
        """For each token the two earlier tokens whose merge makes it, in rank order."""
        for i, t in enumerate(self.tokens):
            if len(t) < 2:
                continue
            for n in range(1, len(t)):
                a, b = self.id_of.get(t[:n]), self.id_of.get(t[n:])
                if a is None or b is None or a >= i or b >= i:
                    continue
                if self._stands(a, b):
                    self.pair[a, b] = i
                    self.split[i] = (a, b)
                    break

    def _stands(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side: no merge across their border comes before either is built.

        Walks down the merges along the border, latest first; at every level the two tokens that touch there existed
        together, so an earlier-ranked merge of the two would have been taken.
        """
        pair, split = self.pair, self.split
        bound = len(self.tokens) + 1
        while True:
            merged = pair.get((left, right))
            if merged is not None and merged < bound:
                return False
            if left > right:
                bound = left
                left = split[left][1]
                if left == bound:  # a single byte: undo the right side instead
                    bound = right + 1
                    right = split[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound = right + 1
                right = split[right][0]
                if right + 1 == bound:
                    bound = left
                    left = split[left][1]
                    if left == bound:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece (a run that merges never cross)."""
        text = piece.encode("utf-8").decode("latin-1")
        whole = self.single.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [(0, -1)] * n
        for end, found in self.automaton.iter(text):
            start = end - found[0] + 1
            if found > longest[start]:
                longest[start] = found
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0][1]
        length, shorter, fits, width = self.length, self.shorter, self.fits, len(self.tokens)
        while True:
            end = at + length[token]
            good = not dead[end]
            if good and out:
                key = out[-1] * width + token
                good = fits.get(key)
                if good is None:
                    if len(fits) > 1_000_000:
                        fits.clear()
                    good = fits[key] = self._stands(out[-1], token)
            if good:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at][1]
                continue
            token = shorter[token]
            while token < 0:  # no token starts here: this border can't be one
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def packed(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            found = np.array(self.encode_piece(piece), np.int32).tobytes()
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known = self.known
        parts = self.pieces(text)
        try:
            return np.frombuffer(b"".join([known[p] for p in parts]), np.int32)
        except KeyError:
            return np.frombuffer(b"".join([self.packed(p) for p in parts]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.bytes[where].tobytes().decode("utf-8", errors="replace")


@cache
def encoder(path: str) -> BacktrackingEncoder:
    """The encoder of a vocabulary file of lines ``base64 rank``."""
    return _encoder(Path(path).read_bytes())


@cache
def _encoder(lines: bytes) -> BacktrackingEncoder:
    """One per Python worker and vocabulary."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return BacktrackingEncoder(tokens)


def _sent(df: DataFrame, vocabulary: str | None):
    """The vocabulary file, read by the driver and broadcast; executors need not have it."""
    return df.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_bytes())


def encode_corpus(df: DataFrame, text: str = "text", keep: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``ids`` (a list of integers) of every row; map-only, no shuffle."""
    lines = _sent(df, vocabulary)
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(lines.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, max(1, batch.num_rows), 1000):  # a few thousand texts' ids at a time
                some = texts.slice(at, 1000)
                ids = [coder.encode(t) for t in some.to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1000), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=[keep, "ids"])

    return df.select(keep, text).mapInArrow(run, f"`{keep}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, ids: str = "ids", keep: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``text``: the inverse of ``encode_corpus``; null lists and lists of no ids give ''."""
    lines = _sent(df, vocabulary)
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(lines.value)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[keep, "text"])

    return df.select(keep, ids).mapInArrow(run, f"`{keep}` {kind}, text string")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
