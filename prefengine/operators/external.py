"""Model calls behind one interface: generate, rank, judge, rewrite, augment.

A ``Model`` maps a list of requests to a list of answers; calls run per partition, a failed request becomes a row with
its error, and what is in the cache is not asked again.  ``EchoModel`` is a deterministic offline stand-in.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def answer(self, request: str) -> str: ...


class EchoModel:
    """Gives back a digest-chosen one of the offered replies, or the request itself."""

    def __init__(self, replies: list[str] | None = None):
        self.replies = replies or []

    def answer(self, request: str) -> str:
        if not self.replies:
            return request
        return self.replies[int(hashlib.sha256(request.encode()).hexdigest(), 16) % len(self.replies)]


@dataclass(frozen=True)
class Retry:
    """Waits grow by a factor of two up to ``most``, with up to ``base`` (at most 1 s) of jitter; a server's wish counts."""

    attempts: int = 3
    base: float = 1.0
    most: float = 30.0

    def wait(self, attempt: int, asked: float | None = None, jitter: float | None = None) -> float:
        if asked is not None:
            return min(self.most, max(0.0, asked))
        extra = random.uniform(0, min(1.0, self.base)) if jitter is None else jitter
        return min(self.most, self.base * 2**attempt) + extra


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only cache."""
    rest = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def ask(requests: DataFrame, key: str, request: str, model: Callable[[], Model], retry: Retry = Retry(),
        threads: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, ok, response, error) of every request; ``model`` makes a client once per task."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()

        def one(text: str) -> tuple[bool, str | None, str | None]:
            for attempt in range(retry.attempts):
                try:
                    return True, client.answer(text), None
                except Exception as x:  # noqa: BLE001 - any failure of a call becomes a row
                    error = f"{type(x).__name__}: {x}"
                    if attempt + 1 < retry.attempts:
                        sleep(retry.wait(attempt, getattr(x, "retry_after", None)))
            return False, None, error

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list(pool.map(one, b[request]))
                yield pd.DataFrame({key: b[key], "ok": [g[0] for g in got], "response": [g[1] for g in got], "error": [g[2] for g in got]})

    return requests.select(key, request).mapInPandas(run, f"`{key}` {kind}, ok boolean, response string, error string")


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashEncoder:
    """An offline stand-in for a sentence encoder: hashed character pairs, unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for i in range(max(1, len(t) - 1)):
                h = int.from_bytes(hashlib.blake2b(t[i:i + 2].encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 32 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def embed(rows: DataFrame, key: str, text: str, encoder: Callable[[], Encoder]) -> DataFrame:
    """(key, vector) of every row; ``encoder`` is made once per task and gets whole batches."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = encoder()
        for b in batches:
            yield pd.DataFrame({key: b[key], "vector": client.encode(["" if t is None else t for t in b[text]])})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<double>")
