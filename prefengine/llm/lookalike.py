"""Visually identical text with different characters (problem 4).

A token is a run of characters without blanks and sentence marks.  Texts are cut into tokens a column at a time, and the
rare work runs once per distinct spelling of a batch:

1. ``Sight`` holds the costs of a weighted edit automaton: ignorable characters (zero-width, soft hyphen, joiners,
   byte-order marks, variation selectors) are deleted at cost 0, look-alikes (full-width forms, compatibility
   ideographs and radicals, Cyrillic and Greek twins of Latin letters, hyphen forms) are substituted at cost 0, every
   other deletion, insertion and substitution costs ``VISIBLE``.  Accents are characters of their own (canonical
   decomposition), so composed and combining ones meet.
2. A trie holds the vocabulary: the ``most`` most frequent tokens seen at least ``least`` times (a stated bound on what
   is broadcast; it only decides which spelling of a look is called canonical).  The automaton traverses the trie with
   a token; of the words it reaches within ``budget`` the cheapest, then the most frequent one is the canonical
   spelling.  The operator's budget is 0: any visible difference must stay.
3. Tokens that reach no word are normalised by the table of looks alone.

A look whose spellings are in the vocabulary comes out as its most frequent spelling, any other as its table form, so
tokens that look the same get one form and others do not, whatever the vocabulary holds.

Kept apart: letter case, raised and circled digits, emoji, broken characters, and every other visible mark.  Runs of
blanks of any kind are one space, outer ones are dropped.

Defined results: null stays null, a text of blanks and ignorables becomes ''; very long tokens are read whole (at budget
0 the automaton keeps one state for each spelling of the look read so far); an empty table gives an empty result; a row
loaded twice is one row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that look like a Latin letter in common type, each with its twin.
TWINS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ғ": "F", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w", "һ": "h",
    "ԁ": "d", "ѵ": "v", "ӏ": "l", "ү": "y", "ɡ": "g",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ϲ": "c", "ϳ": "j", "ρ": "p",
    # Armenian
    "օ": "o", "ս": "u", "Տ": "S", "Օ": "O",
    # hyphens
    "‐": "-", "‑": "-", "﹣": "-", "－": "-",
    # quotes and marks of one shape
    "ʼ": "’", "＇": "'", "｡": "。", "､": "、", "｢": "「", "｣": "」", "･": "・", "∶": ":", "꞉": ":", "ǃ": "!",
}
_IGNORED = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
#: Blanks as a pattern of Spark and Python alike.
BLANK = "[\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_PLAIN = re.compile("[!-~一-鿿。、，：；！？（）“”‘’《》【】…—～·À-ÖØ-öø-ÿ]*")


#: Marks that end a token, in any width; each is a token of its own.
_MARKS = "，。、；：！？,.;:!?｡､"
#: Full-width marks and brackets whose plain form is the table's.
_WIDE = {ord(a): b for a, b in zip("，：；！？（）～", ",:;!?()~", strict=True)}
#: The cost of an edit that a reader sees.
VISIBLE = 1.0


@cache
def seen_as(c: str) -> str:
    """What one character looks like: '' for ignorables, its twin or compatibility form, itself for a visible variant."""
    if _IGNORED.match(c):
        return ""
    if c in TWINS:
        return TWINS[c]
    kind = unicodedata.decomposition(c).partition(">")[0].lstrip("<") if unicodedata.decomposition(c).startswith("<") else None
    if kind in ("wide", "narrow", "noBreak", "compat") and unicodedata.category(c) != "No":
        form = unicodedata.normalize("NFKC", c)
        # spacing accents, ligature-like and parenthesised symbols would decompose into more than they show
        if len(form) == 1:
            c = TWINS.get(form, form)
    return _WIDE.get(ord(c), c)


def table_form(token: str) -> str:
    """A token normalised by the table alone: ignorables dropped, look-alikes replaced, accents composed."""
    if _PLAIN.fullmatch(token):
        return token.translate(_WIDE)
    looks = "".join(map(seen_as, unicodedata.normalize("NFD", token)))
    return unicodedata.normalize("NFC", "".join(map(seen_as, unicodedata.normalize("NFD", looks))))


class Sight:
    """The costs of the edit automaton, for the characters of a vocabulary."""

    def __init__(self, letters: set[str]):
        self.twins: dict[str, list[str]] = {}
        for x in sorted(letters):
            self.twins.setdefault(seen_as(x), []).append(x)
        #: What a character becomes at cost 0: vocabulary characters, or nothing at all (None).
        self.free: dict[str, list[str] | None] = {}

    def alike(self, c: str) -> list[str]:
        """The vocabulary's characters that c is substituted by at cost 0."""
        return self.twins.get(seen_as(c), [])

    def freely(self, c: str) -> list[str] | None:
        if c not in self.free:
            self.free[c] = self.alike(c) if seen_as(c) else None
        return self.free[c]

    @staticmethod
    def gap(c: str) -> float:
        """The cost of deleting or inserting c."""
        return VISIBLE if seen_as(c) else 0.0

    @staticmethod
    def swap(c: str, x: str) -> float:
        return 0.0 if seen_as(c) == seen_as(x) else VISIBLE


class SpellingTrie:
    """A trie of vocabulary words, most frequent first, traversed by the weighted edit automaton."""

    def __init__(self, words: list[str]):
        self.words = words
        self.kids: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        for rank, word in enumerate(words):
            node = 0
            for c in unicodedata.normalize("NFD", word):
                child = self.kids[node].get(c)
                if child is None:
                    child = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.word.append(-1)
                node = child
            if self.word[node] < 0:
                self.word[node] = rank
        self.sight = Sight({c for kids in self.kids for c in kids})
        #: The words' own canonical spellings, and later those of other tokens: remembered only, results do not depend on it.
        self.known = {word: self._free_match(word) for word in words}

    def _free_match(self, token: str) -> str | None:
        """``match`` at budget 0, where every state costs 0."""
        kids, free, freely = self.kids, self.sight.free, self.sight.freely
        nodes = [0]
        for c in unicodedata.normalize("NFD", token):
            alike = free[c] if c in free else freely(c)
            if alike is None:
                continue
            nodes = [child for node in nodes for x in alike if (child := kids[node].get(x)) is not None]
            if not nodes:
                return None
        ends = [self.word[node] for node in nodes if self.word[node] >= 0]
        return self.words[min(ends)] if ends else None

    def match(self, token: str, budget: float = 0.0) -> str | None:
        """The vocabulary word that the token reaches at least cost, of equals the most frequent; None beyond ``budget``."""
        if budget < VISIBLE:
            return self._free_match(token)
        sight, kids = self.sight, self.kids
        states = self._inserted({0: 0.0}, budget)
        for c in unicodedata.normalize("NFD", token):
            gap, alike = sight.gap(c), sight.alike(c)
            then: dict[int, float] = {}
            for node, cost in states.items():
                if cost + gap <= budget and cost + gap < then.get(node, budget + 1):
                    then[node] = cost + gap
                for x in alike if cost + VISIBLE > budget else kids[node]:
                    child = kids[node].get(x)
                    if child is not None and (total := cost + sight.swap(c, x)) <= budget and total < then.get(child, budget + 1):
                        then[child] = total
            states = self._inserted(then, budget)
            if not states:
                return None
        ends = [(cost, self.word[node]) for node, cost in states.items() if self.word[node] >= 0]
        return self.words[min(ends)[1]] if ends else None

    def _inserted(self, states: dict[int, float], budget: float) -> dict[int, float]:
        """The states with those that insertions of vocabulary characters reach; vocabulary words hold no ignorables."""
        open_ = sorted(states.items(), key=lambda s: s[1])
        for node, cost in open_:
            for x, child in self.kids[node].items():
                total = cost + self.sight.gap(x)
                if total <= budget and total < states.get(child, budget + 1):
                    states[child] = total
                    open_.append((child, total))
        return states

    def canonical(self, token: str) -> str:
        """The canonical spelling of a token: a vocabulary word, else the table's form."""
        found = self.known.get(token)
        if found is not None:
            return found
        found = self._looked_up(token)
        if len(self.known) < 200_000 and len(token) <= 64:
            self.known[token] = found
        return found

    def _looked_up(self, token: str) -> str:
        if token in _MARKS or not token:
            return table_form(token)
        found = self.match(token)
        if found is None:
            form = table_form(token)
            # marks in another order are put right by the table only
            found = form if form == token else self.match(form) or form
        return found


#: The same blanks as ``BLANK`` in the syntax of Arrow's expressions.
_BLANKS = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Texts of more bytes are cut in halves before they are worked on together.
_BYTES = 64_000_000


def cut_tokens(texts: pa.Array) -> pa.ListArray:
    """The tokens, marks and single spaces of every text, in order; null is no token."""
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), _BLANKS, " ")
    return pc.split_pattern(pc.replace_substring_regex(texts, f"([ {_MARKS}])", "\x1f\\1\x1f"), "\x1f")


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    if len(texts) > 1 and texts.nbytes > _BYTES:
        half = len(texts) // 2
        yield from _pieces(pa.concat_arrays([texts[:half]]))
        yield from _pieces(pa.concat_arrays([texts[half:]]))
    else:
        yield texts


def one_spelling(texts: pa.Array, trie: SpellingTrie) -> pa.Array:
    """Every text in one form."""
    done = []
    for piece in _pieces(texts):
        parts = cut_tokens(piece)
        spelt = parts.flatten().dictionary_encode()
        forms = pa.array([trie.canonical(t) for t in spelt.dictionary.to_pylist()], pa.string())
        out = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, forms.take(spelt.indices)), "")
        out = pc.utf8_trim(pc.replace_substring_regex(out, "  +", " "), " ")
        done.append(pc.if_else(pc.is_valid(piece), out, pa.scalar(None, pa.string())))
    return pa.concat_arrays(done)


def spellings(df: DataFrame, columns: list[str], least: int = 3, most: int = 50_000, longest: int = 40) -> list[str]:
    """The bounded vocabulary: repeated tokens of at most ``longest`` characters, most frequent first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in (x for c in b.columns for x in _pieces(c)):
                spelt = cut_tokens(piece).flatten().dictionary_encode()
                counts = np.bincount(spelt.indices.to_numpy(), minlength=len(spelt.dictionary)).astype(np.int64)
                fit = [i for i, t in enumerate(spelt.dictionary.to_pylist()) if 0 < len(t) <= longest and t not in _MARKS and t != " " and not _IGNORED.search(t)]
                yield pa.RecordBatch.from_arrays([spelt.dictionary.take(pa.array(fit, pa.int64())), pa.array(counts[fit], pa.int64())], names=["token", "n"])

    counts = df.select(*columns).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return [r[0] for r in counts.orderBy(F.desc("n"), "token").limit(most).collect()]


_TRIES: dict[str, SpellingTrie] = {}


class Vocabulary:
    """Words broadcast to the workers; each makes their trie once."""

    def __init__(self, spark: SparkSession, words: list[str]):
        self.name, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(words)

    def trie(self) -> SpellingTrie:
        if self.name not in _TRIES:
            _TRIES.clear()
            _TRIES[self.name] = SpellingTrie(self.held.value)
        return _TRIES[self.name]


def one_form(df: DataFrame, columns: list[str], least: int = 3, most: int = 50_000) -> DataFrame:
    """df with every text column in one form; rows that look the same get equal texts, others do not."""
    words = Vocabulary(df.sparkSession, spellings(df, columns, least, most))

    @F.pandas_udf("string")
    def consistent(texts):
        return pd.Series(one_spelling(pa.array(texts.tolist(), pa.string()), words.trie()).to_pylist(), index=texts.index)

    return df.withColumns({c: consistent(F.col(c)) for c in columns})


def _digests(columns: list[pa.Array]) -> pa.Array:
    """128 bits of each row's texts."""
    import xxhash

    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    return pa.array([xxhash.xxh3_128_digest("\x1f".join(f"{len(t)} {t}" for t in row).encode("utf-8", "surrogatepass")) for row in rows], pa.binary())


def look_alikes(df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """(record_a, record_b): records without nulls whose columns all look the same while one differs in code points."""
    # names of our own, whatever the columns of the input are called
    own = [f"_c{i}" for i in range(len(columns))]
    rows = df.select(F.col(record).alias("r"), *[F.col(c).alias(n) for c, n in zip(columns, own, strict=True)]).dropna()
    words = Vocabulary(df.sparkSession, spellings(rows, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = words.trie()
        for b in batches:
            raw = b.columns[1:]
            yield pa.RecordBatch.from_arrays([b.column(0), _digests(raw), _digests([one_spelling(c, trie) for c in raw])], names=["r", "_raw", "_seen"])

    # not null, so that no null check parts the exchange below from its reuse
    kinds = T.StructType([T.StructField("r", rows.schema["r"].dataType, False), T.StructField("_raw", T.BinaryType(), False), T.StructField("_seen", T.BinaryType(), False)])
    same = rows.mapInArrow(run, kinds)
    # one exchange, balanced by record, is reused by all that follows, so texts are normalised once
    same = same.repartition(F.col("_seen"), F.col("r")).distinct()
    # a look has pairs only where it has two spellings; copies of one spelling are never paired with each other
    looks = same.groupBy("_seen").agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).filter("lo != hi").select("_seen")
    mixed = same.join(looks, "_seen")
    a, b = (mixed.select("_seen", F.col("r").alias(f"r{i}"), F.col("_raw").alias(f"raw{i}")) for i in "ab")
    ways = mixed.select("_seen", "_raw").distinct()
    ways = (ways.withColumnRenamed("_raw", "rawa").join(ways.withColumnRenamed("_raw", "rawb"), "_seen")
            .filter(F.col("rawa") < F.col("rawb")))
    return (ways.join(a, ["_seen", "rawa"]).join(b, ["_seen", "rawb"])
            .select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/sample_raw.parquet")
    return look_alikes(rows, "idx", ["question_raw", "answer_raw"]).select(
        F.col("record_a").alias("idx_a"), F.col("record_b").alias("idx_b"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its texts in one form."""
    rows = spark.read.parquet(f"{sf_dir}/sample_raw.parquet").select("idx", "question_raw", "answer_raw")
    return one_form(rows, ["question_raw", "answer_raw"])
