"""Subject areas of documents (problem 9): classifier chains over term, source and structure features.

Training (on the driver, from at most ``max_labelled`` labelled documents, chosen by hash):

1. Terms (character n-grams of ideographs, words and word pairs of other scripts) are counted by sentence under the
   labels of their document; a term that one subject owns by ``purity`` becomes evidence for it.  A second pass counts
   each sentence under the one label its evidence speaks for, so documents of several subjects teach too and passing
   mentions do not.
2. A document's features for a subject: share and number of its sentences that speak for the subject (the sum of
   evidence decides), whether only one does, how many sentences there are; its source; the other subjects' labels.
3. A logistic model of the features, fitted out of fold (so it is calibrated), is the offset of a chain: the model of
   each subject adds the source and the labels of the subjects before it, shrunk towards no effect.

A subject of the subject table that has no label yet is told by the words of its title, with the shared model and no
chain of its own; labels that the table does not name are no subjects.

Decoding keeps the ``beam`` most probable label combinations along the chain and returns the best one.

Scoring is map-only.  The broadcast model holds at most ``max_terms`` terms.

Defined results: null, empty and blank texts have no subject; a document without any gives no row; a label row with a
null subject says that the document has none; labels given twice count once; unknown sources are a source of their
own; without any label nothing is predicted; repeated documents are scored alike; very long texts are read whole;
extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = re.compile(r"<(?:/?(?:p|div|li|ul|ol|tr|td|h\d|table|section)|br)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_END = re.compile(r"[。！？!?]+[”\"’」）)]*|[\r\n]+|(?<=[a-zA-Z0-9)])\.(?=\s|$)")
_LETTER = re.compile(r"[^\W\d_]")
_HAN = re.compile("[一-鿿]+")
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-])+")


def plain(text: str) -> str:
    """Lower case without mark-up; block tags end a sentence."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    return text.lower()


def sentence_ends(text: str) -> list[int]:
    """The ends of the sentences of a plain text; parts without a letter are none."""
    ends, start = [], 0
    for m in _END.finditer(text):
        if _LETTER.search(text, start, m.start()):
            ends.append(m.end())
        start = m.end()
    if _LETTER.search(text, start):
        ends.append(len(text))
    return ends


def terms(sentence: str) -> set[str]:
    out: set[str] = set()
    for run in _HAN.findall(sentence):
        for n in (2, 3, 4):
            out.update(run[i:i + n] for i in range(len(run) - n + 1))
    words = [w for w in _WORDS.findall(sentence) if not _HAN.match(w)]
    out.update(w for w in words if len(w) > 4)
    at = -1
    for a, b in zip(words, words[1:]):
        pair = f"{a} {b}"
        if (at := sentence.find(pair, max(at, 0))) >= 0:
            out.add(pair)
        else:
            at = -1
    return out


class Evidence:
    """The terms of each subject, and which sentences of a text speak for which subject."""

    def __init__(self, weights: dict[str, tuple[int, float]], subjects: int):
        import ahocorasick

        self.subjects = subjects
        self.automaton = ahocorasick.Automaton()
        for term, (subject, weight) in weights.items():
            # a term of words must stand alone, so its length comes along
            self.automaton.add_word(term, (subject, weight, 0 if _HAN.match(term) else len(term)))
        self.empty = not weights
        if weights:
            self.automaton.make_automaton()

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """(sentences that speak for each subject, sentences)."""
        found, ends = self.sentences(plain(text))
        out = np.zeros(self.subjects)
        for s in found.values():
            out[s] += 1
        return out, len(ends)

    def sentences(self, text: str) -> tuple[dict[int, int], list[int]]:
        ends = sentence_ends(text)
        scores: dict[int, dict[int, float]] = {}
        if ends and not self.empty:
            k, last = 0, len(ends) - 1
            for at, (subject, weight, size) in self.automaton.iter(text):
                if size and ("a" <= text[at + 1:at + 2] <= "z" or at >= size and "a" <= text[at - size] <= "z"):
                    continue
                if at >= ends[k]:
                    k = bisect_left(ends, at + 1, k)
                    if k > last:
                        k = last
                here = scores.get(k)
                if here is None:
                    scores[k] = {subject: weight}
                else:
                    here[subject] = here.get(subject, 0.0) + weight
        return {k: best for k, here in scores.items() if here[best := max(here, key=here.__getitem__)] >= 0.9}, ends


class TermTable:
    """The terms of every sentence of some texts, as numbers; made once for all that is learnt from them."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        found, sizes, document = [np.zeros(0, np.int32)], [], []
        for k, text in enumerate(texts):
            text = plain(text)
            ends = sentence_ends(text)
            for a, b in zip([0, *ends], ends):
                ids = [number.setdefault(t, len(number)) for t in terms(text[a:b])]
                found.append(np.array(ids, np.int32))
                sizes.append(len(ids))
                document.append(k)
        self.number, self.texts, self.sentences = number, len(texts), len(sizes)
        self.flat, self.of = np.concatenate(found), np.repeat(np.arange(len(sizes)), sizes)
        self.document = np.array(document, np.int64)


def learn_terms(table: TermTable, labels: list[set[int]], use: np.ndarray, subjects: int, purity: float, least: int, max_terms: int) -> dict[str, tuple[int, float]]:
    """The evidence, term -> (subject, weight), from the texts that ``use`` marks."""
    if not table.sentences:
        return {}
    number, flat, of, document = table.number, table.flat, table.of, table.document
    sizes, mine_only = range(table.sentences), use[table.document]
    own = np.zeros((table.texts, subjects), bool)
    for k, mine in enumerate(labels):
        own[k, list(mine)] = True
    single = np.array([next(iter(mine)) if len(mine) == 1 else subjects if not mine else -1 for mine in labels])
    guess = np.where(mine_only, single[document], -1)  # the label that a sentence teaches, `subjects` for none, -1 for not known
    names = list(number)
    weights: dict[str, tuple[int, float]] = {}
    for _ in range(2):
        total = np.bincount(guess[guess >= 0], minlength=subjects + 1) + 1.0
        taught = guess[of] >= 0
        counts = np.bincount(flat[taught].astype(np.int64) * (subjects + 1) + guess[of][taught],
                             minlength=len(names) * (subjects + 1)).reshape(-1, subjects + 1)
        seen = counts.sum(axis=1)
        rate = counts / total
        best = rate[:, :subjects].argmax(axis=1)
        share = rate[np.arange(len(names)), best] / np.maximum(rate.sum(axis=1), 1e-300)
        candidates = np.flatnonzero((seen >= least) & (share >= purity))
        weights = {}
        for i in sorted(candidates.tolist(), key=lambda i: (len(names[i]), names[i])):
            t, s = names[i], int(best[i])
            # a longer term adds nothing to a part of it that speaks for the same subject already
            if not any(weights.get(t[x:y], (-1,))[0] == s for x in range(len(t)) for y in range(x + 2, len(t) + (x > 0))):
                weights[t] = (s, float(share[i]) if seen[i] >= 2 * least else 0.6 * float(share[i]))
        if len(weights) > max_terms:
            weights = dict(sorted(weights.items(), key=lambda x: (-seen[number[x[0]]], x[0]))[:max_terms])
        subject, weight = np.zeros(len(names), np.int64), np.zeros(len(names))
        for t, (s, w) in weights.items():
            subject[number[t]], weight[number[t]] = s, w
        score = np.zeros((len(sizes), subjects))
        speaks = weight[flat] > 0
        np.add.at(score, (of[speaks], subject[flat[speaks]]), weight[flat[speaks]])
        score *= own[document]
        # a sentence without evidence teaches that its terms are no subject's
        guess = np.where(mine_only, np.where(score.max(axis=1) > 0, score.argmax(axis=1), subjects), -1)
    return weights


def features(counts: np.ndarray, n: int) -> np.ndarray:
    """A row of features for each subject."""
    share = counts / max(1, n)
    return np.stack([np.ones(len(counts)), share, np.sqrt(share), (share >= 0.1).astype(float), np.log1p(counts),
                     (counts == 1).astype(float), (counts == 0).astype(float), np.full(len(counts), math.log1p(n) / 4)], 1)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray, steps: int = 25) -> np.ndarray:
    """Newton's method for a logistic model whose weights are shrunk towards ``prior``."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        move = np.linalg.solve(hessian, gradient)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


class SubjectModel:
    def __init__(self, subjects: list[str], sources: list[str], weights: dict[str, tuple[int, float]],
                 shared: np.ndarray, chain: np.ndarray):
        self.subjects, self.sources, self.weights, self.shared, self.chain = subjects, sources, weights, shared, chain

    def decode(self, offsets: np.ndarray, source: int, beam: int = 4) -> list[int]:
        """The most probable combination along the chain."""
        m = len(self.subjects)
        held: list[tuple[float, list[int]]] = [(0.0, [])]
        for s in range(m):
            w = self.chain[s]
            base = w[0] * offsets[s] + w[1 + m + source]
            grown = []
            for score, own in held:
                z = base + sum(w[1 + j] for j in own)
                no = -math.log1p(math.exp(min(z, 700.0)))
                grown.append((score + no, own))
                grown.append((score + no + z, [*own, s]))
            held = sorted(grown, key=lambda x: -x[0])[:beam]
        return held[0][1]


def title_terms(title: str) -> list[str]:
    """The words of a title that may tell its subject."""
    words = [w for w in re.split(r"[\W_]+|[与和及或的]", title.lower()) if w]
    return [w for w in words if len(w) >= (2 if _HAN.match(w) else 5)]


def train(rows: list[tuple[str, str | None, set[str]]], purity: float = 0.75, least: int = 4,
          max_terms: int = 1_000_000, titles: dict[str, str] | None = None) -> SubjectModel | None:
    """A model from (text, source, subjects) of labelled documents; ``titles`` names all subjects there are."""
    if titles is not None:
        rows = [(text, source, {s for s in own if s in titles}) for text, source, own in rows]
    labelled = {s for *_, own in rows for s in own}
    if not labelled:
        return None
    subjects = sorted(labelled | set(titles or ()))
    at = {s: i for i, s in enumerate(subjects)}
    sources = sorted({source for _, source, _ in rows if source})
    where = {s: i + 1 for i, s in enumerate(sources)}
    labels = [{at[s] for s in own} for *_, own in rows]
    texts = [t for t, *_ in rows]
    m, folds = len(subjects), 2 if len(rows) >= 20 else 1
    x = np.zeros((len(rows), m, features(np.zeros(m), 0).shape[1]))
    table, at_all = TermTable(texts), np.arange(len(rows))
    for f in range(folds):
        use = (at_all % folds != f) | (folds == 1)
        evidence = Evidence(learn_terms(table, labels, use, m, purity, least, max_terms), m)
        for i in range(len(rows)):
            if folds == 1 or i % folds == f:
                x[i] = features(*evidence.counts(texts[i]))
    y = np.zeros((len(rows), m))
    for i, own in enumerate(labels):
        y[i, list(own)] = 1
    known = np.array([s in labelled for s in subjects])
    flat, told = x[:, known].reshape(-1, x.shape[2]), y[:, known].reshape(-1)
    shared = logistic(flat, told, np.zeros(flat.shape[1]), np.full(flat.shape[1], 0.05))
    offsets = x @ shared
    source = np.zeros((len(rows), len(sources) + 1))
    for i, (_, name, _) in enumerate(rows):
        source[i, where.get(name, 0)] = 1
    chain = np.zeros((m, 1 + m + len(sources) + 1))
    for s in range(m):
        if subjects[s] not in labelled:
            chain[s, 0] = 1.0
            continue
        before = y.copy()
        before[:, s:] = 0
        z = np.concatenate([offsets[:, s:s + 1], before, source], axis=1)
        prior = np.zeros(z.shape[1])
        prior[0] = 1.0
        chain[s] = logistic(z, y[:, s], prior, np.concatenate([[20.0], np.full(z.shape[1] - 1, 5.0)]))
    weights = learn_terms(table, labels, at_all >= 0, m, purity, least, max_terms)
    for s in sorted(set(subjects) - labelled):
        for word in title_terms(titles[s]):
            weights.setdefault(word, (at[s], 1.0))
    return SubjectModel(subjects, sources, weights, shared, chain)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list[tuple[str, str | None, set[str]]]:
    """At most ``max_labelled`` labelled documents with a text, chosen by the hash of their id."""
    own = (labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("own"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    found = docs.select("doc_id", "text", "source").join(F.broadcast(own), "doc_id").orderBy("doc_id").collect()
    return [(r["text"] or "", r["source"], set(r["own"])) for r in found]


def assign_subjects(docs: DataFrame, model: SubjectModel | None, beam: int = 4) -> DataFrame:
    """(doc_id, subject) of every document and each of its subjects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.weights, len(model.subjects)) if model else None
        where = {s: i + 1 for i, s in enumerate(model.sources)} if model else {}
        for b in batches:
            ids, names = [], []
            if model:
                for doc, text, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not text:
                        continue
                    counts, n = evidence.counts(text)
                    if n:
                        for s in model.decode(features(counts, n) @ model.shared, where.get(source, 0), beam):
                            ids.append(doc)
                            names.append(model.subjects[s])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=["doc_id", "subject"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").mapInArrow(run, "doc_id bigint, subject string")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/subject_labels.parquet")
    titles = {r["subject"]: r["title"] or "" for r in spark.read.parquet(f"{sf_dir}/subjects.parquet").collect() if r["subject"]}
    return assign_subjects(docs, train(labelled_sample(docs, labels, max_labelled=3000), titles=titles))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, subject, documents): the corpus by source and subject."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return (p9_found(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
            .groupBy("source", "subject").agg(F.count("*").alias("documents")))
