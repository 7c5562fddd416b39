"""A toxicity classifier that is fit so that swapping identity terms leaves its score as it is."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.llm._tables import kept
from sigtables.llm._text import column

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Names of groups that may stand for each other in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
PREFIXES = (4, 5, 6, 7)
#: Words that a scoring task keeps; when there are more it starts anew, which changes no result.
WORDS_KEPT = 300_000


def features(word: str) -> list[str]:
    """A word stands for itself and for its beginnings."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + the sum of the weights of the features that a text has)))."""

    weights: dict[str, float]
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.names = list(model.weights)
        self.of = {name: i for i, name in enumerate(self.names)}
        self.weight = [model.weights[x] for x in self.names]
        self.bias = model.bias
        self.known: dict[str, tuple[int, ...]] = {}

    def indexes(self, text: str) -> set[int]:
        """The model's features that the whole text has."""
        words = set(WORD.findall(text.lower()))
        known, of = self.known, self.of
        new = words.difference(known)
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = words
        for w in new:
            known[w] = tuple(of[f] for f in features(w) if f in of)
        found: set[int] = set()
        for w in words:
            if known[w]:
                found.update(known[w])
        return found

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weight[i] for i in sorted(self.indexes(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def swaps(text: str, groups: Sequence[Sequence[str]]) -> Counter:
    """How often a sentence of the text changes each identity term for each other of its group."""
    of = {t: g for g in groups for t in g}
    out: Counter = Counter()
    for s in SENTENCE.findall(text.lower()):
        for t in set(WORD.findall(s)) & of.keys():
            out.update((t, other) for other in of[t] if other != t)
    return out


def fit(rows: Sequence[Sequence[int]], toxic: Sequence[int], names: Sequence[str], pairs: Mapping[tuple[str, str], int], strength: float = 1.0, ridge: float = 1e-4, steps: int = 500) -> Model:
    """Logistic regression on which features a text has, by Adam on all rows.

    To the loss comes `strength` times the mean squared change of the score (before the logistic function) when a
    sentence's identity term is swapped, and `ridge` times the squared weights. Without rows or with one label only,
    every text gets the smoothed share of label 1, a quarter without rows.
    """
    n, k = len(rows), len(names)
    prior = (sum(toxic) + 0.5) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if n == 0 or k == 0 or len(set(toxic)) < 2:
        return Model({}, bias)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    what = np.array([i for r in rows for i in r], np.int64)
    y, of = np.array(toxic, float), {x: i for i, x in enumerate(names)}
    vectors = []
    for (a, b), times in sorted(pairs.items()):
        change = Counter({of[f]: 1 for f in features(a) if f in of})
        change.subtract({of[f]: 1 for f in features(b) if f in of})
        vectors.append((times, {i: v for i, v in change.items() if v}))
    vectors = [(times, v) for times, v in vectors if v]
    total = sum(times for times, _ in vectors) or 1
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = bias
    for step in range(1, steps + 1):
        z = np.bincount(at, weights=w[what], minlength=n) + w[k]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        g = np.append(np.bincount(what, weights=error[at], minlength=k) + 2 * ridge * w[:k], error.sum())
        for times, change in vectors:
            i, x = np.array(list(change)), np.array(list(change.values()), float)
            g[i] += 2 * strength * times / total * (w[i] @ x) * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(names, w[:k].tolist(), strict=True)), float(w[k]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8192, most_features: int = 4096, least_rows: int = 5, least_chi2: float = 20.0, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, strength: float = 1.0, ridge: float = 1e-4) -> Model:
    """Fits the classifier on `most_rows` labelled documents at most, those whose id has the least hash.

    labels: doc_id and toxic (0 or 1); rows with a null are left out, of several for one id a 1 counts. Features are the
    words and word beginnings that `least_rows` of these documents have and whose chi-square with the label is
    `least_chi2` or more, the best `most_features`, and those of the identity terms. What reaches the driver is bounded by these
    parameters: of several documents with one id the text that sorts first is taken. Documents without a text count as empty.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = kept(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic")).select("text", "_toxic"))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for t, y in zip(column(batch, "text"), column(batch, "_toxic"), strict=True):
                counts[y > 0].update({f for w in set(WORD.findall(t.lower())) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[x] for x in part], pa.int64()) for c in counts)], ["feature", "clean", "toxic"])

    both = F.col("clean") + F.col("toxic")
    off = F.col("toxic") * (n - positive) - F.col("clean") * positive
    chi2 = off * off * float(n) / (both * (F.lit(float(n)) - both) * float(positive) * float(n - positive))
    best = []
    if 0 < positive < n:
        stats = sample.mapInArrow(seen, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
        best = [r.feature for r in stats.where(both.between(least_rows, n - 1)).withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "feature").limit(most_features).select("feature").collect()]
    names = list(dict.fromkeys([*best, *(f for g in groups for t in g for f in features(t))]))
    empty = Model(dict.fromkeys(names, 0.0), 0.0)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(empty)
        for batch in batches:
            texts = column(batch, "text")
            found = [[f"{a} {b} {k}" for (a, b), k in swaps(t, groups).items()] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(scorer.indexes(t)) for t in texts], pa.list_(pa.int32())), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["has", "toxic", "swaps"])

    rows = sample.mapInArrow(encoded, "has array<int>, toxic int, swaps array<string>").collect()
    pairs: Counter = Counter()
    for r in rows:
        for a, b, k in map(str.split, r.swaps):
            pairs[a, b] += int(k)
    rows.sort(key=lambda r: (r.toxic, r.has))
    return fit([r.has for r in rows], [r.toxic for r in rows], names, pairs, strength, ridge)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5), in one pass over the whole texts without a shuffle.

    A null text scores as an empty one. Columns of docs of these names are replaced; repeated rows stay.
    """
    docs = docs.drop("score", "predicted")
    kept_columns = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            got = [scorer.score(t or "") for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], [*kept_columns, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, learnt from the labels of rows that are not held out.

    Null and empty texts score alike; a null id isn't held out; repeated rows stay; an empty table stays empty.
    """
    model = train(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
