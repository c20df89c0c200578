"""Quality: Bradley-Terry ranking learned from preference pairs, then a threshold at a quantile of the scores.

A document's strength is a weight vector times its features: the shares of its words among BUCKETS hashed buckets, and
shares of symbols, capitals, repeats and the like, all of the whole text. Pairs put a document of label 1 over one of
label 0; the weights minimise the logistic loss of feature differences, by Newton's method. The threshold is the exact
quantile of the strengths of all labelled documents outside the held-out fold that leaves the share of label 0 below it;
scores are logistic in the strength and have ``at`` there.

The weights are fitted on a bounded sample: at most ``per_class`` labelled documents of each class (a parameter). The
threshold and the scores cover all rows and whole texts.

Defined cases: null and empty texts have the features of no words. Without labels of both classes every score is the
smoothed share of label 1. Equal texts get equal scores; a repeated id counts once, with its first text by code point.
An empty table gives no rows. A text of any length is scored whole. Extra columns of any name play no part and stay in
``keep_good``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import labelled
from factloom.llm.common import TwoAgeCache, materialize

SYMBOLS = "#*$%&|<>"
BUCKETS = 256
N_SURFACE = 12
N_FEATURES = N_SURFACE + BUCKETS
#: Characters of the longest word that is cached; values in a range that the driver sorts.
LONG, FEW = 64, 4096


class Features:
    """Feature vectors of texts; words' buckets are cached."""

    def __init__(self) -> None:
        self.buckets = TwoAgeCache(self.bucket)

    @staticmethod
    def bucket(word: str) -> int:
        return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = text.split()
        n = max(1, len(words))
        lines = [x for x in text.split("\n") if not x.isspace() and x]
        distinct = len(set(words))
        symbols = sum(map(text.count, SYMBOLS))
        out = np.zeros(N_FEATURES)
        out[:N_SURFACE] = (
            math.log1p(len(words)),
            sum(map(str.isupper, words)) / n,
            math.log1p(symbols / n),
            math.log1p(text.count("!") / n),
            distinct / n,
            math.log1p(n / max(1, distinct)),
            sum(map(eq, words, words[1:])) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            math.log1p(len(text) / n),
            sum(map(text.count, "0123456789")) / max(1, len(text)),
            sum(map(text.count, ".,;:?")) / n,
            1.0 if symbols else 0.0,
        )
        if words:
            places = [self.buckets[x] if len(x) <= LONG else self.bucket(x) for x in words]
            out[N_SURFACE:] = np.sqrt(np.bincount(places, minlength=BUCKETS) / n)
        return out


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: float

    def strengths(self, texts, features: Features) -> np.ndarray:
        if not self.weights.any():  # nothing was learned
            return np.zeros(len(texts))
        x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
        # one sum per text: independent of the batch
        return ((x - self.center) / self.scale * self.weights).sum(1)

    def scores(self, texts, features: Features) -> np.ndarray:
        return self.logistic(self.strengths(texts, features) + self.offset)

    @staticmethod
    def logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], rounds: int = 4, penalty: float = 1e-2, seed: int = 8) -> Model:
    """Weights from ``rounds`` pairings of the smaller with the larger class; the threshold isn't set yet."""
    none = np.zeros(N_FEATURES)
    if len({*y.tolist()}) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(none, none + 1, none, math.log(share / (1 - share)))
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = ((x - center) / scale).astype(np.float32)
    good, bad = z[y == 1], z[y == 0]
    rng, pairs = np.random.default_rng(seed), []
    most = max(len(good), len(bad))
    for _ in range(rounds):
        pairs.append(good[rng.permutation(most) % len(good)] - bad[rng.permutation(most) % len(bad)])
    w = none.copy()
    for _ in range(50):
        g, h = penalty * w, penalty * np.eye(N_FEATURES)
        for d in pairs:
            p = Model.logistic(d @ w.astype(np.float32)).astype(np.float32)
            g = g + (d.T @ (p - 1)).astype(np.float64) / (rounds * most)
            h = h + ((d * (p * (1 - p))[:, None]).T @ d).astype(np.float64) / (rounds * most)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return Model(center, scale, w, 0.0)


def kth_smallest(values: DataFrame, column: str, k: int) -> float:
    """The ``k``-th smallest value (from 1), exactly: histograms of ever narrower ranges, then a sort of at most FEW values."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = values.filter(F.col(column).between(low, high))
        bucket = F.least(F.lit(FEW - 1), F.floor((F.col(column) - low) / (high - low) * FEW))
        rows = inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("b").collect()
        for r in rows:  # FEW of them at most
            if k <= r.n:
                break
            k -= r.n
        low, high = r.low, r.high
        if r.n <= FEW:
            return sorted(x[0] for x in inside.filter(F.col(column).between(low, high)).select(column).collect())[k - 1]
    return low


def threshold(docs: DataFrame, known: DataFrame, model: Model, id_column: str, fold: int, text: str) -> float:
    """The strength halfway between those at the two sides of the quantile, over all labelled documents."""
    own = docs.filter(F.col(id_column).isNotNull() & ~labelled.held_out(id_column, fold)).select(F.col(id_column).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_s": model.strengths(batch["_text"], features)})

    scored = own.mapInPandas(run, f"_id {kind}, _s double").groupBy("_id").agg(F.min("_s").alias("_s"))
    strengths = materialize(scored.join(known, "_id").select("_s", "_label"))
    zeros, ones = (strengths.agg(F.count_if(F.col("_label") == k)).first()[0] for k in (0, 1))
    return (kth_smallest(strengths, "_s", max(1, zeros)) + kth_smallest(strengths, "_s", min(zeros + 1, zeros + ones))) / 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text",
          per_class: int = 3000, fold: int = 5, at: float = 0.3) -> Model:
    rows, sizes, known = labelled.sample(docs, labels, label, per_class, id_column, fold, text)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"].astype(str), "label": batch["_label"], "x": [features(t).tobytes() for t in batch["_text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted((a, b, bytes(c)) for batch in batches for a, b, c in zip(batch["id"], batch["label"], batch["x"], strict=True))
        x = np.array([np.frombuffer(r[2]) for r in found], dtype=np.float64).reshape(-1, N_FEATURES)
        own = fit(x, np.array([r[1] for r in found]), sizes)
        yield pd.DataFrame({"center": [own.center.tobytes()], "scale": [own.scale.tobytes()], "weights": [own.weights.tobytes()], "offset": [own.offset]})

    # the bounded sample meets in one task, not on the driver, which gets the weights only
    found = materialize(rows.mapInPandas(extract, "id string, label int, x binary"))
    learned = found.coalesce(1).mapInPandas(learn, "center binary, scale binary, weights binary, offset double").collect()
    if learned:
        model = Model(*(np.frombuffer(learned[0][k]) for k in range(3)), learned[0].offset)
    else:
        model = fit(np.zeros((0, N_FEATURES)), np.zeros(0), sizes)
    if not model.weights.any():
        return model
    cut = threshold(docs, known, model, id_column, fold, text)
    return Model(model.center, model.scale, model.weights, math.log(at / (1 - at)) - cut)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    own = docs.select(docs[id_column].alias("doc_id"), docs[text].alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            s = model.scores(batch["_text"], features)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            yield batch[model.scores(batch[text], features) >= threshold]

    return docs.mapInPandas(run, docs.schema)
