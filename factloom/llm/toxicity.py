"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A document's feature is the number of its distinct words (lower-cased, split at white space) that hold an n-gram of
N_GRAMS characters, word borders included, times the n-gram's log-count ratio. As the score is linear, each word has a
score of its own, and a document's is the sum over its distinct words; words are scored once and cached.

The model is fitted on a bounded sample of labelled rows: at most ``per_class`` documents of each class (a parameter).
Its size is bounded too: n-grams share 2^SPACE_BITS hashes, of which the ``keep`` that tell most have a weight, each seen
in ``least_documents`` of the sample at least (parameters). Everything else covers all rows and whole texts.

Defined cases: a null or empty text has the score that the intercept gives. Without labelled rows of both classes the
score is the share of label 1, smoothed by one row of each. Ties and equal rows get equal scores; a repeated id counts
once in the sample. An empty table gives no rows. A text of any length is scored whole; words of over LONG characters
aren't cached. Extra columns of any name play no part and stay in ``keep_clean``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from factloom.llm import labelled
from factloom.llm.common import TwoAgeCache, materialize

N_GRAMS = (3, 4, 5, 6)
SPACE_BITS = 20
MASK = (1 << SPACE_BITS) - 1


#: Characters of the longest word that is cached.
LONG = 64


def grams(word: str) -> Iterator[int]:
    """The hashed n-grams of a word between two spaces."""
    bound = f" {word} "
    if bound.isascii():  # a character is a byte
        data = bound.encode()
        return (zlib.crc32(data[i : i + n]) & MASK for n in N_GRAMS for i in range(len(data) - n + 1))
    return (zlib.crc32(bound[i : i + n].encode("utf-8", "surrogatepass")) & MASK for n in N_GRAMS for i in range(len(bound) - n + 1))


def document_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's hashed n-grams and the number of distinct words that hold each."""
    parts = [np.unique(np.fromiter(grams(word), dtype=np.int32)) for word in set((text or "").lower().split())]
    return np.unique(np.concatenate(parts) if parts else np.empty(0, dtype=np.int32), return_counts=True)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores of texts by a model; words are cached."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights.tolist(), model.bias
        self.words = TwoAgeCache(self.word)

    def word(self, word: str) -> float:
        """The sum of the weights of a word's distinct n-grams."""
        return sum(map(self.weights.__getitem__, set(grams(word))))

    def __call__(self, texts) -> np.ndarray:
        z, words = [], self.words
        for text in texts:
            own = set((text or "").lower().split())
            if max(map(len, own), default=0) <= LONG:
                z.append(self.bias + sum(map(words.__getitem__, own)))
            else:
                z.append(self.bias + sum(words[x] if len(x) <= LONG else self.word(x) for x in own))
        return 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -30, 30)))


def fit(features: list[tuple[int, np.ndarray, np.ndarray]], sizes: dict[int, int], keep: int = 1 << 16,
        least_documents: int = 4, penalty: float = 1e-3, steps: int = 80, block: int = 1 << 18) -> Model:
    """Logistic regression on the scaled counts, by full-batch Adam; features: (label, n-grams, counts).

    It holds the features as given, those kept as (column, value) of 8 bytes, and temporaries of ``block`` entries.
    """
    space = 1 << SPACE_BITS
    if {x[0] for x in features} != {0, 1}:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(np.zeros(space, dtype=np.float32), math.log(share / (1 - share)))
    documents, sums = np.zeros(space, dtype=np.int32), np.ones((2, space))
    for label, index, count in features:  # a document's n-grams are distinct
        documents[index] += 1
        sums[label, index] += count
    ratio = np.log((sums[1] / sums[1].sum()) / (sums[0] / sums[0].sum()))
    gain = np.where(documents >= least_documents, np.abs(ratio) * np.sqrt(documents), -1.0)
    chosen = np.argsort(-gain, kind="stable")[:keep]
    chosen = chosen[gain[chosen] > 0]
    place = np.full(space, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    y = np.array([x[0] for x in features], dtype=np.float64)
    columns, values = [], []
    for k, (_, index, count) in enumerate(features):
        use = place[index] >= 0
        columns.append(place[index[use]])
        values.append((count[use] * ratio[index[use]]).astype(np.float32))
        features[k] = None  # no longer needed
    lens = np.array(list(map(len, columns)))
    column, value = np.concatenate(columns), np.concatenate(values)
    columns.clear(), values.clear()
    # blocks of whole documents
    starts = np.r_[0, np.cumsum(lens)]
    cuts = sorted({0, *np.searchsorted(starts, range(0, int(starts[-1]), block), side="right").tolist(), len(y)})
    n, d = len(y), len(chosen)
    w, m, v, bias, mb, vb = np.zeros(d), np.zeros(d), np.zeros(d), 0.0, 0.0, 0.0
    for k in range(1, steps + 1):
        g, gb = penalty * w, 0.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = slice(starts[a], starts[b])
            row = np.repeat(np.arange(b - a), lens[a:b])
            z = np.bincount(row, weights=w[column[own]] * value[own], minlength=b - a) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]
            g = g + np.bincount(column[own], weights=error[row] * value[own], minlength=d) / n
            gb += float(error.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**k, 1 - 0.99**k
        w = w - 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.05 * (mb / fix) / (math.sqrt(vb / fix2) + 1e-8)
    weights = np.zeros(space, dtype=np.float32)
    weights[chosen] = w * ratio[chosen]
    return Model(weights, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text",
          per_class: int = 1500, fold: int = 5) -> Model:
    """Fit a model on at most ``per_class`` labelled documents of each class outside the held-out fold."""
    rows, sizes, _ = labelled.sample(docs, labels, label, per_class, id_column, fold, text)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["_text"], batch["_label"], strict=True):
                index, count = document_grams(a)
                yield pd.DataFrame({"label": [b], "index": [index.tobytes()], "count": [count.astype(np.int32).tobytes()]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = [(a, np.frombuffer(b, dtype=np.int32), np.frombuffer(c, dtype=np.int32)) for batch in batches for a, b, c in zip(batch["label"], batch["index"], batch["count"], strict=True)]
        # the order in which files are read doesn't matter
        features.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()[:64]))
        model = fit(features, sizes)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    # the bounded sample meets in one task, not on the driver, which gets the weights only
    found = materialize(rows.mapInPandas(extract, "label int, index binary, count binary"))
    learned = found.coalesce(1).mapInPandas(learn, "weights binary, bias double").collect()
    return Model(np.frombuffer(learned[0].weights, dtype=np.float32), learned[0].bias) if learned else fit([], sizes)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``; see ``keep_clean`` for whole rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(docs[id_column].alias("doc_id"), docs[text].alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = shared.value.scorer()
        for batch in batches:
            s = scores(batch["_text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; no shuffle and no join by id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = shared.value.scorer()
        for batch in batches:
            yield batch[scores(batch[text]) < threshold]

    return docs.mapInPandas(run, docs.schema)
