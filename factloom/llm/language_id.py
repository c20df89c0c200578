"""Language identification by words first, backing off to character n-grams.

A word that was seen at least twice in training has a log frequency in each language. Another word takes the mean log
frequency of its longest n-grams (word borders included) of which any is known, from MOST characters down to one. A
text's language is that of the largest sum over its words.

Counts come from a bounded sample: at most ``per_language`` texts of each language (a parameter), chosen by a hash of
id and text; equal rows count once. Prediction reads whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0. So is every text if nothing was learned.
Where languages tie, the first by code point wins. A text of unknown letters goes to the language whose counts are
smallest. Languages are told apart by their exact names, whatever these hold. Repeated rows get the same result, an empty
table gives no rows, and columns other than id, text and language, of any name, play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, materialize

WORD = re.compile(r"[^\W\d_]+")
MOST = 5
#: Words that count for the score: the posterior of that many average words.
SCORE_WORDS = 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    floor: np.ndarray

    def word(self, word: str) -> np.ndarray:
        """The word's log frequencies by language."""
        found = self.words.get(word)
        if found is not None:
            return self.word_rows[found]
        bound, get = f"^{word}$", self.grams.get
        for n in range(MOST, 0, -1):
            known = [g for i in range(len(bound) - n + 1) if (g := get(bound[i : i + n])) is not None]
            if known:
                return self.gram_rows[known].sum(0) / len(known)
        return self.floor


class Scorer:
    """Rows of log frequencies, by the chunk between white space; at most ``limit`` chunks are kept."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit = model, limit
        self.rows = np.zeros((limit, len(model.languages) + 1), dtype=np.float32)
        self.at: dict[str, int] = {}

    def row(self, chunk: str) -> np.ndarray:
        """The sum over the chunk's words, and their number."""
        words = WORD.findall(chunk)
        if not chunk.isascii():
            words = [w for w in words if any(map(str.isalpha, w))]
        out = np.zeros(len(self.model.languages) + 1, dtype=np.float32)
        for w in words:
            out[:-1] += self.model.word(w)
        out[-1] = len(words)
        return out

    def sums(self, text: str) -> np.ndarray:
        chunks = Counter(text.lower().split())
        total = np.zeros(len(self.model.languages) + 1)
        items = list(chunks.items())
        for start in range(0, len(items), 50_000):
            part = items[start : start + 50_000]
            if len(self.at) + len(part) > self.limit:
                self.at.clear()
            places = [self.at.get(chunk) for chunk, _ in part]
            if None in places:
                for k, place in enumerate(places):
                    if place is None:
                        places[k] = self.at[part[k][0]] = len(self.at)
                        self.rows[places[k]] = self.row(part[k][0])
            total += np.array([n for _, n in part], dtype=np.float64) @ self.rows[places]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return "und", 0.0
        total = self.sums(text)
        if not total[-1]:
            return "und", 0.0
        mean = total[:-1] / total[-1]
        best = int(np.argmax(mean))
        p = np.exp((mean - mean[best]) * min(SCORE_WORDS, total[-1]))
        return self.model.languages[best], float(1 / p.sum())


def train(docs: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = 1500) -> Model:
    """Learn from the rows for which ``usable`` holds and language and text aren't null."""
    known = docs.filter(usable & F.col(language).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(language).count().collect()}  # a row per language
    if not sizes:
        return Model((), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), np.zeros(0))
    languages = tuple(sorted(sizes, key=lambda x: [ord(c) for c in x]))
    # a hash for each text; the cut of a language is its per_language-th smallest, so that the sample is bounded strictly
    keyed = known.select(F.col(language).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(id_column), F.col(text), F.lit(5)).alias("_h"))
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    first = keyed.select("_lang", "_h").distinct().withColumn("_n", nth).filter(F.col("_n") <= per_language)
    cuts = {r[0]: r[1] for r in first.groupBy("_lang").agg(F.max("_h")).collect()}  # a row per language
    cut = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))])
    chosen = keyed.filter(F.col("_h") <= F.element_at(cut, F.col("_lang"))).dropDuplicates(["_lang", "_h"]).select("_lang", "_text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("_lang")["_text"]:
                found: Counter = Counter()
                for x in texts:
                    found.update(WORD.findall(x.lower()))
                if found:
                    yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})

    words = chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                # in scripts without spaces a run of letters is a clause, and may be long
                for gram in grams_of(word):
                    found[lang, gram] += n
                    if len(found) >= 200_000:
                        yield _counted(found)
                        found = Counter()
        if found:
            yield _counted(found)

    grams = words.mapInPandas(cut, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(languages, *_table(words, "word", languages)[:2], *_table(grams, "gram", languages))


def grams_of(word: str) -> Iterator[str]:
    """All n-grams of a word with its borders, of 1 to MOST characters."""
    bound = f"^{word}$"
    for n in range(1, MOST + 1):
        for i in range(len(bound) - n + 1):
            yield bound[i : i + n]


def _counted(found: Counter) -> pd.DataFrame:
    return pd.DataFrame({"lang": [x[0] for x in found], "gram": [x[1] for x in found], "n": list(found.values())})


def _table(counts: DataFrame, key: str, languages: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Keys seen twice or more with their rows, the rows' smoothed log frequencies, and those of an unseen key.

    A key comes with its counts by language, so that languages are values, never columns.
    """
    pair = F.struct(F.col("lang").alias("lang"), F.col("n").alias("n"))
    one = counts.groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("total"), F.collect_list(pair).alias("by")).filter("total >= 2")
    place = {x: i for i, x in enumerate(languages)}
    rows = sorted((r.key, tuple((x.lang, x.n) for x in r.by)) for r in one.select("key", "by").toLocalIterator())
    table = np.zeros((len(rows), len(languages)))
    for i, (_, found) in enumerate(rows):
        for lang, n in found:
            table[i, place[lang]] = n
    sums = table.sum(0) + 0.5 * (len(rows) + 1)
    logs = np.log((table + 0.5) / sums).astype(np.float32)
    return {r[0]: i for i, r in enumerate(rows)}, logs, np.log(0.5 / sums).astype(np.float32)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(docs[id_column].alias("doc_id"), docs[text].alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(x) for x in batch["_text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_column: str = "doc_id", fold: int = 3) -> Column:
    return crc_mod(id_column, fold) == 1
