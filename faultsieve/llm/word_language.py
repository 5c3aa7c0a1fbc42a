"""Language identification: known words first, then ever shorter parts of words.

A text falls into words, runs of letters in small form. A word that the model knows counts with the logarithm of its frequency
in each language. One it does not know falls back to character n-grams of the word between its boundaries: of the
greatest length of which any is known, and the mean of the known ones counts. The language with the largest sum over
all words is predicted, the score is its share among all languages (softmax of the sums).

The model is learned from text and lang of at most `TRAIN_ROWS` rows of each language, those with the least hash of
doc_id and not held out. Spark counts words and n-grams over those rows; the model keeps at most `WORDS` words and
`GRAMS` n-grams of each length, the most frequent ones, so its size does not grow with the table.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where no row has a language;
rows with a null lang or doc_id are not learned from; of repeated doc_ids all rows are learned from;
equal sums give the language that comes first by code points; repeated rows each get a row; a null doc_id is not
held out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize
from .quality_gam import held_out

#: At most so many rows of each language are learned from.
TRAIN_ROWS = 4_000
#: Parts that a language's rows are chosen in.
SALTS = 32
#: Ids of so many rows are broadcast, more (of very many languages) are joined.
BROADCAST_ROWS = 1_000_000
WORDS, GRAMS, LONGEST = 100_000, 50_000, 5
#: Words and n-grams that occur less often than this in what is learned from are not known.
LEAST = 2
SMOOTH = 0.5
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Unseen words whose backed-off values a task remembers.
CACHE = 100_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word between its boundaries; a boundary alone is none."""
    full = f"<{word}>" if n > 1 else word
    return [full[i : i + n] for i in range(len(full) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language (in the order of `languages`) of known words and of n-grams by length."""

    languages: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    grams: dict[int, dict[str, int]] = field(default_factory=dict)
    gram_logs: dict[int, np.ndarray] = field(default_factory=dict)

    def backed_off(self, word: str) -> np.ndarray:
        """The value of an unseen word: of the longest n-grams of which any is known, the mean."""
        for n in range(LONGEST, 0, -1):
            known = self.grams.get(n, {})
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return self.gram_logs[n][found].mean(0)
        return np.zeros(len(self.languages))

    def sums(self, text: str | None, cache: dict[str, np.ndarray]) -> np.ndarray | None:
        """The sum over all words by language, or None without a word."""
        counts = Counter(words(text))
        if not counts:
            return None
        at, times, total = [], [], np.zeros(len(self.languages))
        for w, n in counts.items():
            k = self.words.get(w)
            if k is not None:
                at.append(k)
                times.append(n)
                continue
            value = cache.get(w)
            if value is None:
                value = self.backed_off(w)
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = value
            total = total + n * value
        return total + np.array(times) @ self.word_logs[at] if at else total

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        total = self.sums(text, cache) if self.languages else None
        if total is None:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def training_rows(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text and lang of the rows to learn from; texts are read of chosen rows alone."""
    usable = docs.where("lang is not null and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    chosen = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_salt"))
    for keys in (["lang", "_salt"], ["lang"]):  # one language may have nearly all rows
        order = W.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    chosen = materialize(chosen.select("doc_id", "lang").distinct(), "language-rows")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return usable.join(chosen, ["doc_id", "lang"], "left_semi").select("text", "lang")


def count_words(rows: DataFrame) -> DataFrame:
    """lang, word and n; tasks add up each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, w) for w in words(text))
            langs, found = [k[0] for k in counts], [k[1] for k in counts]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(counted: DataFrame) -> DataFrame:
    """lang, word (an n-gram), size and n, from counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        counts[lang, g, size] += n
            columns = list(zip(*counts)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "size", "n"])

    return counted.select("lang", "word", "n").mapInArrow(run, "lang string, word string, size int, n long").groupBy("lang", "word", "size").agg(F.sum("n").alias("n"))


def _logs(counted: DataFrame, languages: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Places of the most frequent words (or n-grams), and their smoothed log frequencies by language."""
    total = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    by = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    kept = counted.groupBy("word").agg(F.sum("n").alias("n"), *by).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(most).collect()
    n = np.array([[r[f"n{i}"] for i in range(len(languages))] for r in kept], dtype=float).reshape(len(kept), len(languages))
    whole = np.array([total.get(lang, 0) for lang in languages], dtype=float)
    return {r["word"]: i for i, r in enumerate(kept)}, np.log((n + SMOOTH) / (whole + SMOOTH * (len(kept) + 1)))


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    counted = materialize(count_words(training_rows(docs, most)), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model()
    model = Model(languages)
    model.words, model.word_logs = _logs(counted, languages, WORDS)
    parts = materialize(count_grams(counted), "language-grams")
    for size in range(1, LONGEST + 1):
        model.grams[size], model.gram_logs[size] = _logs(parts.where(F.col("size") == size), languages, GRAMS)
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            found = [shared.value.predict(t, cache) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
