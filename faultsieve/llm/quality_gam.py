"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training rows. Rounds of boosting go over the features in turn; each
step fits a tree of three leaves to the gradient of the log loss and adds it to the lookup table of its feature. Then the
pairs of features that still explain most get two-dimensional tables from trees with one cut on either axis. A score is
the sum of the table entries at a text's bins, through the logistic function.

The model is fitted on the driver from at most `TRAIN_ROWS` labelled rows, those with the least hash of doc_id, so that
reruns agree. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null text scores as an empty one; rows of labels without doc_id or quality are not learned from; with no
row of one of the labels every score is the share of label 1 (0.5 without rows); a null doc_id is not held out; repeated
rows each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are learned from.
TRAIN_ROWS = 20_000
FEATURES = ("words", "word_length", "upper", "exclaim", "symbol", "pipe", "digit", "stop", "comma", "line_words", "distinct", "repeat", "short", "ascii", "lower_start", "longest_run")

_CLASS = np.zeros((256, 8))
for _i, _chars in enumerate([range(65, 91), b"!", b"#$%&*<>=~^@", b"|", b"0123456789", b".", b",;:", range(128)]):
    _CLASS[list(_chars), _i] = 1


def features(text: str | None) -> list[float]:
    """Numbers about the form of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS if raw else np.zeros(8)
    upper, exclaim, symbol, pipe, digit, stop, comma, ascii_ = counts.tolist()
    n, words = max(1, len(raw)), raw.split()
    m = max(1, len(words))
    same = list(map(eq, words, words[1:]))
    run = best = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            best = max(best, run)
    short = sum(map((4).__gt__, map(len, words)))
    return [
        float(np.log1p(len(words))), n / m, upper / n, exclaim / m, symbol / m, pipe / m, digit / n, stop / m, comma / m,
        m / (1 + raw.count(b"\n")), len(set(words)) / m, sum(same) / m, short / m, ascii_ / n,
        sum(map(bytes.islower, words)) / m, float(np.log1p(best)),
    ]


def featurize(docs: DataFrame, score=None) -> DataFrame:
    """doc_id and features of each text, or, with score, what score gives for their matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            out = score(x) if score else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.float64() if score else pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x " + ("double" if score else "array<double>"))


@dataclass
class Gam:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins in order."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """Leaf values by bin of a tree of up to three leaves."""
    parts = [slice(0, len(g))]
    for _ in range(2):
        found = [(*_best_cut(g[p], h[p], penalty), k) for k, p in enumerate(parts)]
        gain, cut, k = max(found)
        if gain <= 1e-9:
            break
        p = parts[k]
        parts[k : k + 1] = [slice(p.start, p.start + cut), slice(p.start + cut, p.stop)]
    out = np.zeros(len(g))
    for p in parts:
        out[p] = g[p].sum() / (h[p].sum() + penalty)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis."""
    value = lambda g, h: g**2 / (h + penalty)
    cg, ch = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(h.shape, 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    if not a.size:
        return 0.0, np.zeros(g.shape)
    top_g, top_h, left_g, left_h = cg[1:-1, -1:], ch[1:-1, -1:], cg[-1:, 1:-1], ch[-1:, 1:-1]
    gain = value(a, b) + value(top_g - a, top_h - b) + value(left_g - a, left_h - b) + value(cg[-1, -1] - top_g - left_g + a, ch[-1, -1] - top_h - left_h + b)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + penalty)
    return float(gain.max() - value(cg[-1, -1], ch[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, bins: int = 32, pair_bins: int = 8, rate: float = 0.1, penalty: float = 2.0) -> Gam:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Gam(bias=float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    model = Gam(bias=float(np.log(share / (1 - share))))
    d = x.shape[1]
    model.edges = [_cuts(x[:, j], bins) for j in range(d)]
    model.pair_edges = [_cuts(x[:, j], pair_bins) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(d)]
    total = np.full(len(y), model.bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = gradient()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), penalty)
            model.tables[j] += step
            total += step[at[j]]
    at = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(d)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = gradient()
        cell, (n, m) = at[a] * shape(a, b)[1] + at[b], shape(a, b)
        return _quadrants(np.bincount(cell, g, n * m).reshape(n, m), np.bincount(cell, h, n * m).reshape(n, m), penalty)

    best = sorted(((grid(a, b)[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)[:pairs]
    model.pairs = [(a, b, np.zeros(shape(a, b))) for _, a, b in best]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            step = rate * grid(a, b)[1]
            table += step
            total += step[at[a], at[b]]
    return model


def held_out(column: str = "doc_id"):
    """Rows that are never learned from: those whose CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Gam:
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_y"))
        .where("doc_id is not null and _y in (0, 1)").where(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(TRAIN_ROWS)
    )
    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = featurize(own).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_y", "x").limit(TRAIN_ROWS).collect()
    return fit(np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r["_y"] for r in rows], dtype=float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = train(docs, labels)
    return featurize(docs, model.score).select("doc_id", held_out().alias("held_out"), F.col("x").alias("score"), (F.col("x") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text the classifier rejects (score under 0.5); rows keep all their columns."""
    model = train(docs, labels)
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(text).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
