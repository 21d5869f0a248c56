"""Quality classifier: document scores learned from preference pairs (Bradley-Terry).

A document's score is a weighted sum of features of its whole text. Of a labelled sample, pairs of a good and a bad
document are drawn, and the weights fitted so that the logistic function of the score difference says which is the
better one. Scores are thresholded at the quantile that the share of bad documents among the labelled ones names, and
mapped to 0..1 so that the threshold is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import textkit as tk
from commstream.llm.language_id import held_out

TRAIN_ROWS = 6000
PAIRS = 60_000
STEPS = 400

_CLASS = np.zeros(256, np.int64)  # 1 lower case, 2 upper case, 3 digit, 4 plain punctuation, 5 other ASCII sign, 6 white space, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7
NAMES = ("upper", "digit", "plain", "sign", "space", "beyond", "line_feed", "pipe", "exclamation", "word_length", "signed_words", "upper_words", "distinct", "top", "adjacent", "pairs_distinct", "log_words", "log_chars", "single")


def features(array: pa.Array) -> np.ndarray:
    """A row of features for each text; null and empty texts: zeros."""
    data, offsets = tk.text_bytes(array)
    starts, ends, first = tk.word_spans(data, offsets)
    words = tk.word_hashes(data, starts, ends)
    pairs = tk.run_hashes(words, 2)
    out = np.zeros((len(array), len(NAMES)))
    kinds = _CLASS[data]
    size = ends - starts
    signed = (kinds[ends - 1] == 5) if len(ends) else np.zeros(0, bool)
    capital = np.zeros(len(starts), bool)
    if len(starts):
        upper = np.concatenate([[0], np.cumsum(kinds == 2)])
        lower = np.concatenate([[0], np.cumsum(kinds == 1)])
        capital = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    for i in range(len(array)):
        a, b, lo, hi = int(offsets[i]), int(offsets[i + 1]), int(first[i]), int(first[i + 1])
        if b == a:
            continue
        own, share = data[a:b], np.bincount(kinds[a:b], minlength=8) / (b - a)
        out[i, :6] = share[2:8]
        out[i, 6:9] = [np.count_nonzero(own == c) / (b - a) for c in (10, 124, 33)]
        if n := hi - lo:
            _, counts = np.unique(words[lo:hi], return_counts=True)
            out[i, 9:16] = (
                min(size[lo:hi].mean(), 40) / 10, signed[lo:hi].mean(), capital[lo:hi].mean(), len(counts) / n, counts.max() / n,
                (words[lo + 1 : hi] == words[lo : hi - 1]).sum() / n, len(np.unique(pairs[lo : hi - 1])) / (n - 1) if n > 1 else 1.0,
            )
        out[i, 16:19] = np.log1p(hi - lo), np.log1p(b - a), float(hi - lo <= 1)
    return out


@dataclass
class Ranking:
    """Means and scales of the features, weights of all and of their squares, threshold and slope of the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.abs(z), np.sqrt(np.abs(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.score(x) - self.threshold), -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 3) -> Ranking:
    """Bradley-Terry weights by gradient steps on the logistic loss of feature differences, with weight decay."""
    model = Ranking(x.mean(0), x.std(0) + 1e-6, np.zeros(3 * x.shape[1]))
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(best) or not len(worst):
        model.threshold = -1.0 if len(best) else 1.0
        return model
    rng, phi = np.random.default_rng(seed), model.basis(x)
    a, b = rng.choice(best, PAIRS), rng.choice(worst, PAIRS)
    m, v = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for step in range(1, STEPS + 1):
        part = slice((step * 4000) % PAIRS, (step * 4000) % PAIRS + 4000)
        d = phi[a[part]] - phi[b[part]]
        g = -(d / (1 + np.exp(np.clip(d @ model.weights, -500, 500)))[:, None]).mean(0) + 1e-3 * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weights -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = phi @ model.weights
    model.threshold = float(np.quantile(s, (~good).mean()))
    for _ in range(50):  # the slope of least log loss, the threshold held
        t = s - model.threshold
        p = 1 / (1 + np.exp(-np.clip(model.slope * t, -500, 500)))
        model.slope = max(0.05, model.slope - float(((p - good) * t).mean() / ((p * (1 - p) * t * t).mean() + 1e-4)))
        model.slope = min(model.slope, 20.0)
    return model


def _measure(batches):
    for batch in tk.slices(batches):
        x = features(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking | None:
    """Fit on at most about TRAIN_ROWS labelled rows, drawn by a hash of the key. None: no labelled row."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).groupBy(F.col(key_col).cast("long").alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    unit = F.pmod(F.xxhash64("key", F.lit(31)), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.where(unit < TRAIN_ROWS / max(1, known.count())).limit(2 * TRAIN_ROWS)
    texts = docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "key").select("key", "y", "text").mapInArrow(_measure, "key long, y int, x array<double>").limit(4 * TRAIN_ROWS).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("key", kind="stable")
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy() == 1)


def _score(model: Ranking | None):
    def run(batches):
        for batch in tk.slices(batches):
            p = model.probability(features(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    return run


def score_quality(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), a row for each row of docs, from whole texts in one pass.

    Null and empty texts have zero features and a score like any other; without a model all scores are 0.5. Null and
    repeated ids pass through, extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(model), "id long, score double").withColumnRenamed("id", id_col)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels that are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs, train(docs, labels.where(~held_out(F.col("doc_id"), 3, 1))))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
