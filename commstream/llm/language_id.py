"""Language ID: a convolutional network over bytes, trained in numpy, applied to batched windows of whole texts.

A text is cut into windows of WINDOW bytes. Filters of widths 2, 3 and 4 slide over a window's bytes; each is a sum of
one weight table per offset, so that pairs of bytes are looked up in tables joined beforehand. ReLU, the maximum over
the window, a dense layer and softmax give probabilities; a text's are the mean over its windows by their bytes.
"""

from __future__ import annotations

import base64
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import textkit as tk

WINDOW = 256
WIDTHS = (2, 3, 4)
FEWEST_FILTERS = 8
MOST_FILTERS = 64
TRAIN_ROWS_PER_LANGUAGE = 400
#: Rows drawn in all. Of more languages than TRAIN_ROWS / TRAIN_ROWS_PER_LANGUAGE each has fewer rows, none goes.
TRAIN_ROWS = 100_000
TRAIN_BYTES = 3 * WINDOW
EPOCHS = 12
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode class L stands in the text."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with zeros; the text of each and how many of its bytes are text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((int(first[-1]), WINDOW), np.uint8)
    out.ravel()[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], sizes)] = data
    owner = np.repeat(np.arange(len(sizes)), counts)
    filled = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return out, owner, filled


class ByteCnn:
    """Tables of each width's filters by offset and byte, their biases, and the dense layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = min(MOST_FILTERS, max(FEWEST_FILTERS, 2 * len(languages)))  # of each width
        self.tables = [rng.normal(0, 0.3, (w, 256, self.filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(self.filters, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (self.filters * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def _convolve(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filters of each window and where each filter was largest; for training."""
        pooled, where = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = WINDOW - w + 1
            z = sum(table[j][x[:, j : j + n]] for j in range(w)) + bias
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            where.append(at)
        return np.hstack(pooled), np.hstack(where)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.dense, self.offset]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at : at + 128]
                own, target = x[rows], np.eye(len(self.languages), dtype=np.float32)[y[rows]]
                z, where = self._convolve(own)
                h = np.maximum(z, 0)
                p = h @ self.dense + self.offset
                p = np.exp(p - p.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - target) / len(rows)
                dz = (d @ self.dense.T) * (z > 0)
                grads = [np.zeros_like(t) for t in self.tables] + [np.zeros_like(b) for b in self.bias] + [h.T @ d, d.sum(0)]
                col = np.arange(self.filters)
                for i, w in enumerate(WIDTHS):
                    part = slice(i * self.filters, (i + 1) * self.filters)
                    for j in range(w):
                        np.add.at(grads[i][j], (np.take_along_axis(own, where[:, part] + j, 1), col[None]), dz[:, part])
                    grads[len(WIDTHS) + i] = dz[:, part].sum(0)
                step += 1
                for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    p -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)

    def joined(self) -> list[np.ndarray]:
        """Tables by pair of bytes: both of width 2, the first two of width 3, then either half of width 4."""
        pair = lambda a, b: (b[:, None, :] + a[None, :, :]).reshape(65536, self.filters)  # noqa: E731  index: second x 256 + first
        two, three, four = self.tables
        return [pair(two[0], two[1] + self.bias[0]), pair(three[0], three[1] + self.bias[1]), three[2], pair(four[0], four[1] + self.bias[2]), pair(four[2], four[3])]

    def predict(self, x: np.ndarray, joined: list[np.ndarray]) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        two, three, last, four, rest = joined
        for at in range(0, len(x), 64):
            own = x[at : at + 64].astype(np.intp)
            pairs = own[:, 1:] * 256 + own[:, :-1]
            n = WINDOW - 1
            h = [two[pairs].max(1), (three[pairs[:, : n - 1]] + last[own[:, 2:]]).max(1), (four[pairs[:, : n - 2]] + rest[pairs[:, 2:]]).max(1)]
            z = np.maximum(np.hstack(h), 0) @ self.dense + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 64] = z / z.sum(1, keepdims=True)
        return out


def noise(n: int, seed: int = 9) -> list[str]:
    """Texts in no language, from a seeded generator: letters at random, signs, numbers, hexadecimal, base 64, and
    characters of one script at random."""
    rng = random.Random(seed)
    scripts = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    pool = lambda s: lambda: "".join(rng.choices(s, k=rng.randint(2, 12)))

    def one():
        lo, hi = rng.choice(scripts)
        made = rng.choice([
            pool(string.ascii_lowercase), pool(string.ascii_letters), pool(string.punctuation), pool(string.digits), pool(string.printable[:94]),
            lambda: rng.randbytes(rng.randint(8, 40)).hex(), lambda: base64.b64encode(rng.randbytes(rng.randint(20, 60))).decode(), lambda: "".join(chr(rng.randint(lo, hi)) for _ in range(rng.randint(2, 8))),
        ])
        return " ".join(made() for _ in range(rng.randint(3, 90)))

    return [one() for _ in range(n)]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", noise_rows: int = 0) -> ByteCnn | None:
    """Fit on a bounded sample: about TRAIN_ROWS_PER_LANGUAGE rows of every language, TRAIN_ROWS in all.

    Rows are drawn in the order of a hash of key and text, a run of TRAIN_BYTES bytes at a hashed place of each; so
    reruns learn from the same rows, with repeated and null keys too. noise_rows adds a class of its own, `und`, of
    so many texts in no language. None: no labelled row.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(key_col).cast("string").alias("k"), F.col(lang_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("t"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, min(TRAIN_ROWS_PER_LANGUAGE, TRAIN_ROWS // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for y, n in sorted(counts.items()) for x in (y, max(1.2 * each, each + 12) / n)]), F.col("y"))
    unit = F.pmod(F.xxhash64("k", "y", F.length("t"), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    start = (F.pmod(F.xxhash64("k", F.lit(23)), F.greatest(F.length("t") - TRAIN_BYTES, F.lit(1))) + 1).cast("int")
    drawn = known.withColumn("unit", unit).where(F.col("unit") < share).select("unit", "k", "y", F.col("t").substr(start, F.lit(TRAIN_BYTES)).alias("t"))
    rows = drawn.orderBy("unit", "k", "y", "t").limit(2 * each * len(counts)).toPandas()
    languages = sorted({*rows["y"], *([UNDETERMINED] if noise_rows else [])}) or sorted(counts)
    model = ByteCnn(languages)
    raw = [t.encode()[:TRAIN_BYTES] for t in [*rows["t"], *noise(noise_rows)]]
    x, owner, filled = windows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
    at = {v: i for i, v in enumerate(languages)}
    y = np.array([at[v] for v in [*rows["y"], *[UNDETERMINED] * noise_rows]], np.int64)
    if len(x):
        model.fit(x, y[owner])
    return model


def _languages(model: ByteCnn | None, joined: list | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model:
        x, owner, filled = windows(*tk.text_bytes(texts))
        p = model.predict(x, joined) * filled[:, None]
        total = np.zeros((len(texts), len(model.languages)))
        np.add.at(total, owner, p)
        size = np.maximum(np.bincount(owner, filled, len(texts)), 1)
        if UNDETERMINED in model.languages:  # the class of noise wins by more than half alone
            noisy = model.languages.index(UNDETERMINED)
            total[2 * total[:, noisy] <= size, noisy] = 0
        for i, text in enumerate(texts.to_pylist()):
            if text and has_letter(text):
                best = int(total[i].argmax())
                lang[i], score[i] = model.languages[best], min(1.0, total[i, best] / size[i])
    return lang, score


def _predict(model: ByteCnn | None):
    def run(batches):
        joined = model.joined() if model else None
        for batch in tk.slices(batches):
            lang, score = _languages(model, joined, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def keep_identified(docs: DataFrame, model: ByteCnn | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is determined with a score of at least ``least``.

    Null texts and those without a letter go. Without a model (no labelled row anywhere) every text with a letter
    stays. Repeated rows stay as often as they come, an empty table stays empty, long texts are judged whole.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        joined = model.joined() if model else None
        for batch in tk.slices(batches, text_col):
            if model is None:
                yield batch.filter(pa.array([bool(t) and has_letter(t) for t in batch.column(at).to_pylist()], pa.bool_()))
                continue
            lang, score = _languages(model, joined, batch.column(at))
            yield batch.filter(pa.array((np.array(lang) != UNDETERMINED) & (score >= least)))

    return docs.mapInArrow(tk.released(run), docs.schema)


def identify(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), a row for each row of docs, in one pass over whole texts.

    score is the mean probability of the predicted language; of languages that tie the first by code point is taken.
    Texts that are null or hold no letter (Unicode class L), and all texts where there is no model, are `und` with
    score 0. Long texts are read whole, window by window. Null and repeated ids pass through, extra columns are
    ignored, an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(tk.released(_predict(model)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(key, modulus: int, remainder: int) -> F.Column:
    """Whether the CRC-32 of the key as text has this remainder; null keys: false."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
