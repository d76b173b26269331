"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk over trusted positives and web text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, byte_texts, give_back, parts, small_batches, word_bounds, word_hashes
from .langid import remainder

#: Trusted positives and unlabelled rows that the classifier is fitted on, at most: the first by a hash of doc_id.
POSITIVE_ROWS, UNLABELLED_ROWS = 4000, 8000
THRESHOLD = 0.3
CHUNK = 1 << 18
STEPS, RATE, DECAY, SLACK = 600, 0.05, 1e-4, 0.0

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _CALL, _SYMBOL, _OTHER = range(9)
CLASSES = 9
LAGS = (1, 2, 3, 5)


def _byte_classes() -> np.ndarray:
    """Bytes of several-byte characters are lower letters: most of them are letters, and case is told by ASCII."""
    out = np.full(256, _OTHER, np.uint8)
    out[128:] = _LOWER
    for chars, c in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\x0b\x0c\r", _SPACE), (b"\n", _LINE), (b".,;:'\"()-", _STOP), (b"!?", _CALL), (b"#*$%&|<>@^~=+_\\/{}[]`", _SYMBOL)):
        out[list(chars)] = c
    return out


BYTE_CLASS = _byte_classes()
NAMES = [f"pair_{a}{b}" for a in range(CLASSES) for b in range(CLASSES)] + [f"lag_{n}" for n in LAGS] + ["distinct_words", "distinct_lines", "words", "word_length", "line_words"]


def features(texts: list[bytes]) -> np.ndarray:
    """A row per whole text: roots of the shares of neighbouring character classes, of words equal to one a few words before, of
    distinct words and lines; logarithms of sizes. Texts are taken together."""
    out = np.zeros((len(texts), len(NAMES)), np.float32)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cls = BYTE_CLASS[buf].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    pair = doc[:-1] * CLASSES * CLASSES + cls[:-1] * CLASSES + cls[1:]
    same = doc[1:] == doc[:-1]
    counts = np.bincount(pair[same], minlength=len(texts) * CLASSES * CLASSES).reshape(len(texts), -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    begins, ends = word_bounds(buf)
    h = word_hashes(buf, begins, ends)
    of = np.searchsorted(at, begins, "right") - 1
    words = np.bincount(of, minlength=len(texts))
    some = np.maximum(words, 1)
    k = CLASSES * CLASSES
    for lag in LAGS:
        hit = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
        out[:, k] = np.sqrt(np.bincount(of[lag:][hit], minlength=len(texts)) / some)
        k += 1
    distinct = _distinct(of, h)
    out[:, k] = np.sqrt(np.bincount(distinct, minlength=len(texts)) / some)
    lines = [[x for x in t.split(b"\n") if x] for t in texts]
    out[:, k + 1] = [len(set(x)) / max(len(x), 1) for x in lines]
    out[:, k + 2] = np.log1p(words)
    out[:, k + 3] = np.log((np.bincount(of, ends - begins, len(texts)) + 1) / some)
    out[:, k + 4] = np.log1p(words / np.array([max(len(x), 1) for x in lines]))
    return out


def _distinct(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The text of each distinct word of a text. Words meet by a hash that takes in their text."""
    key = h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return of[np.unique(key, return_index=True)[1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [sigmoid((features(texts[i:j]) - self.mean) / self.scale @ self.weights + self.bias) for i, j in parts([len(t) for t in texts], CHUNK)]
        return np.concatenate(out).astype(float) if out else np.zeros(0)


def non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative unbiased risk with the logistic loss l:
    prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)]). Where the bracket, a risk of negatives, falls below zero, it has been
    overfitted, and the step goes back up its gradient alone. Adam on all rows."""
    d = positive.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    p, u = np.c_[positive, np.ones(len(positive))], np.c_[unlabelled, np.ones(len(unlabelled))]
    for t in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = (sigmoid(fu) @ u) / len(u) - prior * (sigmoid(fp) @ p) / len(p)
        g_positive = -prior * (sigmoid(-fp) @ p) / len(p)
        g = g_positive + g_negative if negative >= -SLACK else -g_negative
        g += DECAY * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE / (1 + 3 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def mixture_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Estimate, from above, of the share of positives in unlabelled text: the least ratio of how often an unlabelled row and a
    positive pass a threshold, over thresholds that at least a twentieth of the positives pass, along a rough classifier. Both
    counts are moved by their standard errors, without which the least of many ratios of few rows is too small."""
    w, b = non_negative(positive, unlabelled, 0.5, 200)
    fp, fu = positive @ w + b, unlabelled @ w + b
    cuts = np.quantile(fp, np.linspace(0, 0.95, 96))
    p, u = (np.array([(f >= c).mean() for c in cuts]) for f in (fp, fu))
    ratio = (u + np.sqrt(u * (1 - u) / len(fu))) / np.maximum(p - np.sqrt(p * (1 - p) / len(fp)), 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.99))


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    """Learns from rows whose fold isn't 0: trusted positives (quality 1), and text whatever its label as unlabelled. The class prior
    is estimated from the mixture; labels 0 are never used. None if there are no positives. At most positive_rows ids are broadcast;
    the driver gets at most twice as many rows of len(NAMES) floats as may be fitted on (more than once only if ids repeat)."""
    known = labels.filter((remainder() != 0) & (F.col("quality").cast("int") == 1)).select("doc_id").distinct()
    h = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    positives = known.withColumn("_h", h).orderBy("_h", "doc_id").limit(positive_rows).select("doc_id", F.lit(True).alias("_p"))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter((remainder() != 0) & F.col("text").isNotNull()).withColumn("_h", F.xxhash64("doc_id", "text"))
    cut = own.select("_h").orderBy("_h").limit(unlabelled_rows).agg(F.max("_h")).first()[0]
    if cut is None:
        return None
    # Equal rows count once, so a hash that very many of them share takes no more than one.
    rows = own.join(F.broadcast(positives), "doc_id", "left").withColumn("_u", F.col("_h") <= cut).filter("_u or _p").dropDuplicates(["_h"])
    got = arrow_map(rows.select("_h", "_u", F.coalesce("_p", F.lit(False)).alias("_p"), "text"), _rows, "h long, u boolean, p boolean, x binary").orderBy("h").limit(2 * (positive_rows + unlabelled_rows)).toPandas()
    if not got.p.any():
        return None
    x = np.stack([np.frombuffer(b, np.float32) for b in got.x]).astype(float)
    p, u = x[got.p.to_numpy()], x[got.u.to_numpy()]
    mean, scale = u.mean(0), np.maximum(u.std(0), 0.02)
    p, u = (p - mean) / scale, (u - mean) / scale
    prior = mixture_prior(p, u)
    w, b = non_negative(p, u, prior)
    return Model(mean, scale, w, b, prior)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    texts = byte_texts(batch["text"])
    for i, j in parts([len(t) for t in texts], CHUNK):
        yield {k: batch[f"_{k}"].slice(i, j - i) for k in "hup"} | {"x": [r.tobytes() for r in features(texts[i:j])]}


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every whole text, by a model fitted on docs and labels if none is given.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. Returns a row per row of docs: doc_id, held_out (fold 0),
    score (0 to 1, higher: label 1 is likelier), predicted (1 if score >= threshold). A null text is scored as an empty one. A null
    doc_id is in no fold: not learnt from, not held out. Without positives, scores are 0.5. Labels, lang, source and doc_id have no
    part in a score.
    """
    model = model or fit(docs, labels)

    def run(batch: pa.RecordBatch) -> dict:
        s = model.scores(byte_texts(batch["text"])) if model else np.full(batch.num_rows, 0.5)
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were; no shuffle of documents."""
    model = fit(docs, labels)
    if model is None:
        return docs
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        out = [model.scores([t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in text[k : k + SLICE]]) for k in range(0, len(text), SLICE)]
        give_back()
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.filter(score("text") >= threshold)
