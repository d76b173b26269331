"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_map_all, parts

#: Rows that the classifier is fitted on, at most, and those that its temperature is set on: of each language, the first by a hash.
FIT_ROWS, CALIBRATION_ROWS = 6000, 2000
#: Languages that can be learnt, at most: those of most rows.
LANGUAGES = 256
#: Hashed n-grams of 1 to 3 characters, in so many columns.
COLUMNS, ORDERS = 1 << 15, (1, 2, 3)
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 0.05, 1.0
CHUNK = 1 << 18
SCALE = 20.0


def letters() -> np.ndarray:
    """True for the code points of letters; kept by the worker."""
    import sys

    if (kept := sys.__dict__.get("_tokenpress_letters")) is None:
        kept = sys.__dict__["_tokenpress_letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return kept


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed columns of the n-grams of texts taken together (lower case; what is no letter is a space, of which runs count once),
    a row for each order; where each text begins in them; and which texts have a letter. Behind its end a text goes on with
    spaces, so what stands next to it in a batch has no part in its n-grams."""
    low = [t.lower() + " " for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([0, *map(len, low)])
    alpha = letters()[cp]
    some = np.add.reduceat(alpha, at[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    cp = np.where(alpha, cp, np.uint32(32))
    keep = alpha | np.r_[True, alpha[:-1]]
    keep[at[1:] - 1] = True
    at = np.r_[0, np.cumsum(keep)][at]
    cp = cp[keep].astype(np.uint64)
    out, h = [], np.zeros(len(cp), np.uint64)
    for n in range(max(ORDERS)):
        ahead = np.r_[cp[n:], np.full(min(n, len(cp)), 32, np.uint64)]
        for k in range(1, min(n, len(cp)) + 1):
            ahead[at[1:] - k] = 32  # of a text of under n characters, these are the last ones of the text before it too
        h = (h + ahead + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n + 1 in ORDERS:
            out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15)).astype(np.int32))
    return out, at, some


def column_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and term frequencies of a text."""
    rows, at, _ = grams([text])
    cols, n = np.unique(np.concatenate(rows), return_counts=True)
    return cols, n / n.sum()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, over all rows; each task sends COLUMNS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        df, n = np.zeros(COLUMNS, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for i, j in parts([len(t) for t in texts], CHUNK):
                rows, at, some = grams(texts[i:j])
                n += int(some.sum())
                seen = np.zeros(COLUMNS, bool)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    for r in rows:
                        seen[r[a:b]] = True
                    df += seen
                    seen[:] = False
        # Sparse: columns that the task met.
        met = np.flatnonzero(df)
        yield {"col": np.r_[met, -1], "n": np.r_[df[met], n]}

    sums = arrow_map_all(docs.select("text"), run, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).toPandas()  # at most COLUMNS + 1 rows
    out = np.zeros(COLUMNS, np.int64)
    real = sums[sums.col >= 0]
    out[real.col.to_numpy()] = real.n.to_numpy()
    return out, int(sums[sums.col < 0].n.sum())


@dataclass
class Model:
    """weights: COLUMNS x languages, already times idf; the logits of a text are their mean over its n-grams, plus bias."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, at, some = grams(texts)
        n = np.diff(at)[:, None] * len(rows)
        total = np.zeros((len(texts), len(self.languages)), np.float64)
        for r in rows:
            total += np.add.reduceat(self.weights[r], at[:-1], axis=0, dtype=np.float64)
        return (total / n * SCALE + self.bias) / self.temperature, some

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores: list[np.ndarray] = []
        for i, j in parts([len(t) for t in texts], CHUNK):
            z, some = self.logits(texts[i:j])
            p = softmax(z)
            langs += [self.languages[k] if s else "und" for k, s in zip(p.argmax(1).tolist(), some.tolist())]
            scores.append(np.where(some, p.max(1), 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net: sparse weights (columns x classes) and bias. rows: columns, values, class."""
    z, n = np.zeros((COLUMNS + 1, classes)), np.zeros((COLUMNS + 1, classes))

    def weights(at) -> np.ndarray:
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            cols, values, y = rows[k]
            cols, values = np.r_[cols, COLUMNS], np.r_[values, 1.0][:, None]
            w = weights(cols)
            g = softmax((w * values).sum(0))
            g[y] -= 1.0
            g = values * g
            sigma = (np.sqrt(n[cols] + g * g) - np.sqrt(n[cols])) / ALPHA
            z[cols] += g - sigma * w
            n[cols] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm. As in Platt's scaling, a row's target is not 1 but
    (n + 1) / (n + classes), so that separable rows don't make it endless."""
    n, k = z.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)
    loss = lambda t: -(target * np.log(np.maximum(softmax(z / np.exp(t)), 1e-300))).sum(1).mean()
    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def remainder() -> F.Column:
    """The fold of a row: crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many rows each group may give to `most` in all: small groups all they have, the others equal parts of the rest."""
    out, left = {}, most
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, left // (len(sizes) - k))
        left -= out[name]
    return out


def first_by_hash(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Rows (doc_id, text) with _h, a hash of both: of each of the LANGUAGES largest groups about its share of `most`, those of least
    hash. No group is sorted: its size tells up to which hash its rows are taken, with some to spare. Equal rows count once."""
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    sizes = {r[by]: r.n for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(LANGUAGES).collect()}
    part = {k: min(1.0, (q + 6 * q**0.5 + 10) / sizes[k]) for k, q in shares(sizes, most).items()}
    cuts = [(k, min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63))) for k, x in part.items()]
    cut = rows.sparkSession.createDataFrame(cuts, f"{by} string, _cut long")
    return rows.join(F.broadcast(cut), by).filter("_h <= _cut").dropDuplicates(["_h", by])  # at most LANGUAGES rows


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Learns from rows with a non-null lang and text whose fold isn't 0; None if there are none. Document frequencies are over all
    of them; weights over at most fit_rows, temperature over at most calibration_rows others, of each language as many as of the
    others or all it has (first_by_hash), so that no language is too rare to be learnt. The driver gets those rows' columns and
    frequencies, at most COLUMNS each."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(own)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    some = first_by_hash(own, "lang", fit_rows + calibration_rows)

    def run(batch: pa.RecordBatch) -> dict:
        made = [column_counts(t) for t in batch["text"].to_pylist()]
        return {"h": batch["_h"], "lang": batch["lang"], "cols": [c.astype("<i4").tobytes() for c, _ in made], "tf": [v.astype("<f4").tobytes() for _, v in made]}

    rows = arrow_map(some.select("_h", "lang", "text"), run, "h long, lang string, cols binary, tf binary").orderBy("h", "lang").toPandas()
    rows = rows[rows.groupby("lang").cumcount() < rows.lang.map(shares(rows.lang.value_counts().to_dict(), fit_rows + calibration_rows))]
    languages = sorted(rows.lang.unique())
    data = [(c := np.frombuffer(r.cols, "<i4"), np.frombuffer(r.tf, "<f4").astype(float) * idf[c] * SCALE, languages.index(r.lang)) for r in rows.itertuples() if len(r.cols)]
    held = data[::4][:calibration_rows]
    fitted = [x for k, x in enumerate(data) if k % 4 or k // 4 >= calibration_rows][:fit_rows] or data
    w, bias = follow_the_leader(fitted, len(languages))
    model = Model(languages, (w * idf[:, None]).astype(np.float32), bias)
    z = np.array([(w[c] * v[:, None]).sum(0) + bias for c, v, _ in held])
    model.temperature = calibrated(z, np.array([y for _, _, y in held]))
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predicts the language of every whole text, by a model fitted on docs itself if none is given.

    docs: doc_id, text, lang; other columns are ignored. Returns a row per row: doc_id, held_out (fold 0), lang_pred (`und` if text
    is null or has no letter, or if there was nothing to learn from), score (probability, 0 for und). A null doc_id is in no fold:
    not learnt from, not held out. lang, source and doc_id have no part in a prediction.
    """
    model = model or fit(docs)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch["text"].to_pylist()]
        langs, scores = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": langs, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
