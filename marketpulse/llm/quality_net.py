"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Word vectors are built over the whole corpus: every word has a sparse random
index vector, and its context vector is the sum of its neighbours' index
vectors.  Words share a fixed number of rows by hash, so the vectors have a
fixed size.  Documents are pooled vectors; a two-layer numpy network with
temperature-calibrated output scores them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketpulse.llm.common import crc32_mod

#: Rows of the vector table, length of a vector, non-zero entries of an index vector, neighbours on each side.
ROWS, DIM, NONZERO, REACH = 1 << 13, 32, 2, 2
#: Labelled documents that the network is fitted on (expected number; all where there are fewer).
TRAIN_DOCS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
#: Remembered words of a worker.
CACHE = 300_000
#: Scores from here on are predicted 1.
CUT = 0.7

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_rng = np.random.default_rng(6)
_INDEX = _rng.integers(0, DIM, (ROWS, NONZERO))
_SIGN = _rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))
_known: dict[str, int] = {}


def token_rows(text: str | None) -> np.ndarray:
    """Vector row of each word and punctuation run, in order; case counts."""
    out = []
    for w in _TOKEN.findall(text or ""):
        k = _known.get(w)
        if k is None:
            if len(_known) >= CACHE:
                _known.clear()
            k = _known[w] = zlib.crc32(w.encode("utf-8")) % ROWS
        out.append(k)
    return np.array(out, np.int64)


def _add_contexts(total: np.ndarray, texts: list[np.ndarray]) -> None:
    """Add to the flat (ROWS * DIM) sums the index vectors of the neighbours of
    each word; no pair crosses a text's end."""
    rows = np.concatenate(texts)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for d in range(1, REACH + 1):
        same = doc[:-d] == doc[d:]
        a, b = rows[:-d][same], rows[d:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(x * DIM + _INDEX[y, k], _SIGN[y, k], ROWS * DIM)


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of the table's rows, from all texts of ``docs``.

    Each task sums its texts to one table; Spark adds the tables row by row.
    The result has a fixed size.  A vector is the unit context vector plus the
    unit index vector; frequent words weigh less."""
    names = [f"v{k}" for k in range(DIM)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(ROWS * DIM), np.zeros(ROWS, np.int64)
        for b in batches:
            held, size = [], 0
            for t in [*b["text"], None]:
                rows = token_rows(t)
                if len(rows):
                    held.append(rows)
                    size += len(rows)
                if held and (size > 1_000_000 or t is None):
                    n += np.bincount(np.concatenate(held), minlength=ROWS)
                    _add_contexts(total, held)
                    held, size = [], 0
        at = np.flatnonzero(n)
        out = pd.DataFrame(total.reshape(ROWS, DIM)[at].astype(np.int64), columns=names)
        out.insert(0, "n", n[at])
        out.insert(0, "row", at)
        yield out

    schema = "row int, n long, " + ", ".join(f"{x} long" for x in names)
    got = docs.select(F.col(text).alias("text")).mapInPandas(run, schema).groupBy("row") \
        .agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toPandas()
    context, n = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    context[got["row"]], n[got["row"]] = got[names], got["n"]
    index = np.zeros((ROWS, DIM))
    for k in range(NONZERO):
        np.add.at(index, (np.arange(ROWS), _INDEX[:, k]), _SIGN[:, k])

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    share = n / max(1.0, n.sum())
    mean = (context * n[:, None]).sum(axis=0) / max(1.0, n.sum())
    scaled = context / np.maximum(n, 1)[:, None] - mean / max(1.0, n.sum()) if n.sum() else context
    return (unit(scaled) + unit(index)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


#: Length of a pooled vector: mean, deviation, likeness at ``LAGS``, log length.
LAGS = (1, 2)
POOLED = 2 * DIM + len(LAGS) + 1


def pooled(text: str | None, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A text's word vectors in one: weighted mean and deviation, mean product
    of each word's vector with the next and the next but one (high where words
    are repeated), log length.  Zeros without words."""
    rows = token_rows(text)
    out = np.zeros(POOLED)
    if not len(rows):
        return out
    total = 0.0
    for at in range(0, len(rows), 65536):
        part = rows[at:at + 65536]
        w, v = weights[part], vectors[part]
        total += float(w.sum())
        out[:DIM] += w @ v
        out[DIM:2 * DIM] += w @ (v * v)
        for k, lag in enumerate(LAGS):
            out[2 * DIM + k] += np.einsum("ij,ij->", v[lag:], v[:-lag]) if len(part) > lag else 0.0
    out[:2 * DIM] /= total
    out[DIM:2 * DIM] = np.sqrt(np.maximum(out[DIM:2 * DIM] - out[:DIM] ** 2, 0))
    out[2 * DIM:-1] /= len(rows)
    out[-1] = np.log1p(len(rows)) / 10
    return out


class Network:
    """Two dense layers on scaled inputs; ``score`` is a calibrated probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.prior, self.temperature = float(y.mean()) if len(y) else 0.5, 1.0
        self.trained = len(np.unique(y[~calibrate])) == 2
        if not self.trained:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        p = self.params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                           rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        fit, m, v, step = np.flatnonzero(~calibrate), [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(fit)
            for k in range(0, len(order), BATCH):
                at = order[k:k + BATCH]
                h = np.tanh(z[at] @ p[0] + p[1])
                error = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t[at]) / len(at)
                back = np.outer(error, p[2]) * (1 - h * h)
                grads = [z[at].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ error + DECAY * p[2], np.array([error.sum()])]
                step += 1
                for a, g, m1, v1 in zip(p, grads, m, v, strict=True):
                    m1 += 0.1 * (g - m1)
                    v1 += 0.001 * (g * g - v1)
                    a -= RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(v1 / (1 - 0.999 ** step)) + 1e-8)
        if calibrate.any():
            logit, c = self._logit(x[calibrate]), t[calibrate]
            grid = np.exp(np.linspace(-2, 3, 101))
            loss = [np.mean(np.logaddexp(0, logit / g) - c * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        return np.tanh((x - self.mean) / self.scale @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, weights: np.ndarray, key: str = "doc_id",
        text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> Network:
    """The network, fitted on about ``train_docs`` labelled rows (chosen by the
    hash of the key; all where there are fewer), a fifth of them for the
    temperature.  The keys of this sample are broadcast and its pooled vectors
    come to the driver; ``train_docs`` bounds both."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()) \
        .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    hashed = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    chosen = known.where(hashed < F.lit(1_000_000 * min(1.0, train_docs / max(1, total))))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([pooled(t, vectors, weights) for t in b])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key") \
        .select("key", "label", run("text").alias("x"), (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)) == 0).alias("calibrate"))
    got = sorted(((str(r["key"]), list(r["x"]), r["label"], r["calibrate"]) for r in rows.collect()))
    x = np.array([g[1] for g in got], np.float64).reshape(len(got), POOLED)
    return Network(x, np.array([g[2] for g in got]), np.array([g[3] for g in got], bool))


def scored(network: Network, vectors: np.ndarray, weights: np.ndarray, text: Column) -> Column:
    """Calibrated probability of label 1 for each whole text."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(network.score(np.array([pooled(t, vectors, weights) for t in b], np.float64).reshape(len(b), POOLED)))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             folds: int = 4, held: int = 2) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Labels are used only where crc32(key) modulo ``folds`` is not ``held``;
    word vectors come from all texts.  Null and empty texts have the zero
    vector and its score.  Without labels of both values the score is the
    share of ones (0.5 without any).  A null key is not held out; repeated
    rows are all scored; a key labelled twice counts as 1 if any label is.
    Other columns are not read."""
    vectors, weights = word_vectors(docs, text)
    network = fit(docs, labels.where(crc32_mod(F.col(key), folds) != held), vectors, weights, key, text, label)
    fold = crc32_mod(F.col(key), folds)
    return docs.select(F.col(key), F.coalesce(fold == held, F.lit(False)).alias("held_out"),
                       scored(network, vectors, weights, F.col(text)).alias("score")) \
        .withColumn("predicted", (F.col("score") >= CUT).cast("int"))
