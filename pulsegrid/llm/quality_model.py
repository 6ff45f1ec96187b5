"""Quality scores from random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words (runs of letters, of digits, or of other visible signs; words in capitals apart) hash to a fixed vocabulary. Each
has a sparse random index vector, and its word vector is the sum of the index vectors of its neighbours over the whole
corpus. A document's features are the mean and the deviation of its words' vectors, how far
neighbouring vectors lie apart, and its length. The network has one
hidden layer and learns from at most ``LABELLED_ROWS`` labels; a temperature fitted on rows kept back calibrates it.

Null and empty texts have zero features and still a score; with fewer than ten labels or one class the score is the
labels' mean (0.5 with none); repeated labels of one id count once (the smallest); repeated rows each get their score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import SPACE, held_out, hash_sample, map_texts, mixed, rows_of, runs, span_hashes, text_slices
from pulsegrid.llm.decontaminate import LOWER

VOCABULARY = 1 << 13
WIDTH = 32
NONZERO = 4
REACH = 2
LABELLED_ROWS = 20_000
HIDDEN = 24
FEATURES = 2 * WIDTH + 3

#: 0 white space, 1 letters and bytes of other scripts, 2 digits, 3 other signs.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1
KIND[48:58] = 2
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each word's index vector."""
    random = np.random.Generator(np.random.PCG64(11))
    return random.integers(0, WIDTH, (VOCABULARY, NONZERO)), random.choice(np.array([-1.0, 1.0]), (VOCABULARY, NONZERO))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number and row of each word."""
    kind = KIND[raw]
    found = [runs(kind == k, offsets) for k in (1, 2, 3)]
    starts = np.concatenate([s for s, _ in found])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([e for _, e in found])[order]
    h = span_hashes(LOWER[raw], starts, ends)
    capitals = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(CAPITAL[raw], out=capitals[1:])
    loud = (ends - starts > 1) & (capitals[ends] - capitals[starts] > (ends - starts) // 2)
    digits = kind[starts] == 2 if len(starts) else loud
    h = np.where(digits, mixed((ends - starts).astype(np.uint64)), h)
    return (mixed(h + loud.astype(np.uint64)) >> np.uint64(64 - 13)).astype(np.int64), rows_of(starts, offsets)


def contexts(word: np.ndarray, row: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each word of the vocabulary."""
    total = np.zeros(VOCABULARY * WIDTH)
    for reach in range(1, REACH + 1):
        near = row[reach:] == row[:-reach]
        a, b = word[:-reach][near], word[reach:][near]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(x * WIDTH + places[y, k], signs[y, k], VOCABULARY * WIDTH)
    return total.reshape(VOCABULARY, WIDTH)


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors over the whole of df, weighted down for words of high frequency; only sums reach the driver."""
    names = [f"v{k}" for k in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, seen = np.zeros((VOCABULARY, WIDTH)), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for _, raw, offsets in text_slices(batch, "text"):
                word, row = tokens(raw, offsets)
                seen += np.bincount(word, minlength=VOCABULARY)
                total += contexts(word, row, places, signs)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), *(pa.array(total[some, k].astype(np.int64)) for k in range(WIDTH))], ["word", "seen", *names])

    parts = df.select(F.col(text).alias("text")).mapInArrow(run, "word bigint, seen bigint, " + ", ".join(f"{n} bigint" for n in names))
    sums = parts.groupBy("word").agg(F.sum("seen").alias("seen"), *[F.sum(n).alias(n) for n in names]).toPandas()
    out, seen = np.zeros((VOCABULARY, WIDTH)), np.zeros(VOCABULARY)
    out[sums["word"]] = sums[names].to_numpy(np.float64)
    seen[sums["word"]] = sums["seen"]
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    weight = np.log1p(max(1.0, seen.sum()) / np.maximum(seen, 1)) / 10
    return (out / np.maximum(norm, 1e-9) * weight[:, None]).astype(np.float32)


def pooled(raw: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each row, the mean squared steps from a vector to the next and to the one after, and the logarithmic length."""
    n = len(offsets) - 1
    word, row = tokens(raw, offsets)
    out = np.zeros((n, FEATURES))
    if not len(word):
        return out
    counts = np.bincount(row, minlength=n)
    filled = np.flatnonzero(counts)
    firsts = (np.cumsum(counts) - counts)[filled]
    held = vectors[word].astype(np.float64)
    mean = np.add.reduceat(held, firsts, axis=0) / counts[filled, None]
    square = np.add.reduceat(held * held, firsts, axis=0) / counts[filled, None]
    out[filled, :WIDTH] = mean
    out[filled, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean**2, 0))
    for lag in (1, 2):
        near = np.flatnonzero(row[lag:] == row[:-lag])
        step = ((held[near + lag] - held[near]) ** 2).sum(axis=1)
        own = row[near]
        out[:, 2 * WIDTH + lag - 1] = np.log(0.02 + np.bincount(own, step, n) / np.maximum(np.bincount(own, minlength=n), 1))
    out[:, -1] = np.log1p(counts) / 10
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss; the temperature is the one of the least log loss on a fifth of the rows."""
    random = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 and x.shape[1] else FEATURES
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(y) < 10 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        flat.b2 = float(np.log(share / (1 - share)))
        return flat
    back = random.random(len(y)) < 0.2
    if back.all() or not back.any() or y[~back].min() == y[~back].max():
        back[:] = False
    tx, ty = x[~back], y[~back].astype(np.float64)
    net = Network(tx.mean(axis=0), tx.std(axis=0) + 1e-3, random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(ty.mean() / (1 - ty.mean()))))
    z = (tx - net.centre) / net.scale
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, size = 0, 64
    for _ in range(epochs):
        order = random.permutation(len(ty))
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            hidden = np.tanh(z[pick] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30))) - ty[pick]) / len(pick)
            inner = error[:, None] * values[2] * (1 - hidden**2)
            slopes = [z[pick].T @ inner + 1e-4 * values[0], inner.sum(axis=0), hidden.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if back.any():
        logits, truth = net.logits(x[back]), y[back]
        loss = lambda t: np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = LABELLED_ROWS) -> tuple[np.ndarray, Network]:
    """Vectors of the whole corpus and a network from a bounded sample of the labels that are not held out."""
    vectors = word_vectors(documents, text)
    sent = documents.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    sample = hash_sample(known, F.col("_key"), rows)
    taught = documents.join(F.broadcast(sample), F.col(key) == F.col("_key"))

    def run(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        x = pooled(raw, offsets, sent.value)
        return [pa.array(list(x), pa.list_(pa.float64()))]

    got = map_texts(taught.select(F.col("_key").alias("k"), F.col("_label").cast("int").alias("y"), F.col(text).alias("t")), "t", ["k", "y"], "x array<double>", run).toPandas().sort_values(["k", "y"], kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, FEATURES))
    return vectors, fit(x, got["y"].to_numpy())


def scored(df: DataFrame, vectors: np.ndarray, network: Network, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep and score of every row."""
    sent = df.sparkSession.sparkContext.broadcast((vectors, network))

    def run(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        own, net = sent.value
        return [pa.array(net.score(pooled(raw, offsets, own)), pa.float64())]

    return map_texts(df, text, list(keep), "score double", run)
