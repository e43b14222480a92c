"""Quality of a text from random-index word vectors and a two-layer network.

1. Random indexing: each word has a fixed sparse vector of signs, drawn from its hash.  A
   word's vector is the sum of those of its neighbours over all texts of the corpus.  Words
   share ``SLOTS`` slots by hash, so the table has a fixed size and tasks add up theirs.
2. A text is the mean and the spread of its words' unit vectors, rare words weighing more.
3. A two-layer network is fitted in numpy on a bounded sample of labelled rows (``FIT`` rows
   expected, by the hash of doc_id); a tenth of it is kept apart to fit the temperature that
   turns its output into probabilities.

Words are runs of letters and digits, or of other signs.  Null and empty texts score as a
text without words.  Null labels are not learnt from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from edgetide.llm import flow
from edgetide.llm.flow import Tables
from edgetide.llm.tokens import FOLDED, MIXED, flat, mixed, pieces, tokens

SLOTS = 1 << 15
WIDTH = 64
REACH = 2              # neighbours on each side
SIGNS = 2              # entries of a word's index vector
FIT = 20_000
HIDDEN = 32
EPOCHS = 30
U = np.uint64


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> U(49)).astype(np.int64)


def _survey(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's share of all word vectors, and behind them the word counts."""
    context, seen = np.zeros(SLOTS * WIDTH, np.int64), np.zeros(SLOTS, np.int64)
    for batch in rows:
        for _, data, offsets in pieces(*flat(batch["text"]), 4 << 20):
            row, word = tokens(data, offsets, MIXED, FOLDED)
            slot = _slots(word)
            seen += np.bincount(slot, minlength=SLOTS)
            for step in range(1, REACH + 1):
                same = row[step:] == row[:-step]
                for own, near in ((slot[step:][same], word[:-step][same]),
                                  (slot[:-step][same], word[step:][same])):
                    for k in range(SIGNS):
                        h = mixed(near + U(k + 1))
                        sign = ((h >> U(32)) & U(1)).astype(np.int64) * 2 - 1
                        np.add.at(context, own * WIDTH + (h & U(WIDTH - 1)).astype(np.int64), sign)
    yield from flow.batches(flow.packed(np.concatenate([context, seen])), flow.COUNTER)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weighted unit vectors of all slots, and the slots' weights."""
    parts = docs.select("text").mapInArrow(_survey, "block int, payload binary")
    with flow.settings(docs.sparkSession, flow.BATCH):
        sums = flow.gathered(parts, SLOTS * (WIDTH + 1), "int64")
    context, seen = sums[:SLOTS * WIDTH].reshape(SLOTS, WIDTH).astype(float), sums[SLOTS * WIDTH:]
    weight = 1e-3 / (1e-3 + seen / max(1, seen.sum()))
    norm = np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return (context / norm).astype(np.float32), weight.astype(np.float32)


def features(column: pa.Array, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean and spread of word vectors, the share of different words and the length, per row."""
    out = []
    for _, data, offsets in pieces(*flat(column)):
        row, word = tokens(data, offsets, MIXED, FOLDED)
        slot = _slots(word)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x = np.zeros(2 * WIDTH + 2, np.float32)
            if e > b:
                own, counts = np.unique(slot[b:e], return_counts=True)
                w = weight[own] * counts
                w /= w.sum()
                v = vectors[own]
                mean = w @ v
                x[:WIDTH] = mean
                x[WIDTH:2 * WIDTH] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
                x[-2:] = len(own) / (e - b), np.log1p(e - b) / 10
            out.append(x)
    return np.array(out, np.float32).reshape(-1, 2 * WIDTH + 2)


class Network:
    """Two layers, fitted by Adam from a fixed start; ``temperature`` divides the output."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        rng = np.random.default_rng(11)
        n = x.shape[1]
        self.weights = [rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        apart = np.arange(len(y)) % 10 == 0 if len(y) >= 100 else np.zeros(len(y), bool)
        self._fit((x[~apart] - self.mean) / self.scale, y[~apart], rng)
        if apart.any():
            self._calibrate(x[apart], y[apart])

    def _fit(self, x: np.ndarray, y: np.ndarray, rng) -> None:
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for b in range(0, len(y), 128):
                i = order[b:b + 128]
                w1, b1, w2, b2 = self.weights
                hidden = np.maximum(x[i] @ w1 + b1, 0)
                wrong = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y[i]
                back = np.outer(wrong, w2) * (hidden > 0)
                slopes = [x[i].T @ back / len(i) + 1e-4 * w1, back.mean(axis=0),
                          hidden.T @ wrong / len(i) + 1e-4 * w2, np.array([wrong.mean()])]
                step += 1
                for w, g, m in zip(self.weights, slopes, moments):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    w -= 3e-3 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        out = self.logits(x)
        loss = {t: np.mean(np.logaddexp(0, np.where(y > 0.5, -out, out) / t))
                for t in np.geomspace(0.25, 8, 61)}
        self.temperature = float(min(loss, key=loss.get))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _featured(held) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = features(batch["text"], *held.value)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array([v.tobytes() for v in x], pa.binary())],
                schema=schema)
    return run


def train(docs: DataFrame, labels: DataFrame, held_out) -> tuple[tuple, Network | float]:
    """The word vectors of all texts and the network; a constant where labels don't differ."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(word_vectors(docs))
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label")).filter(~held_out)
    n = known.count()
    share = int(min(1.0, FIT / max(n, 1)) * (1 << 30))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < share)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(sample, "doc_id") \
        .select("doc_id", "label", "text").mapInArrow(_featured(held), "doc_id long, label int, x binary")
    with flow.settings(spark, flow.BATCH):
        got = sorted(tuple(r) for r in rows.collect())      # some FIT rows
    if len({r[1] for r in got}) < 2:
        return held.value, float(got[0][1]) if got else 0.5
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], float)
    return held.value, Network(x, np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the score of each row; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in rows:
            x = features(batch["text"], *vectors)
            s = np.full(len(x), network) if isinstance(network, float) else network.scores(x)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(s, pa.float64())],
                                             names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
