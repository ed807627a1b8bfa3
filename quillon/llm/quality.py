"""Document quality by a factorisation machine.

A document is a sparse vector: hashed words, structure statistics and hashed
metadata. The machine adds to a linear model the interaction of every pair of
features as the inner product of their low-rank factors, computed in time
linear in the features: the sum over factors of (sum v x)^2 - sum (v x)^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, word_hashes

BUCKETS = 1 << 15
RANK = 8
#: Labelled documents of each class used for training and calibration, at most.
MAX_LABELLED = 2000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.08, 1e-5
#: A good document rejected weighs as much as this many bad ones kept.
LOSS_OF_GOOD = 5.0
STATS = 9
META = 64
SIZE = BUCKETS + META + STATS


def text_stats(text: str) -> list[float]:
    """Shares of kinds of bytes and shapes of words and lines, each about 0 to 1."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, len(data))
    upper = np.count_nonzero((data >= 65) & (data <= 90))
    digit = np.count_nonzero((data >= 48) & (data <= 57))
    space = np.count_nonzero(data <= 32)
    plain = np.count_nonzero(((data >= 97) & (data <= 122)) | (data >= 128))
    lines = text.split("\n")
    return [
        upper / n, digit / n, space / n, (n - upper - digit - space - plain) / n, plain / n,
        min(1.0, n / (10.0 * (space + 1))), min(1.0, np.log1p(n) / 12), len(set(lines)) / len(lines), min(1.0, n / (400.0 * len(lines))),
    ]


@dataclass
class Sparse:
    """Rows of a sparse matrix: row r has columns[ends[r-1]:ends[r]]."""

    columns: np.ndarray
    values: np.ndarray
    ends: np.ndarray


def features(texts: list[str | None], hashes: list[np.ndarray], meta: list[list[int]]) -> Sparse:
    """Word counts damped by a square root and scaled to unit length, statistics, and metadata."""
    columns, values, sizes = [], [], []
    for text, words, tags in zip(texts, hashes, meta):
        at, counts = np.unique(words, return_counts=True)
        weight = np.sqrt(counts)
        weight /= max(1e-9, float(np.sqrt(counts.sum())))
        columns += [at, BUCKETS + np.asarray(tags, dtype=np.int64), np.arange(SIZE - STATS, SIZE)]
        values += [weight, np.full(len(tags), 0.5), np.array(text_stats(text or ""))]
        sizes.append(len(at) + len(tags) + STATS)
    return Sparse(np.concatenate(columns).astype(np.int64), np.concatenate(values).astype(np.float32), np.cumsum(sizes))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    threshold: float = 0.5

    def parts(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums of v x, by row."""
        starts = np.concatenate([[0], x.ends[:-1]])
        vx = self.factors[x.columns] * x.values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        line = np.add.reduceat(self.linear[x.columns] * x.values, starts)
        return self.bias + line + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def probability(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(x)[0], -30, 30)))


def _rows(x: Sparse, rows: np.ndarray) -> Sparse:
    starts = np.concatenate([[0], x.ends[:-1]])
    take = np.concatenate([np.empty(0, dtype=np.int64), *[np.arange(starts[r], x.ends[r]) for r in rows]])
    return Sparse(x.columns[take], x.values[take], np.cumsum(x.ends[rows] - starts[rows]))


def train(x: Sparse, y: np.ndarray, seed: int = 3) -> Machine:
    """Adagrad over four in five rows, classes weighted alike; the fifth sets the threshold.

    With rows of one class only, or none, everything is kept; with too few
    rows for a fifth that has both classes the threshold is one half.
    """
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE, dtype=np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    if len(np.unique(y)) < 2:
        machine.threshold = 0.0
        return machine
    held_out = np.arange(len(y)) % 5 == 4
    own = np.flatnonzero(~held_out)
    weight = np.where(y == 1, 0.5 / max(1, (y[own] == 1).sum()), 0.5 / max(1, (y[own] == 0).sum())) * len(own)
    g_bias, g_linear, g_factors = 1e-6, np.full(SIZE, 1e-6, dtype=np.float32), np.full((SIZE, RANK), 1e-6, dtype=np.float32)
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for at in range(0, len(own), BATCH):
            rows = own[at : at + BATCH]
            b = _rows(x, rows)
            raw, sums = machine.parts(b)
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            row = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], b.ends])))
            pull = (error[row] * b.values)[:, None]
            slope = pull * (sums[row] - machine.factors[b.columns] * b.values[:, None])
            columns, inverse = np.unique(b.columns, return_inverse=True)
            d_linear, d_factors = np.zeros(len(columns), dtype=np.float32), np.zeros((len(columns), RANK), dtype=np.float32)
            np.add.at(d_linear, inverse, pull[:, 0])
            np.add.at(d_factors, inverse, slope)
            d_linear += DECAY * machine.linear[columns]
            d_factors += DECAY * machine.factors[columns]
            g_linear[columns] += d_linear**2
            g_factors[columns] += d_factors**2
            machine.linear[columns] -= RATE * d_linear / np.sqrt(g_linear[columns])
            machine.factors[columns] -= RATE * d_factors / np.sqrt(g_factors[columns])
            g_bias += float(error.sum()) ** 2
            machine.bias -= RATE * float(error.sum()) / g_bias**0.5
    check = np.flatnonzero(held_out)
    if len(np.unique(y[check])) < 2:
        return machine
    p, t = machine.probability(_rows(x, check)), y[check]
    good, bad = np.sort(p[t == 1]), np.sort(p[t == 0])
    cuts = np.unique(np.concatenate([p, [0.0, 0.5, 1.0]]))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    cost = LOSS_OF_GOOD * np.searchsorted(good, cuts) / max(1, len(good)) + 1 - np.searchsorted(bad, cuts) / max(1, len(bad))
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    machine.threshold = float(cuts[best[len(best) // 2]])
    return machine


def metadata_buckets(docs: DataFrame, names: list[str]) -> Column:
    """Hashed name=value pairs; NULL is a value."""
    pair = lambda c: F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))), F.lit(META)).cast("int")
    return F.array(*[pair(c) for c in names]) if names else F.array().cast("array<int>")


def word_buckets(text: Column) -> Column:
    return F.transform(word_hashes(text), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, metadata: list[str], limit: int = MAX_LABELLED, ident: str = "doc_id", text: str = "text") -> Machine:
    """A machine from the documents that ``labels`` (doc_id, quality) names, at most ``limit`` of each class, chosen by a hash of the id."""
    named = labels.select(F.col(ident).alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    picked = [named.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    found = (
        docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).alias("_text"), word_buckets(F.col(text)).alias("_words"), metadata_buckets(docs, metadata).alias("_meta"))
        .join(chosen, "_id").orderBy(F.xxhash64("_id"), "_id", "_text").toArrow()
    )
    if not found.num_rows:
        return Machine(0.0, np.zeros(SIZE, dtype=np.float32), np.zeros((SIZE, RANK), dtype=np.float32), 0.0)
    x = features(found["_text"].to_pylist(), [np.asarray(w.values) for w in found["_words"]], found["_meta"].to_pylist())
    return train(x, found["_y"].to_numpy().astype(np.float32))


def with_quality(docs: DataFrame, machine: Machine, metadata: list[str], name: str, text: str = "text") -> DataFrame:
    """Add the probability that a document is good.

    Every row gets one: NULL and empty texts are judged by statistics and
    metadata alone, NULL metadata is a value of its own, repeated rows are
    judged alike, and texts are read whole. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def judged(texts: pa.Array, words: pa.Array, meta: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        flat, ends = np.asarray(words.values), np.asarray(words.offsets)
        out = []
        for a in range(0, len(texts), 256):
            b = min(a + 256, len(texts))
            x = features(texts[a:b].to_pylist(), [flat[ends[i] : ends[i + 1]] for i in range(a, b)], meta[a:b].to_pylist())
            out.append(shared.value.probability(x))
        return pa.array(np.concatenate(out), pa.float64())

    return docs.withColumn(name, judged(F.col(text), word_buckets(F.col(text)), metadata_buckets(docs, metadata)))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: (doc_id, score, keep)."""
    docs, metadata = documents(spark, sf_dir), ["lang", "source"]
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata)
    return with_quality(docs, machine, metadata, "score").select("doc_id", "score", (F.col("score") >= F.lit(machine.threshold)).alias("keep"))
