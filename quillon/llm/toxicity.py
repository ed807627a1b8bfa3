"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text. Every window of a document is compressed with each; where the toxic
dictionary gives fewer bytes the window resembles toxic text. A document's
score sums what its windows save beyond a margin; margin and threshold are
calibrated on labelled documents that the training didn't see.

Toxic documents are mostly made of ordinary words, so a dictionary trained on
all of their text is one of ordinary text (see README for figures). The toxic
dictionary is therefore trained on those stretches of toxic texts that recur
among them and are rare in ordinary ones, and used in addition to the one
trained on ordinary text; the ordinary side has filler of the same size, so
that nothing else differs. Bytes are marked by their place in the word, so that
only beginnings of words match beginnings of words.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh

#: Labelled documents of each class used for training and calibration, at most.
MAX_LABELLED = 2500
WINDOW_WORDS = 8
#: Bytes of the dictionaries, and of the pieces of text that the ordinary one is trained on.
ORDINARY_BYTES, TOXIC_BYTES, PIECE = 32_768, 2_048, 256
#: Lengths in bytes of the runs by which toxic stretches are told.
GRAMS = range(4, 9)
#: Such a run is this many times as frequent in toxic documents, at least, and occurs in this many of them.
RATIO, LEAST = 6.0, 4
#: Bytes that a window must save before it counts; calibrated.
MARGINS = range(4)
#: A falsely rejected document weighs as much as this many missed ones.
FALSE_ALARM = 5.0
SPACE = 32
#: Ends every window and starts both dictionaries: a window is then always worth compressing.
ANCHOR = bytes(range(200, 256))
#: The last bytes of a dictionary aren't indexed.
TAIL = bytes(range(1, 17))


def mark(data: bytes) -> bytes:
    """Shift each byte by its place in its word; spaces stay."""
    a = np.frombuffer(data, dtype=np.uint8)
    at = np.arange(len(a))
    place = np.minimum(at - np.maximum.accumulate(np.where(a == SPACE, at, 0)), 15).astype(np.uint8)
    return np.where(a == SPACE, np.uint8(SPACE), a + place * np.uint8(29)).astype(np.uint8).tobytes()


def windows(text: str) -> list[bytes]:
    """Marked windows of WINDOW_WORDS words that cover the whole text; none for a text without words."""
    words = text.lower().split()
    if not words:
        return []
    plain = (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass")
    ends = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == SPACE)
    data, last = mark(plain), len(ends) - 1
    return [data[ends[i] : ends[min(i + WINDOW_WORDS, last)] + 1] + ANCHOR for i in range(0, last, WINDOW_WORDS)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=4, target_length=64,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def distinct(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones: a copied text is evidence once."""
    seen: set[tuple[str, ...]] = set()
    out = []
    for text in texts:
        words = text.lower().split()
        grams = set(zip(words, words[1:], words[2:]))
        if not grams or len(grams & seen) <= 0.3 * len(grams):
            out.append(text)
        seen |= grams
    return out


def prepared(text: str) -> bytes:
    """The marked words of a text, a space around each."""
    return mark((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"))


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """Hashes of the runs of n bytes, 0 for runs with a space between other bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    if len(a) < n:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(a) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = (h ^ a[i : len(a) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    spaces = np.concatenate([[0], np.cumsum(a == SPACE)])
    inside = spaces[n - 1 :][: len(h)] - spaces[1:][: len(h)]
    return np.where(inside > 0, np.uint64(0), h)


def contrasts(own: list[bytes], other: list[bytes]) -> dict[int, np.ndarray]:
    """By length, the runs of bytes that LEAST of the own texts have and that are RATIO times as frequent there as in the others."""
    out = {}
    for n in GRAMS:
        grams = lambda text: np.unique(gram_hashes(text, n))  # noqa: E731, B023
        held, c = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *map(grams, own)]), return_counts=True)
        keep = (c >= LEAST) & (held != 0)
        held, c = held[keep], c[keep]
        # Of the other texts only what the own ones have is kept, text by text.
        found = np.zeros(len(held), dtype=np.int64)
        for text in other if len(held) else []:
            g = grams(text)
            at = np.minimum(np.searchsorted(g, held), max(0, len(g) - 1))
            found += g[at] == held if len(g) else 0
        out[n] = held[c / max(1, len(own)) >= RATIO * (found + 0.5) / max(1, len(other))]
    return out


def samples(texts: list[bytes], wanted: dict[int, np.ndarray]) -> list[bytes]:
    """Of each text the stretches that the wanted runs cover, each once."""
    out = []
    for data in texts:
        cover = np.zeros(len(data) + 1, dtype=np.int64)
        for n, values in wanted.items():
            hit = np.flatnonzero(np.isin(gram_hashes(data, n), values))
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + n, -1)
        inside = np.concatenate([[0], (np.cumsum(cover)[: len(data)] > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(inside))
        runs = dict.fromkeys(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
        if runs:
            out.append(b"\n".join(runs))
    return out


def trained(size: int, texts: list[bytes], **parameters: int) -> bytes:
    """A dictionary by zstandard's own trainer; what it can't be trained on (too few or too short samples) is used as it is."""
    usable = [t for t in texts if len(t) >= 8]
    try:
        return zstandard.train_dictionary(size, usable, **parameters).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(usable)[-size:]


@dataclass
class Model:
    """Contents of both dictionaries, the bytes that a window must save, and the score from which a document counts as toxic."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    margin: int

    def scorer(self) -> Callable[[str | None], float]:
        gains = self.gains()
        return lambda text: total(gains(text), self.margin)

    def gains(self) -> Callable[[str | None], np.ndarray]:
        """For each window of a text, the bytes by which the toxic dictionary compresses it better than the ordinary one."""
        a, b = compressor(self.ordinary), compressor(self.toxic)

        def each(text: str | None) -> np.ndarray:
            held = windows(text or "")
            if not held:
                return np.empty(0, dtype=np.int64)
            plain, close = a.multi_compress_to_buffer(held, threads=1), b.multi_compress_to_buffer(held, threads=1)
            return np.array([len(plain[i]) - len(close[i]) for i in range(len(held))])

        return each


def total(gains: np.ndarray, margin: int) -> float:
    """What the windows save beyond the margin, over the square root of their number."""
    return float(np.maximum(gains - margin, 0).sum() / math.sqrt(len(gains) + 8))


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Two in three texts of each class for the dictionaries, the third for margin and threshold."""
    part = lambda texts, last: [t for i, t in enumerate(texts) if (i % 3 == 2) == last]
    own, other = [prepared(t) for t in distinct(part(toxic, False))], [prepared(t) for t in part(ordinary, False)]
    held = samples(own, contrasts(own, other))
    if not held:
        return Model(ANCHOR + TAIL, ANCHOR + TAIL, math.inf, 0)
    pieces = [t[i : i + PIECE] for t in other for i in range(0, len(t), PIECE)]
    base = trained(ORDINARY_BYTES, pieces, k=64, d=6)
    extra = trained(TOXIC_BYTES, held, k=32, d=6)
    model = Model(ANCHOR + base + bytes(len(extra)) + TAIL, ANCHOR + base + extra + TAIL, math.inf, 0)
    gains = model.gains()
    hits, clear = ([gains(t) for t in part(texts, True)] for texts in (toxic, ordinary))
    best = math.inf
    for margin in MARGINS:
        a, b = np.sort([total(g, margin) for g in hits]), np.sort([total(g, margin) for g in clear])
        cuts = np.unique(np.concatenate([a, b, [0.0]]))
        cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1)
        cost = np.searchsorted(a, cuts) / max(1, len(a)) + FALSE_ALARM * (1 - np.searchsorted(b, cuts) / max(1, len(b)))
        if cost.min() < best:
            best, model.margin, model.threshold = float(cost.min()), margin, float(cuts[np.argmin(cost)])
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED, ident: str = "doc_id", text: str = "text") -> dict[int, list[str]]:
    """Texts by class of at most ``limit`` labelled documents of each class, chosen by a hash of the id."""
    named = labels.select(F.col(ident).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    picked = [named.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id")
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y"))
    found = rows.orderBy(F.xxhash64("_id"), "_id").collect()
    return {y: [r["_text"] for r in found if r["_y"] == y] for y in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """A model from the documents that ``labels`` (doc_id, toxic) names, at most ``limit`` of each class."""
    texts = labelled(docs, labels, "toxic", limit)
    return train(texts[1], texts[0])


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """Add a column with the score of the whole text; NULL and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list = []

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(shared.value.scorer())
        return pa.array([held[0](t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(name, scores(F.col(text)))


def reject_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the model doesn't hold toxic, with their columns as they are.

    Rows with NULL or empty text stay. Repeated rows are judged alike. Texts of
    any length are read whole. An empty table gives an empty one; a model that
    was trained without toxic examples rejects nothing.
    """
    (score,) = fresh(docs, "_score")
    return with_score(docs, model, score, text).where(F.col(score) < F.lit(model.threshold)).drop(score)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: (doc_id, score, toxic)."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model, "score").select("doc_id", "score", (F.col("score") >= F.lit(model.threshold)).alias("toxic"))
