"""Language-model scores by stupid backoff, every document against the rest of the corpus.

Count tables of n-grams are partitioned by hash and joined to the n-grams of
the documents, whose scores are then summed per document. One row for each
n-gram occurrence would shuffle several times the size of the corpus, so rows
are packed: a block of documents sends each distinct n-gram that it has once,
with a one-byte count, to the partition of its hash; there the counts are
added up and the totals joined back to the blocks that sent the n-gram, a byte
each, mostly 0, as most n-grams occur in one block only. Counts are of the
whole corpus, less the document's own occurrences, so that no text vouches for
itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh, row_key

ORDER = 3
ALPHA = 0.4
#: The count of a word that no other document has.
UNSEEN = 0.5
#: Characters in a block and distinct n-grams in a partition, about: what one task holds in memory.
BLOCK_CHARS = 12_000_000
PARTITION_NGRAMS = 4_000_000
#: Hashes have this many bits; an n-gram of a corpus of 10 ** 9 distinct ones collides with a chance of 10 ** -8.
BITS = 56
MASK = np.uint64((1 << BITS) - 1)


def split_words(texts: list[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, how many each text has): what is between white space, as Python splits it; NULL has none."""
    split = pc.utf8_split_whitespace((texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).fill_null(""))
    sizes = np.asarray(split.value_lengths()).astype(np.int64)
    flat = split.flatten()
    there = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool) if len(flat) else np.empty(0, dtype=bool)
    if there.all():
        return flat, sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return flat.filter(pa.array(there)), np.bincount(doc[there], minlength=len(sizes))


def ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(document of each word, [hashes of the n-grams that end at it], [whether there is one]), by order from 1."""
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    own = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    flat = np.array(own, dtype=np.uint64)[np.asarray(coded.indices)] if own else np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, there, grams = [flat & MASK], [np.ones(len(flat), dtype=bool)], flat
    for n in range(1, order):
        before = np.concatenate([np.zeros(min(1, len(flat)), dtype=np.uint64), grams[:-1]])
        grams = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + flat * np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
        hashes.append(grams & MASK)
        there.append(at >= n)
    return doc, hashes, there


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct hashes as gaps in 5 bytes, or 8 where one is larger; the first byte says which."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = 5 if int(gaps.max(initial=0)) < 1 << 40 else 8
    columns = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(columns.T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    full = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    full[:, :width] = raw.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; 255 stands for a larger one, which follows in 8 bytes behind them all."""
    large = counts >= 255
    head = np.where(large, 255, counts).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(counts)).tobytes() + head.tobytes() + counts[large].astype("<i8").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    out = np.frombuffer(raw, dtype=np.uint8, offset=8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[8 + n :], dtype="<i8")
    return out


def own_counts(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each occurrence, how often its document has the same n-gram."""
    order = np.lexsort((ids, doc))
    d, i = doc[order], ids[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])[: len(d)]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(d)))
    out = np.empty(len(d), dtype=np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def block_scores(texts: list[str | None], others: list[np.ndarray], corpus_words: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean log10 score, words) of each text; others[n]: counts in the other blocks of this block's sorted distinct n-grams."""
    doc, hashes, there = ngrams(texts, order)
    sizes = np.bincount(doc, minlength=len(texts))
    counts = []
    for n in range(order):
        held = np.zeros(len(doc), dtype=np.int64)
        _, ids, here = np.unique(hashes[n][there[n]], return_inverse=True, return_counts=True)
        held[there[n]] = (others[n] + here)[ids] - own_counts(doc[there[n]], ids)
        counts.append(held)
    rest = np.maximum(corpus_words - sizes[doc], 1)
    score = np.log10(np.maximum(counts[0], UNSEEN) / rest)
    for n in range(1, order):
        context = np.concatenate([np.zeros(min(1, len(doc)), dtype=np.int64), counts[n - 1][:-1]])
        hit = there[n] & (counts[n] > 0)
        longer = np.log10(np.maximum(counts[n], 1) / np.maximum(context, 1))
        score = np.where(hit, longer, np.where(there[n], score + np.log10(ALPHA), score))
    return np.bincount(doc, weights=score, minlength=len(texts)) / np.maximum(sizes, 1), sizes


def score_documents(docs: DataFrame, order: int = ORDER, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, score): the mean log10 stupid-backoff score of a document's words.

    A word scores c(n-gram) / c(context) of the longest n-gram, up to ``order``
    and within its document, that the other rows of the corpus have, times
    ALPHA for each order given up; a single word c(word) / words of the rest,
    with UNSEEN for words that only this document has. Words are what white
    space separates, case and punctuation kept. Copies of a document are other
    documents: they count. A text without words (NULL or empty) has n_words 0
    and a NULL score. Texts are read whole; extra columns don't matter; NULL
    and repeated ids are carried along; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length(text)), F.sum(F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")))).first()
    chars = int(size[0] or 0)
    blocks = max(1, -(-chars // BLOCK_CHARS))
    parts = max(1, -(-int(size[1] or 0) * order // (2 * PARTITION_NGRAMS)))
    (block,) = fresh(docs, "block")
    keyed = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(row_key(docs, ident, text)), F.lit(blocks)).cast("int").alias("block"))
    edges = np.array([(i << BITS) // parts for i in range(parts + 1)], dtype=np.uint64)

    def request(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        doc, hashes, there = ngrams(frame["text"].tolist(), order)
        rows = []
        for n in range(order):
            values, counts = np.unique(hashes[n][there[n]], return_counts=True)
            # A row for each partition that the block has n-grams of: no more rows than n-grams, however many partitions.
            part = np.searchsorted(edges[1:-1], values, side="right")
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(values))):
                rows.append((n * parts + int(part[a]), key[0], packed(values[a:b]), pack_counts(counts[a:b])))
        return pd.DataFrame(rows, columns=["part", "block", "grams", "counts"])

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        grams = [unpacked(g) for g in frame["grams"]]
        own = np.concatenate([unpack_counts(c) for c in frame["counts"]])
        values, at = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.zeros(len(values), dtype=np.int64)
        np.add.at(sums, at, own)
        back = np.split(sums[at] - own, np.cumsum([len(g) for g in grams])[:-1])
        return pd.DataFrame({"block": frame["block"], "part": key[0], "others": [pack_counts(b) for b in back]})

    def finish(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("part")
        others = []
        for n in range(order):
            mine = answers[answers["part"] // parts == n]
            others.append(np.concatenate([np.empty(0, dtype=np.int64), *map(unpack_counts, mine["others"])]))
        score, words = block_scores(frame["text"].tolist(), others, int(corpus.value), order)
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_words": words, "score": np.where(words > 0, score, None)})

    sent = keyed.groupBy("block").applyInPandas(request, "part int, block int, grams binary, counts binary")
    answered = sent.groupBy("part").applyInPandas(total, "block int, part int, others binary")
    corpus = spark.sparkContext.broadcast(count_words(keyed))
    kind = dict(keyed.dtypes)["doc_id"]
    return keyed.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(finish, f"doc_id {kind}, n_words long, score double")


def count_words(docs: DataFrame) -> int:
    """Words of the whole corpus, counted as Python splits them."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(split_words(b.column(0))[1].sum())], pa.int64())], names=["n"])

    return int(docs.select("text").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0)


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored against the counts of all others: (doc_id, n_words, score)."""
    return score_documents(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


SQL = f"""
WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM s),
g AS (SELECT doc_id, pos, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS own,
  count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, doc_id) AS c1,
  count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY v, w, doc_id) AS c2,
  count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY u, v, w, doc_id) AS c3, count(*) OVER () AS total FROM g),
c AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
one AS (SELECT *, log10(greatest(c1, {UNSEEN}) / (total - own)) AS s1 FROM c),
two AS (SELECT *, CASE WHEN v IS NULL THEN s1 WHEN c2 > 0 THEN log10(c2 / b1) ELSE s1 + log10({ALPHA}) END AS s2 FROM one),
three AS (SELECT doc_id, CASE WHEN u IS NULL THEN s2 WHEN c3 > 0 THEN log10(c3 / b2) ELSE s2 + log10({ALPHA}) END AS s3 FROM two),
f AS (SELECT doc_id, count(*) AS n_words, round(avg(s3), 6) AS score FROM three GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, score FROM documents d LEFT JOIN f USING (doc_id)
"""
