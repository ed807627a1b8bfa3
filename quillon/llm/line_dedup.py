"""Line deduplication with two Bloom filters.

A first pass hashes every line into a once-seen and a twice-seen filter. Only
lines that the twice-seen filter holds are suspected; they alone are shuffled,
by their text, to confirm the repeat exactly and to choose the first
occurrence. The filters have no false negatives, so nothing is missed; a false
positive costs one shuffled line and changes no result.

The filters grow with the corpus and are cut in segments by the hash's first
bits; all bits of a line are in one segment. As long as the twice-seen filter
has BROADCAST_BITS at most, it is broadcast; a larger one stays a table, and
the distinct hashes go to their segments instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh, join_checked, materialize

HASHES = 4
BITS_PER_LINE = 16
#: Bits of a filter up to which it is broadcast (32 MB).
BROADCAST_BITS = 1 << 28
SEGMENT_BITS = 1 << 20


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) positions, all of a hash in one segment; ``bits`` is a power of two, SEGMENT_BITS at least."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) & np.uint64(0xFFFFFFFF) | np.uint64(1)
    base = segment_of(hashes, bits) * np.int64(SEGMENT_BITS)
    return np.stack([base + ((low + np.uint64(i) * high) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for i in range(HASHES)])


def segment_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The segment that the first bits of a hash name."""
    depth = (bits // SEGMENT_BITS).bit_length() - 1
    return (hashes.astype(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(hashes), dtype=np.int64)


def filter_bits(lines: int) -> int:
    """The power of two at or above BITS_PER_LINE bits a line."""
    return max(SEGMENT_BITS, 1 << max(0, lines * BITS_PER_LINE - 1).bit_length())


def _packed(positions: np.ndarray) -> bytes:
    bits = np.zeros(SEGMENT_BITS, dtype=np.uint8)
    bits[positions] = 1
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)


def twice_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(segment, twice): the twice-seen filter over a table with one ARRAY<BIGINT> column of line hashes.

    Every task makes both filters of its own rows; a merge by segment follows.
    A bit that two tasks have in their once-seen filters is a twice-seen bit.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.asarray(b.column(0).flatten()) for b in batches]
        own, counts = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *held]), return_counts=True)
        once = np.unique(bit_positions(own, bits))
        twice = np.unique(bit_positions(own[counts > 1], bits))
        held = np.unique(once // SEGMENT_BITS)
        edges = np.stack([held, held + 1]) * SEGMENT_BITS
        a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        for k, s in enumerate(held):
            row = [_packed(once[a[0, k] : a[1, k]] - edges[0, k]), _packed(twice[b[0, k] : b[1, k]] - edges[0, k])]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array(row[:1]), pa.array(row[1:])], names=["segment", "once", "twice"])

    def merge(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, again = np.zeros(SEGMENT_BITS // 8, dtype=np.uint8), np.zeros(SEGMENT_BITS // 8, dtype=np.uint8)
        for frame in frames:
            for once, twice in zip(frame["once"], frame["twice"]):
                bits_of = _unpacked(once)
                again |= (seen & bits_of) | _unpacked(twice)
                seen |= bits_of
        yield pd.DataFrame({"segment": [key[0]], "twice": [again.tobytes()]})

    return hashes.mapInArrow(local, "segment long, once binary, twice binary").groupBy("segment").applyInPandas(merge, "segment long, twice binary")


def _holds(filter_bytes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    hit = np.ones(positions.shape[1], dtype=bool)
    for at in positions:
        hit &= (filter_bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def suspects(parts: DataFrame, bits: int) -> Callable[..., Column]:
    """An Arrow UDF: for each of the hashes, whether the filter holds it. The filter is broadcast."""
    filter_bytes = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        at = row.segment * (SEGMENT_BITS // 8)
        filter_bytes[at : at + SEGMENT_BITS // 8] = np.frombuffer(row.twice, dtype=np.uint8)
    shared = parts.sparkSession.sparkContext.broadcast(filter_bytes)

    @F.arrow_udf("array<boolean>")
    def held(rows: pa.Array) -> pa.Array:
        hit = _holds(shared.value, bit_positions(np.asarray(rows.flatten()), bits))
        ends = np.concatenate([[0], np.cumsum(np.asarray(rows.value_lengths().fill_null(0)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(hit))

    return held


def suspect_hashes(hashes: DataFrame, parts: DataFrame, bits: int) -> DataFrame:
    """(h): the distinct hashes of a table (h) that the filter holds, each looked up in its segment; nothing is broadcast."""
    depth = (bits // SEGMENT_BITS).bit_length() - 1
    segment = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")

    def probe(key: tuple, frame: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(frame):
            return frame[["h"]].head(0)
        own = np.frombuffer(filters["twice"].iloc[0], dtype=np.uint8)
        h = frame["h"].to_numpy()
        return frame.loc[_holds(own, bit_positions(h, bits) - int(key[0]) * SEGMENT_BITS), ["h"]]

    probes = hashes.select("h").distinct().withColumn("segment", segment)
    return probes.groupBy("segment").cogroup(parts.groupBy("segment")).applyInPandas(probe, "h long")


def without_lines(text: Column, drop: Column) -> Column:
    """A text without the lines of the given numbers; NULL without such numbers."""

    def clean(text: str | None, drop: list[int] | None) -> str | None:
        if text is None or drop is None:
            return None
        gone = set(drop)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, drops: pa.Array) -> pa.Array:
        return pa.array(map(clean, texts.to_pylist(), drops.to_pylist()), pa.string())

    return cleaned(F.when(drop.isNotNull(), text), drop)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def deduplicate_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", bits: int | None = None, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """The documents without any line that occurs earlier in the corpus.

    Lines end at newlines and are compared byte for byte. Earlier means in a
    row of smaller id (NULL ids last; rows of equal id in some fixed order), or
    above in the same text. Blank lines (nothing or spaces; a tab is not blank)
    are never dropped, so an empty text stays empty, and a NULL text NULL. A
    document all of whose lines are repeats stays with an empty text. Whole
    texts of any length are compared, in time linear in their lines. Repeated
    rows count as repeats of the first. Other columns pass through; an empty
    table gives an empty one.
    """
    row, count, drop = fresh(docs, "_row", "_count", "_drop")
    lines = lines_of(F.col(text))
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(count, F.size(lines)), "lines")
    bits = bits or filter_bits(int(held.agg(F.sum(count)).first()[0] or 0))
    # A blank line's hash is NULL and left out of the filters; for suspicion it stands as -1 and may be a false positive.
    blank = lambda x: F.trim(x) == ""
    hashed = F.transform(F.filter(lines, lambda x: ~blank(x)), lambda x: F.xxhash64(x))
    twice = materialize(twice_filter(held.select(hashed.alias("h")), bits), "filter")
    if bits <= broadcast_bits:
        every = F.transform(lines, lambda x: F.when(blank(x), F.lit(-1).cast("long")).otherwise(F.xxhash64(x)))
        found = held.select(row, F.col(ident).alias("_id"), F.col(text).alias("_text"), suspects(twice, bits)(every).alias("_hit"))
        marked = F.transform(lines_of(F.col("_text")), lambda x, i: F.struct(i.alias("n"), x.alias("line"), F.get("_hit", i).alias("hit")))
        exploded = found.select(F.col(row).alias("_row"), "_id", F.explode(F.filter(marked, lambda s: s["hit"] & ~blank(s["line"]))).alias("_s"))
        picked = exploded.select("_row", "_id", F.col("_s.n").alias("_n"), F.col("_s.line").alias("_line"))
    else:
        each = held.select(F.col(row).alias("_row"), F.col(ident).alias("_id"), F.posexplode(lines).alias("_n", "_line")).where(~blank(F.col("_line")))
        hot = suspect_hashes(each.select(F.xxhash64("_line").alias("h")), twice, bits)
        picked = each.withColumn("h", F.xxhash64("_line")).join(hot.hint("merge"), "h", "left_semi").drop("h")
    picked = materialize(picked, "suspects")
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"), F.col("_n"))
    first = picked.groupBy("_line").agg(F.min(order).alias("_first")).select("_first._row", "_first._n")
    repeats = picked.select("_row", "_n").join(first, ["_row", "_n"], "left_anti")
    by_row = materialize(repeats.groupBy(F.col("_row").alias(row)).agg(F.collect_set("_n").alias(drop)), "repeats")
    joined = join_checked(held, by_row, row, "left")
    clean = F.when(F.col(drop).isNull(), F.col(text)).otherwise(without_lines(F.col(text), F.col(drop)))
    return joined.withColumn(text, clean).select(*docs.columns)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines: (doc_id, text)."""
    return deduplicate_lines(documents(spark, sf_dir).select("doc_id", "text"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS k FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM r WHERE k = 1 OR trim(line) = '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN k USING (doc_id)
"""
