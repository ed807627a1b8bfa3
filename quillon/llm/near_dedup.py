"""Near-duplicate groups by bottom-k sketches.

One hash function orders a document's word shingles; its k smallest are its
sketch. Inverted lists of sketch values give pairs that overlap, the sketch of
the pair's union estimates their Jaccard similarity and filters, and exact
shingle sets verify. Verified pairs link documents into groups.

A pair that passes the filter shares at least a known share of its sketches, so
it must meet within the rarest values of each: passages that many documents
share are no meeting place. The members of a list are first held against one
hub, after which only members of different groups are paired, so groups of
copies give no more pairs than members. Both are exact: no pair that the filter
would pass is left out of the grouping. What is still compared pair by pair are
documents of different groups that share one of their rarest values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh, join_checked, materialize, word_hashes

SHINGLE = 3
SKETCH = 64
#: Jaccard similarity of shingle sets from which documents are near duplicates.
THRESHOLD = 0.5
#: The estimate from which a pair is verified: three standard errors of a sketch below the threshold.
FILTER = THRESHOLD - 3 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the runs of SHINGLE words; a shorter text is one shingle."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    w = words.astype(np.uint64)
    n = min(SHINGLE, len(w))
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def _shingles(limit: int | None):
    """An Arrow UDF from word hashes to the ``limit`` smallest shingle hashes, and how many there are if limited."""

    @F.arrow_udf("struct<n: int, v: array<bigint>>")
    def hashed(rows: pa.Array) -> pa.Array:
        flat, offsets = np.asarray(rows.values), np.asarray(rows.offsets)
        sets = [shingle_hashes(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        counts = pa.array([len(s) for s in sets], pa.int32())
        cut = [s[:limit] for s in sets]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in cut])]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *cut])))
        return pa.StructArray.from_arrays([counts, values], names=["n", "v"])

    return hashed


def meeting_places(sketches: DataFrame) -> DataFrame:
    """(value, node): the inverted lists, cut to where a pair that passes the filter must meet.

    A pair with an estimate of FILTER or more shares c = ceil(FILTER * size)
    values of the smaller sketch. Order every sketch by how many documents hold
    a value: whoever shares c of its s values shares one of the rarest
    s - c + 1. Values that one document holds are in no pair and aren't kept.
    """
    rows = sketches.select("node", F.size("v").alias("s"), F.explode("v").alias("value"))
    # Counted and joined rather than by a window, so that no task holds all rows of a value.
    shared_values = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    held = rows.join(shared_values, "value")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("node"))
    need = F.ceil(F.col("s") * F.lit(FILTER) - F.lit(1e-9))
    return held.select("node", "value", "s", rank.alias("r"), shared.alias("m")).where(F.col("r") <= F.col("m") - need + 1).select("value", "node")


def verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the Jaccard similarity; (a, b, jaccard)."""
    side = lambda n: sketches.select(F.col("node").alias(n), F.col("v").alias(f"v{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("va", "vb")), 1, SKETCH)
    estimate = F.size(F.array_intersect(F.array_intersect("va", "vb"), union)) / F.size(union)
    likely = materialize(both.where(estimate >= F.lit(FILTER)).select("a", "b"), "likely")
    wanted = materialize(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct(), "wanted")
    sets = join_checked(texts, wanted, "node", "left_semi").select("node", _shingles(None)(word_hashes(F.col("text")))["v"].alias("v"))
    sets = materialize(sets, "sets")
    full = lambda n: sets.select(F.col("node").alias(n), F.col("v").alias(f"v{n}"))
    shared = F.size(F.array_intersect("va", "vb"))
    jaccard = shared / (F.size("va") + F.size("vb") - shared)
    tested = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", jaccard.alias("jaccard"))
    return materialize(tested.where(F.col("jaccard") >= F.lit(THRESHOLD)), "verified")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node linked to each node of the edges (a, b).

    Alternating large-star and small-star steps, which take a number of rounds
    in the logarithm of the longest chain and keep the edges linear in number.
    """
    star = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    star = materialize(star, "links")
    while True:
        around = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        following = materialize(small.where("u <> v").distinct(), "links")
        changed = following.join(star, ["u", "v"], "left_anti").limit(1).count() + star.join(following, ["u", "v"], "left_anti").limit(1).count()
        star = following
        if not changed:
            break
    linked = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())


def links(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified pairs (a, b, jaccard) that connect every group of near duplicates among the nodes."""
    lists = materialize(meeting_places(sketches), "lists")
    hubs = lists.groupBy("value").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "a")
    spokes = lists.join(hubs, "value").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = verify(spokes, sketches, texts)
    roots = components(first)
    # Second: members of a list that aren't in one group yet, in pairs that the hubs didn't cover.
    placed = materialize(lists.join(roots, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value")
    open_lists = placed.join(mixed, "value", "left_semi")
    side = lambda n: open_lists.select("value", F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    rest = side("a").join(side("b"), "value").where("a < b AND root_a <> root_b").select("a", "b").distinct()
    rest = rest.join(spokes, ["a", "b"], "left_anti")
    return first.unionByName(verify(rest, sketches, texts))


def groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(rows, members, key): the rows with a key column, and (key, root_key, group_id) of all rows in groups of two or more.

    See :func:`deduplicate` for what counts as a near duplicate.
    """
    (key,) = fresh(docs, "_node")
    kept = docs.columns if carry is None else carry
    held = materialize(docs.select(*kept, *{ident, text}.difference(kept), F.monotonically_increasing_id().alias(key)), "rows")
    base = held.where(F.col(text).isNotNull()).select(F.col(key).alias("node"), F.col(ident).alias("id"), F.col(text).alias("text"))
    # Identical texts are one node: the row that stays if all else is equal.
    order = F.struct(F.col("id").isNull(), "id", "node")
    sketch = _shingles(SKETCH)(word_hashes(F.col("text")))
    sketched = materialize(base.select("node", "id", F.md5(F.col("text").cast("binary")).alias("digest"), sketch.alias("k")), "sketches")
    same = materialize(
        sketched.groupBy("digest").agg(F.min(order).alias("o"), F.min_by("k", order).alias("k"), F.count(F.lit(1)).alias("copies")).select("digest", F.col("o.node").alias("node"), F.col("o.id").alias("id"), F.col("k.v").alias("v"), "copies"), "distinct"
    )
    found = links(same.where(F.size("v") > 0).select("node", "v"), base.select("node", "text"))
    roots = components(found.select("a", "b"))
    # Every row, with its text's node and that node's component; the row that stays is the first of all in the component.
    node_of = sketched.select("digest", F.col("node").alias("row"), F.col("id").alias("row_id")).join(same.where("copies > 1").select("digest", "node"), "digest", "left")
    named = node_of.select("row", "row_id", F.coalesce("node", "row").alias("node")).join(roots, "node", "left")
    copied = same.where("copies > 1").select("node", F.lit(True).alias("copied"))
    grouped = named.join(copied, "node", "left").where("root IS NOT NULL OR copied").select("row", "row_id", F.coalesce("root", "node").alias("root"))
    head = grouped.groupBy("root").agg(F.min(F.struct(F.col("row_id").isNull(), "row_id", "row")).alias("h"))
    members = grouped.join(head, "root").select(F.col("row").alias(key), F.col("row_id").alias("id"), F.col("h.row").alias("keep"), F.col("h.row_id").alias("keep_id"))
    return held, materialize(members, "members"), key


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without near duplicates: of each group the one with the smallest id stays.

    Two texts are near duplicates if the sets of their runs of SHINGLE words
    have a Jaccard similarity of THRESHOLD or more; groups are what such pairs
    connect. Texts shorter than a run are one run; texts without words, the
    empty one included, equal only themselves. Identical texts are always a
    group. Among equal ids, and of repeated rows, one stays; NULL ids come
    last. Rows with NULL text all stay. Texts are read whole. Other columns
    pass through. An empty table gives an empty one.
    """
    held, members, key = groups(docs, ident, text)
    drop = members.where(F.col(key) != F.col("keep")).select(key)
    return join_checked(held, drop, key, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of near duplicates among the documents: (doc_id, keep_id), the document that stays included."""
    _, members, _ = groups(documents(spark, sf_dir).select("doc_id", "text"))
    return members.select(F.col("id").alias("doc_id"), "keep_id")
