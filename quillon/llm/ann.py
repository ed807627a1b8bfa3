"""Nearest neighbours of every vector by a navigable small-world graph per shard.

Vectors are spread over shards by hash. Each shard builds a hierarchical
navigable small-world graph, kept as flat arrays: vectors, levels, and the
neighbours of each node at each level. Every block of queries searches every
shard, streaming past a graph that is loaded once, and the shards' results are
merged. Graphs are built and searched for
many vectors in step, so that numpy does the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import fresh, materialize

NEIGHBOURS = 10
M = 16
EF_BUILD = 80
EF_SEARCH = 64
#: Vectors in a shard, at most and at least: a shard's graph is held by one task, and every query visits every shard.
SHARD_MAX, SHARD_MIN = 262_144, 512
#: Shards are made smaller than SHARD_MAX while there are fewer than this many.
SHARDS = 8
QUERY_BLOCK = 2_048
#: Query blocks that one task searches a shard for: a graph is sent once for so many.
CHUNK = 64
STEP = 384
#: Similarities between candidates for back links that are held at a time, about; it sets how many nodes are done together.
BACK_PAIRS = 10_000_000


@dataclass
class Graph:
    """levels[l]: (nodes at level l, their neighbours as positions in the shard, -1 where there is none)."""

    vectors: np.ndarray
    ids: np.ndarray
    nodes: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    entry: int = -1

    @cached_property
    def tables(self) -> list[np.ndarray]:
        """The neighbours by level with a row for every node of the shard."""
        out = []
        for nodes, links in zip(self.nodes, self.links):
            table = np.full((len(self.vectors), links.shape[1]), -1, dtype=np.int64)
            table[nodes] = links
            out.append(table)
        return out


def _closest(ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if near.shape[1] > k:
        part = np.argpartition(-near, k - 1, axis=1)[:, :k]
        ids, near = np.take_along_axis(ids, part, 1), np.take_along_axis(near, part, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _first_of_each(ids: np.ndarray) -> np.ndarray:
    """In each row, True for the first of equal values."""
    order = np.argsort(ids, axis=1, kind="stable")
    held = np.take_along_axis(ids, order, 1)
    new = np.concatenate([np.ones((len(ids), 1), dtype=bool), held[:, 1:] != held[:, :-1]], axis=1)
    out = np.empty_like(new)
    np.put_along_axis(out, order, new, 1)
    return out


def search_level(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step over one level; table[node] lists neighbours. (nodes, similarities), best first, -1 and -inf where short."""
    n = len(queries)
    ids = np.full((n, ef), -1, dtype=np.int64)
    near = np.full((n, ef), -np.inf, dtype=np.float32)
    width = min(ef, start.shape[1])
    ids[:, :width] = start[:, :width]
    there = ids >= 0
    near[there] = np.einsum("ij,ij->i", queries[np.nonzero(there)[0]], vectors[ids[there]])
    done = ~there
    seen = np.zeros((n, len(vectors)), dtype=bool)
    seen[np.nonzero(there)[0], ids[there]] = True
    live = np.arange(n)
    while len(live):
        open_near = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-open_near, expand - 1, axis=1)[:, :expand] if ef > expand else np.tile(np.arange(ef), (len(live), 1))
        good = np.take_along_axis(open_near, pick, 1) > -np.inf
        more = good.any(axis=1)
        live, pick, good = live[more], pick[more], good[more]
        if not len(live):
            break
        nodes = np.where(good, ids[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        found = np.where(nodes[:, :, None] >= 0, table[nodes], -1).reshape(len(live), -1)
        fresh_ones = (found >= 0) & ~seen[live[:, None], found]
        fresh_ones &= _first_of_each(np.where(fresh_ones, found, -1 - np.arange(found.shape[1])))
        r, c = np.nonzero(fresh_ones)
        got = found[r, c]
        seen[live[r], got] = True
        value = np.full(found.shape, -np.inf, dtype=np.float32)
        value[r, c] = np.einsum("ij,ij->i", queries[live[r]], vectors[got])
        all_ids = np.concatenate([ids[live], np.where(fresh_ones, found, -1)], axis=1)
        all_near = np.concatenate([near[live], value], axis=1)
        all_done = np.concatenate([done[live], ~fresh_ones], axis=1)
        top = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
        ids[live], near[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_done))
    return _closest(ids, near, ef)


def diverse(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each row from candidates, best first: one that is nearer to a chosen one than to the row waits, and fills up what room is left."""
    n, c = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = own @ own.transpose(0, 2, 1)
    chosen = np.zeros((n, c), dtype=bool)
    blocked = ids < 0
    for j in range(c):
        take = ~blocked[:, j] & (chosen.sum(axis=1) < m)
        take &= ~(chosen & (between[:, j, :] > near[:, j : j + 1])).any(axis=1)
        chosen[:, j] = take
    rank = np.where(chosen, 0, 1) * c + np.arange(c) + np.where(ids < 0, 2 * c, 0)
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, m - out.shape[1]))), constant_values=-1)


def _add_back(vectors: np.ndarray, table: np.ndarray, new: np.ndarray, room: int) -> None:
    """Make the links of the new nodes mutual; a node with too many keeps diverse ones, of all its candidates."""
    source = np.repeat(new, table.shape[1])
    to = table[new].ravel()
    keep = to >= 0
    source, to = source[keep], to[keep]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
    most = np.argsort(-counts, kind="stable")  # nodes with like numbers of candidates together
    nodes, starts, counts = nodes[most], starts[most], counts[most]
    a = 0
    while a < len(nodes):
        end = a + max(1, min(STEP, BACK_PAIRS // (room + int(counts[a])) ** 2))
        own, at, size = nodes[a:end], starts[a:end], counts[a:end]
        a = end
        extra = np.full((len(own), int(size.max())), -1, dtype=np.int64)
        column = np.arange(extra.shape[1])
        held = column < size[:, None]
        extra[held] = source[(at[:, None] + np.minimum(column, size[:, None] - 1))[held]]
        ids = np.concatenate([table[own], extra], axis=1)
        ids = np.where(_first_of_each(ids), ids, -1)
        near = np.einsum("ij,ikj->ik", vectors[own], vectors[np.maximum(ids, 0)])
        near = np.where(ids >= 0, near, -np.inf).astype(np.float32)
        sort = np.argsort(-near, axis=1, kind="stable")
        table[own] = diverse(vectors, np.take_along_axis(ids, sort, 1), np.take_along_axis(near, sort, 1), room)


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 11) -> Graph:
    """Insert in batches no larger than the graph: each searches the graph so far, and the rest of its batch by brute force."""
    n = len(vectors)
    graph = Graph(vectors, ids)
    if not n:
        return graph
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(M)).astype(np.int64), 6)
    order = np.argsort(-level, kind="stable")  # high levels first: the upper graphs are whole before they're needed
    top = int(level.max())
    tables = [np.full((n, 2 * M if lv == 0 else M), -1, dtype=np.int64) for lv in range(top + 1)]
    entry, at = int(order[0]), 1
    while at < n:
        batch = order[at : at + min(STEP, at)]
        queries = vectors[batch]
        start = np.full((len(batch), 1), entry, dtype=np.int64)
        for lv in range(top, -1, -1):
            here = level[batch] >= lv
            ef = EF_BUILD if here.any() else 1
            found, near = search_level(vectors, tables[lv], queries, start, ef)
            start = found[:, : max(1, min(8, found.shape[1]))]
            if not here.any():
                continue
            new = batch[here]
            mates = vectors[new] @ vectors[new].T
            np.fill_diagonal(mates, -np.inf)
            k = min(M, len(new))
            mate_ids, mate_near = _closest(np.tile(new, (len(new), 1)), mates, k)
            mate_ids = np.where(mate_near > -np.inf, mate_ids, -1)
            all_ids, all_near = _closest(np.concatenate([found[here], mate_ids], axis=1), np.concatenate([near[here], mate_near], axis=1), EF_BUILD)
            all_ids = np.where(all_near > -np.inf, all_ids, -1)
            tables[lv][new, :M] = diverse(vectors, all_ids, all_near, M)
            _add_back(vectors, tables[lv], new, tables[lv].shape[1])
        at += len(batch)
    graph.entry = entry
    graph.nodes = [np.flatnonzero(level >= lv) for lv in range(top + 1)]
    graph.links = [t[nodes] for t, nodes in zip(tables, graph.nodes)]
    return graph


def search(graph: Graph, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the shard, similarities) of the k nearest found, best first."""
    n = len(graph.vectors)
    if not n:
        return np.empty((len(queries), 0), dtype=np.int64), np.empty((len(queries), 0), dtype=np.float32)
    start = np.full((len(queries), 1), graph.entry, dtype=np.int64)
    near = np.zeros((len(queries), 1), dtype=np.float32)
    for lv in range(len(graph.nodes) - 1, -1, -1):
        start, near = search_level(graph.vectors, graph.tables[lv], queries, start, max(k, ef) if lv == 0 else 8)
    return start[:, :k], near[:, :k]


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, dtype=np.float32) for v in vectors]).reshape(-1, size) if len(vectors) else np.empty((0, size), dtype=np.float32)


def shard_graphs(held: DataFrame, size: int) -> DataFrame:
    """One row a shard from (shard, _row, _v): the graph as flat binary arrays."""

    def make(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row")
        g = build(frame["_row"].to_numpy(), _matrix(frame["_v"], size))
        return pd.DataFrame({
            "shard": [key[0]], "ids": [g.ids.astype("<i8").tobytes()], "vectors": [g.vectors.astype("<f4").tobytes()], "entry": [g.entry],
            "nodes": [[x.astype("<i4").tobytes() for x in g.nodes]], "links": [[x.astype("<i4").tobytes() for x in g.links]],
        })

    return held.groupBy("shard").applyInPandas(make, "shard int, ids binary, vectors binary, entry int, nodes array<binary>, links array<binary>")


def load(ids: bytes, vectors: bytes, entry: int, nodes: list[bytes], links: list[bytes], size: int) -> Graph:
    at = [np.frombuffer(x, dtype="<i4").astype(np.int64) for x in nodes]
    to = [np.frombuffer(x, dtype="<i4").astype(np.int64).reshape(len(a), -1) for x, a in zip(links, at)]
    return Graph(np.frombuffer(vectors, dtype="<f4").reshape(-1, size), np.frombuffer(ids, dtype="<i8"), at, to, entry)


def nearest(rows: DataFrame, k: int = NEIGHBOURS, ident: str = "vec_id", vector: str = "embedding", shards: int | None = None, ask: Column | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): the k rows nearest to each query row by cosine, itself left out.

    Approximate: recall against brute force is 0.9 or more on the test data.
    Every row is in the index; those that the condition ``ask`` holds for are
    queries, by default all. Rows with the same id or vector are rows of their
    own, and neighbours of one another. A zero vector has similarity 0 to all.
    A row whose vector is NULL, empty, or has a NULL, NaN or infinite element
    or another length than the first in the order of length is neither query
    nor neighbour. Fewer than k others give fewer neighbours; ties go to the
    smaller row. NULL ids are carried along; extra columns don't matter; an
    empty table gives an empty one.
    """
    (row,) = fresh(rows, "_row")
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))
    held = materialize(usable.select(F.col(ident).alias("_id"), unit.alias("_v"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.lit(True) if ask is None else ask, F.lit(False)).alias("_ask")), "vectors")
    kind = dict(held.dtypes)["_id"]
    common = held.groupBy(F.size("_v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    empty = rows.sparkSession.createDataFrame([], f"vec_id {kind}, neighbour_id {kind}, rank int, similarity double")
    if common is None:
        return empty
    size, total = common["n"], common["c"]
    shards = shards or max(-(-total // SHARD_MAX), min(SHARDS, -(-total // SHARD_MIN)))
    held = held.where(F.size("_v") == size)
    sharded = held.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))
    graphs = materialize(shard_graphs(sharded, size), "graphs")
    asked = held.where("_ask")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list("_row").alias("rows"), F.collect_list("_v").alias("vs"))
    queries = materialize(queries, "queries")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for frame in frames:
            for r in frame.itertuples():
                if r.block < 0:
                    graph = load(r.ids, r.vectors, r.entry, r.nodes, r.links, size)
                    continue
                own_rows, vs = np.asarray(r.rows, dtype=np.int64), _matrix(r.vs, size)
                for a in range(0, len(own_rows), STEP):
                    own = own_rows[a : a + STEP]
                    found, near = search(graph, vs[a : a + STEP], k + 1)
                    names = graph.ids[np.maximum(found, 0)]
                    ok = (near > -np.inf) & (names != own[:, None])
                    at, _ = np.nonzero(ok)
                    yield pd.DataFrame({"q": own[at], "r": names[ok], "s": near[ok].astype(np.float64)})

    # To each pair of a shard and a chunk of blocks goes the graph, once, and the blocks stream past it.
    none = lambda names: [F.lit(None).cast(t).alias(n) for n, t in names]
    chunks = -(-blocks // CHUNK)
    first = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("shard", "chunk", F.lit(-1).alias("block"), "ids", "vectors", "entry", "nodes", "links", *none([("rows", "array<bigint>"), ("vs", "array<array<float>>")]))
    then = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("chunk", (F.col("block") / CHUNK).cast("int"))
    then = then.select("shard", "chunk", "block", *none([("ids", "binary"), ("vectors", "binary"), ("entry", "int"), ("nodes", "array<binary>"), ("links", "array<binary>")]), "rows", "vs")
    # Shards that hold no vector have no graph.
    then = then.join(F.broadcast(graphs.select("shard")), "shard", "left_semi")
    tasks = first.unionByName(then).repartition(min(shards * chunks, 100_000), "shard", "chunk").sortWithinPartitions("shard", "chunk", "block")
    best = tasks.mapInPandas(run, "q long, r long, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "r"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    name = lambda c, to: held.select(F.col("_row").alias(c), F.col("_id").alias(to))
    return ranked.join(name("q", "vec_id"), "q").join(name("r", "neighbour_id"), "r").select("vec_id", "neighbour_id", F.col("rank").cast("int").alias("rank"), F.col("s").alias("similarity"))


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The NEIGHBOURS nearest of all embeddings to every one whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ask=F.col("vec_id") % 20 == 0)
