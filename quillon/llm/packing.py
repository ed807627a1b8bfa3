"""Best-fit packing of documents into fixed-length sequences.

Lengths are counted in a histogram, whose size depends on the capacity and not
on the corpus. A configuration linear program over it (how often to use each
combination of lengths that fits a sequence) is solved by multiplicative
weights: prices on lengths, and a knapsack dynamic program that finds the
combination of most value at those prices. The solution is rounded down, and
what is left is placed by best fit; where best fit alone takes no more
sequences, its result is used. Pieces then look up their sequence by their rank
among pieces of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh, materialize, word_count

CAPACITY = 2048
#: Capacity up to which the program is solved, whose time grows with its square.
PROGRAM_ROOM = 4096
STEP = 0.05
ROUNDS = 400
#: Pieces of one length that one task ranks, about.
RANK_ROWS = 2_000_000


def best_combination(prices: np.ndarray, room: int) -> np.ndarray:
    """Counts by class of the combination of most value; class c takes c + 1 of the room. Unbounded knapsack."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        gain = prices[:r] + value[r - 1 :: -1][:r] if r <= len(prices) else prices + value[r - 1 : r - 1 - len(prices) : -1]
        k = int(np.argmax(gain))
        if gain[k] > value[r - 1]:
            value[r], choice[r] = gain[k], k
        else:
            value[r] = value[r - 1]
    out, r = np.zeros(len(prices), dtype=np.int64), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            out[choice[r]] += 1
            r -= choice[r] + 1
    return out


def fractional(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Combinations, how often to use each without exceeding any count, and a lower bound on the sequences needed."""
    live = counts > 0
    covered, combos, amounts, bound = np.zeros(len(counts)), [], [], 0.0
    for _ in range(ROUNDS):
        prices = np.zeros(len(counts))
        prices[live] = np.exp(-(covered[live] - covered[live].min()) / STEP) / counts[live]
        combo = best_combination(prices, room)
        worth = prices @ combo
        bound = max(bound, prices @ counts / worth)
        used = combo > 0
        amount = STEP * (counts[used] / combo[used]).min()
        covered[used] += amount * combo[used] / counts[used]
        combos.append(combo)
        amounts.append(amount)
        if covered[live].min() >= 1 and covered[live].max() <= 1 + 2 * STEP:
            break
    return np.array(combos), np.array(amounts) / max(covered.max(), 1e-300), bound


def best_fit(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations by best-fit decreasing. Sequences filled alike are handled as one, so that the work doesn't depend on the counts."""
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(room + 1)]
    open_rooms = np.zeros(room + 1, dtype=bool)

    def put(held: tuple[int, ...], many: int, left: int) -> None:
        if many:
            by_room[left].append((held, many))
            open_rooms[left] = True

    for c in range(len(counts) - 1, -1, -1):
        size, n = c + 1, int(counts[c])
        while n:
            left = size + int(np.argmax(open_rooms[size:]))
            if open_rooms[left]:
                held, many = by_room[left].pop()
                open_rooms[left] = bool(by_room[left])
            else:
                left, held, many = room, (), n
            # The tightest sequence stays the tightest until no more pieces of this size fit.
            each = left // size
            full = min(many, n // each)
            put(held + (c,) * each, full, left - each * size)
            n, many = n - full * each, many - full
            if many and n:
                put(held + (c,) * n, 1, left - n * size)
                n, many = 0, many - 1
            if held:
                put(held, many, left)
    return [g for groups in by_room for g in groups]


def combinations(counts: np.ndarray, room: int) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """[(lengths less 1 in a sequence, how many such sequences)] that hold exactly the counts, and a lower bound on the sequences needed.

    The program rounded down with best fit for the rest, or best fit for all
    where that takes no more sequences, none can take fewer, or the capacity is
    beyond PROGRAM_ROOM.
    """
    alone = best_fit(counts, room)
    bound = float(counts @ np.arange(1, len(counts) + 1)) / room
    used = lambda found: sum(n for _, n in found)
    if room > PROGRAM_ROOM or used(alone) <= math.ceil(bound):
        return alone, bound
    combos, amounts, low = fractional(counts, room)
    whole = np.floor(amounts).astype(np.int64)
    out = [(tuple(np.repeat(np.arange(len(combo)), combo)[::-1].tolist()), int(n)) for combo, n in zip(combos[whole > 0], whole[whole > 0])]
    out += best_fit(counts - whole @ combos, room)
    return min(alone, out, key=used), max(bound, low)


@dataclass
class Plan:
    """Runs of ranks by class (length less 1): pieces first[i] and on of a class go to sequences bin[i] and on, at offset[i]."""

    first: list[np.ndarray]
    bin: list[np.ndarray]
    offset: list[np.ndarray]
    bins: int
    bound: float

    def place(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
        for c in np.unique(cls):
            at = cls == c
            run = np.searchsorted(self.first[c], rank[at], side="right") - 1
            bins[at] = self.bin[c][run] + rank[at] - self.first[c][run]
            offsets[at] = self.offset[c][run]
        return bins, offsets


def make_plan(counts: np.ndarray, room: int) -> Plan:
    """counts[c]: pieces of class c, which take c + 1 units."""
    found, bound = combinations(counts, room)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    rank, bins = np.zeros(len(counts), dtype=np.int64), 0
    for combo, n in found:
        offset = 0
        for c in combo:
            runs[c].append((int(rank[c]), bins, offset))
            rank[c] += n
            offset += c + 1
        bins += n
    split = [np.array(r, dtype=np.int64).reshape(-1, 3).T for r in runs]
    return Plan([s[0] for s in split], [s[1] for s in split], [s[2] for s in split], bins, bound)


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, sequence, position) for each piece of each document.

    ``length`` counts a document's units, by default its words between white
    space. A document longer than ``capacity`` is cut into pieces of just that
    length and a rest; ``start`` is where in the document a piece begins,
    ``position`` where in its sequence. Pieces in a sequence don't overlap and
    end within ``capacity``. A document without units (NULL or empty text) gives one row of
    length 0 with NULL sequence and position. Repeated rows are placed one by
    one. NULL ids are carried along. Other columns don't matter. An empty table
    gives an empty result.
    """
    row, units = fresh(docs, "_row", "_units")
    count = length if length is not None else word_count(F.col(text))
    held = materialize(docs.select(F.col(ident).alias("doc_id"), F.monotonically_increasing_id().alias(row), F.coalesce(count, F.lit(0)).cast("long").alias(units)), "lengths")
    pieces = held.where(F.col(units) > 0).select(
        "doc_id", F.col(row).alias("row"), F.col(units).alias("units"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(units) - 1, F.lit(capacity).cast("long"))).alias("start")
    )
    pieces = pieces.select("doc_id", "row", "start", F.least(F.col("units") - F.col("start"), F.lit(capacity)).alias("length"))
    pieces = pieces.withColumn("class", (F.col("length") - 1).cast("int"))
    counts = np.zeros(capacity, dtype=np.int64)
    for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["class"]] = r["n"]
    plan = make_plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    # Ranks within a class: within a salt by a window, and behind the smaller salts by their counts.
    salts = int(max(8, -(-counts.max(initial=0) // RANK_ROWS)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("class", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = materialize(before, "salts")
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy("class", "salt").orderBy("row", "start")))
    ranked = ranked.join(before, ["class", "salt"]).select("doc_id", "start", "length", "class", (F.col("before") + F.col("at") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, offsets = shared.value.place(b.column("class").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("length"), pa.array(bins), pa.array(offsets)], names=["doc_id", "start", "length", "sequence", "position"])

    kind = dict(docs.select(F.col(ident).alias("doc_id")).dtypes)["doc_id"]
    placed = ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, sequence long, position long")
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    blank = held.where(F.col(units) <= 0).select("doc_id", zero.alias("start"), zero.alias("length"), none.alias("sequence"), none.alias("position"))
    return placed.unionByName(blank)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of CAPACITY words."""
    return pack(documents(spark, sf_dir))
