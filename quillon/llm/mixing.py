"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the output over
its size. Each document's count is the inverse of the Poisson distribution of
that mean at a number hashed from its id and a seed: no state, no second pass,
and the same counts on any cluster. Copies are then spread over the whole
output by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import documents, fresh, materialize, row_key, unit_interval
from quillon.sources.scratch import input_bytes

SEED = 17
TEMPERATURE = 0.7
#: The distribution is tabulated up to where this much probability is left above.
TAIL = 1e-13
BROADCAST_SOURCES = 100_000
#: Bytes of input for each partition of the output; there are spark.sql.shuffle.partitions at least.
PARTITION_BYTES = 128 << 20


def poisson_cdf(mean: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... up to the tail, in log space so that large means don't underflow."""
    if mean <= 0:
        return [1.0]
    top = int(mean + 12 * math.sqrt(mean) + 40)
    k = np.arange(top + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    cdf = np.cumsum(np.exp(k * math.log(mean) - mean - log_factorial))
    keep = int(np.searchsorted(cdf, 1 - TAIL)) + 1
    return cdf[:keep].tolist()


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate, cdf): sizes over all documents, and the mean repetition rate.

    ``weights``: target shares by source, in any scale; sources that they don't
    name get none. Without it a source of n documents weighs n ** temperature.
    ``total`` is the size aimed at, by default that of the input. A negative
    or infinite weight or total raises ValueError. The source may be of any type that
    casts to a string; ``weights`` names it by that string.
    """
    if any(not 0 <= float(w) < math.inf for w in [*(weights or {}).values(), total or 0]):
        raise ValueError("weights and total must be finite and not negative")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(named, F.col("source").cast("string")), F.lit(0.0))
    # One row of totals, joined without a shuffle of the sizes.
    sized = sizes.withColumn("w", weight)
    totals = sized.agg(F.sum("w").alias("all_w"), F.sum("n").cast("double").alias("all_n"))
    aim = F.col("all_n") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * aim / F.col("n")).otherwise(0.0)
    rated = sized.crossJoin(totals).select("source", "n", rate.alias("rate"))

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = pa.array([poisson_cdf(x) for x in b.column("rate").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, held], names=[*b.schema.names, "cdf"])

    cdf = T.StructField("cdf", T.ArrayType(T.DoubleType()))
    return rated.mapInArrow(tabulate, T.StructType([*rated.schema.fields, cdf]))


def replicate(docs: DataFrame, rated: DataFrame, seed: int = SEED, ident: str = "doc_id", text: str = "text", source: str = "source", number: str | None = None) -> DataFrame:
    """Each document as often as its draw says, in an order that mixes all sources.

    Rows with the same id get the same count; a row with NULL id is drawn by
    its text. NULL is a source like any other. Empty and NULL texts are rows
    like others. ``number`` adds a column with the copy's number, from 1. The
    order is that of a hash: partitions by hash, sorted within. An empty table
    gives an empty one. Other columns pass through.
    """
    key, u, src, cdf, copy, place = fresh(docs, "_key", "_u", "_source", "_cdf", "_copy", "_place")
    small = rated.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = rated.select(F.col("source").alias(src), F.col("cdf").alias(cdf))
    keyed = docs.withColumn(key, row_key(docs, ident, text)).withColumn(u, unit_interval(F.col(key), seed))
    drawn = keyed.join(F.broadcast(side) if small else side, F.col(source).eqNullSafe(F.col(src)))
    count = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    copies = drawn.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(1), count)))).drop(cdf, src, u)
    placed = copies.withColumn(place, F.xxhash64(F.lit(seed), F.col(key), F.col(copy))).drop(key)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // PARTITION_BYTES))
    mixed = placed.repartition(parts, place).sortWithinPartitions(place)
    return mixed.select(*docs.columns, *([F.col(copy).alias(number)] if number else []))


def mix(docs: DataFrame, number: str | None = None, **options) -> DataFrame:
    """:func:`rates` over all of ``docs``, then :func:`replicate`."""
    return replicate(docs, materialize(rates(docs, **options), "rates"), number=number)


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with sizes to the power TEMPERATURE as weights; ``copy`` numbers the copies of a document."""
    return mix(documents(spark, sf_dir), number="copy")


SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n, power(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
rated AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM sizes),
ks AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
       FROM rated, range(0, 2000) t(k) WHERE k <= rate + 12 * sqrt(rate) + 40),
drawn AS (SELECT d.*, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::BIGINT / {float(1 << 48)} AS u FROM documents d),
counted AS (SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars, count(*) AS copies
            FROM drawn d JOIN ks ON ks.source = d.source AND ks.cdf <= d.u GROUP BY d.doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counted
"""
