"""A corpus pipeline: toxic documents out, copies out, near copies out, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread before the next. All but the last return the
columns of documents, others that the table may have included. The scratch
tables of a stage go when the next stage begins, so a result must be written
before another run is started in the same program.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from quillon.llm.common import materialize, owned, release, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """Free what the stage before made, and own what this one makes."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release("stage")
        with owned("stage"):
            return f(spark, docs, sf_dir)

    return begin


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, against a new digest index."""
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"))
    out = exact_dedup.deduplicate(docs, index)
    index.forget()
    return out


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights, in mixed order."""
    return mixing.mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, sequence, position) of each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training a classifier and solving a linear program can't be said in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written before the next."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        out = function(spark, out, sf_dir)
        if name != STAGES[-1][0]:
            with owned(f"pipeline {name}"):
                out = materialize(out, name.replace(" ", "-"))
    return out
