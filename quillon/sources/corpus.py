"""Corpora as DataFrames of (doc_id BIGINT, name STRING, text STRING)."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])


#: File splits whose offsets are broadcast: 100 TB in splits of 128 MB are 800,000.
BROADCAST_SPLITS = 2_000_000


def _placed(raw: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and where a row was read: _path, _block, _row."""
    return raw.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def number_rows(placed: DataFrame, start: int = 0) -> DataFrame:
    """Add dense doc_id values from ``start``, by file name and then position in the file.

    Rows of a split are read one after another, so a row's place in its split
    is its _row less the split's smallest. Splits are counted first; texts are
    neither sorted nor shuffled for their numbers.
    """
    splits = placed.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_path", "_block", "_first", (F.coalesce(before, F.lit(0)) + F.lit(start)).alias("_offset"))
    small = splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    joined = placed.join(F.broadcast(offsets) if small else offsets, ["_path", "_block"])
    return joined.withColumn("doc_id", F.col("_offset") + F.col("_row") - F.col("_first")).drop("_path", "_block", "_row", "_first", "_offset")


def read_jsonl(spark: SparkSession, path: str | list[str], start: int = 0) -> DataFrame:
    """Read JSON lines with ``id`` and ``text``; other keys are ignored.

    Malformed lines and records without either key fail the read. Ids follow
    file name, then position in the file.
    """
    raw = spark.read.schema("id string, text string").option("mode", "FAILFAST").json(path)
    missing = F.raise_error(F.lit("corpus record without id or text"))
    name = F.when(F.col("id").isNull() | F.col("text").isNull(), missing).otherwise(F.col("id")).alias("name")
    return number_rows(_placed(raw, name, F.col("text")), start).select("doc_id", "name", "text")


def parse_jsonl(spark: SparkSession, lines: Iterable[str], start: int = 0) -> DataFrame:
    """The same from lines that the driver holds, standard input for one. Blank lines are skipped."""
    rows = []
    for line in lines:
        if line.strip():
            record = json.loads(line)
            if record.get("id") is None or record.get("text") is None:
                raise ValueError("corpus record without id or text")
            rows.append((start + len(rows), str(record["id"]), record["text"]))
    return spark.createDataFrame(rows, CORPUS)


def from_table(df: DataFrame, key: Column | str, name: Column | str, text: Column | str) -> DataFrame:
    """A table that has its own integer key as a corpus; the key becomes doc_id."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(key).cast("long").alias("doc_id"), as_col(name).cast("string").alias("name"), as_col(text).alias("text"))


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Read ``COMMAND<TAB>query`` lines as (id, cmd, query); a line without a TAB has a NULL query."""
    numbered = number_rows(_placed(spark.read.text(path), F.col("value")))
    parts = F.split("value", "\t")
    return numbered.select(F.col("doc_id").alias("id"), parts[0].alias("cmd"), F.get(parts, F.lit(1)).alias("query"))
