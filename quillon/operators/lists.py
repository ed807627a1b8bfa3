"""Posting-list operators: seek, successor, rank, intersection, encoded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SIZE, MAX_LEVEL = 44, 10
#: Bytes of a block that hold ids; the rest is its head.
LIST_LIMIT = BLOCK_SIZE - 5
_WIDTHS = ((127, 1), (8_191, 2), (262_143, 3), (4_194_303, 4))


def varint_length(doc_id: Column) -> Column:
    """Bytes of an id in a prefix-length code of 7, 13, 18, 22 or 25 payload bits."""
    out = None
    for top, width in _WIDTHS:
        out = F.when(doc_id <= top, width) if out is None else out.when(doc_id <= top, width)
    return out.otherwise(5)


def encoded_bytes(postings: DataFrame) -> DataFrame:
    """(token, bytes): size of each encoded list."""
    return postings.groupBy("token").agg(F.sum(varint_length(F.col("doc_id"))).cast("long").alias("bytes"))


def tier(postings: DataFrame, block_size: int = BLOCK_SIZE, max_level: int = MAX_LEVEL) -> DataFrame:
    """(token, df, tier): 1 for a single id, 2 for a list that fits a block, else 3; without levels (0) every list is flat."""
    sized = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(varint_length(F.col("doc_id"))).alias("_bytes"))
    kind = F.when(F.col("df") == 1, 1).when((F.col("_bytes") <= block_size - 5) | F.lit(max_level == 0), 2).otherwise(3)
    return sized.select("token", "df", kind.cast("int").alias("tier"))


def seek(postings: DataFrame, target: int) -> DataFrame:
    """(token, doc_id): the first id at or after the target, else the list's last id."""
    at = F.min(F.when(F.col("doc_id") >= target, F.col("doc_id")))
    return postings.groupBy("token").agg(F.coalesce(at, F.max("doc_id")).alias("doc_id"))


def successor(postings: DataFrame) -> DataFrame:
    """(token, doc_id, next_id); next_id is NULL at the end of a list."""
    return postings.select("token", "doc_id", F.lead("doc_id").over(Window.partitionBy("token").orderBy("doc_id")).alias("next_id"))


def lower_bound(postings: DataFrame, target: int) -> DataFrame:
    """(token, pos): how many ids of the list lie before the target."""
    return postings.groupBy("token").agg(F.count(F.when(F.col("doc_id") < target, 1)).alias("pos"))


def lower_bound_array(ids: Column, target: Column | int) -> Column:
    """The same for a list held as an array."""
    return F.size(F.filter(ids, lambda x: x < target))


def seek_array(ids: Column, target: Column | int) -> Column:
    """The first element at or after the target, else the last; NULL for an empty list."""
    return F.coalesce(F.array_min(F.filter(ids, lambda x: x >= target)), F.array_max(ids))


def intersect_arrays(a: Column, b: Column) -> Column:
    """Sorted intersection of two sorted lists."""
    return F.array_sort(F.array_intersect(a, b))
