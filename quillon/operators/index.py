"""Building an inverted index: catalog, postings, document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import distinct_tokens


def docs(corpus: DataFrame) -> DataFrame:
    """The catalog (doc_id, name); documents without tokens are in it too."""
    return corpus.select("doc_id", "name")


def postings(corpus: DataFrame) -> DataFrame:
    """(token, doc_id), each pair once. Deduplicated per row: no shuffle."""
    return corpus.select("doc_id", F.explode(distinct_tokens("text")).alias("token")).select("token", "doc_id")


def postings_from_tokens(tokenized: DataFrame) -> DataFrame:
    """The same from (doc_id, tokens ARRAY<STRING>)."""
    return tokenized.select(F.explode(F.array_distinct("tokens")).alias("token"), "doc_id")


def terms(posting_rows: DataFrame) -> DataFrame:
    """(token, df)."""
    return posting_rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def stats(posting_rows: DataFrame) -> DataFrame:
    """One row: vocab, postings, max_df, singletons."""
    return terms(posting_rows).agg(
        F.count(F.lit(1)).alias("vocab"),
        F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings"),
        F.max("df").alias("max_df"),
        F.coalesce(F.sum(F.when(F.col("df") == 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("singletons"),
    )


def posting_arrays(posting_rows: DataFrame) -> DataFrame:
    """(token, ids ARRAY<BIGINT>), ids ascending."""
    return posting_rows.groupBy("token").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


def posting_text(posting_rows: DataFrame) -> DataFrame:
    """(token, ids STRING): ids ascending and comma separated, the text form of a list."""
    return posting_arrays(posting_rows).select("token", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def parse_posting_text(lines: DataFrame) -> DataFrame:
    """(token, doc_id) from the text form."""
    return lines.select("token", F.explode(F.split("ids", ",").cast("array<long>")).alias("doc_id"))


def merge_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer merge of two (token, ids) runs; lists of both are concatenated, the first run's ids ahead."""
    none = F.array().cast("array<long>")
    a, b = first.withColumnRenamed("ids", "_a"), second.withColumnRenamed("ids", "_b")
    return a.join(b, "token", "full_outer").select("token", F.concat(F.coalesce("_a", none), F.coalesce("_b", none)).alias("ids"))
