"""Conjunctive search over postings, for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import distinct_tokens, query_terms


#: Rows of ids or tokens up to which a join side is broadcast.
BROADCAST_ROWS = 1_000_000
#: Tokens of a batch up to which all pairs of a query and a document that share one are counted at once.
FEW_TOKENS = 100


def search_and(postings: DataFrame, query: str | list[str]) -> DataFrame:
    """(doc_id) of the documents that hold every token of the query.

    A query without tokens matches nothing; repeated tokens count once. One
    token needs no aggregate; more need one, with map-side combining on doc_id,
    so the length of a list doesn't matter to any single task.
    """
    wanted = query_terms(query) if isinstance(query, str) else list(dict.fromkeys(query))
    if not wanted:
        return postings.select("doc_id").where(F.lit(False))
    rows = postings.where(F.col("token").isin(wanted))
    if len(wanted) == 1:
        return rows.select("doc_id")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select("doc_id")


def search_semi(postings: DataFrame, ordered: list[str]) -> DataFrame:
    """The same as a chain of semi joins, in the given order: pass the rarest token first."""
    wanted = list(dict.fromkeys(ordered))
    if not wanted:
        return postings.select("doc_id").where(F.lit(False))
    out = postings.where(F.col("token") == wanted[0]).select("doc_id")
    for token in wanted[1:]:
        out = out.join(postings.where(F.col("token") == token).select("doc_id"), "doc_id", "left_semi")
    return out


def frequencies(terms: DataFrame, tokens: list[str]) -> dict[str, int]:
    """df of those of the tokens that occur."""
    return {r.token: r.df for r in terms.where(F.col("token").isin(tokens)).collect()} if tokens else {}


def rarest_first(terms: DataFrame, tokens: list[str]) -> list[str] | None:
    """The tokens by ascending df (ties in the given order); None if one is unknown."""
    known = frequencies(terms, tokens)
    return sorted(tokens, key=known.__getitem__) if all(t in known for t in tokens) else None


def search_ordered(postings: DataFrame, ordered: list[str], smallest: int) -> DataFrame:
    """The same for tokens from the rarest on, whose df is ``smallest``.

    Up to BROADCAST_ROWS ids the rarest list is broadcast and the others stream
    past what is left of it, without a shuffle; beyond, lists are aggregated.
    """
    if len(ordered) < 2 or smallest > BROADCAST_ROWS:
        return search_and(postings, ordered)
    one = lambda token: postings.where(F.col("token") == token).select("doc_id")
    out = one(ordered[0])
    for token in ordered[1:]:
        out = one(token).join(F.broadcast(out), "doc_id", "left_semi")
    return out


def with_names(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, name) in ascending doc_id; a name that occurs twice is returned twice."""
    return hits.join(docs, "doc_id").select("doc_id", "name").orderBy("doc_id")


def count_and(postings: DataFrame, query: str | list[str]) -> DataFrame:
    """One row (hits) with the number of matches."""
    return search_and(postings, query).agg(F.count(F.lit(1)).alias("hits"))


def query_tokens(queries: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, token, n): a row per distinct token; n is how many the query has."""
    held = queries.select(key, distinct_tokens(text).alias("_tokens"))
    return held.select(key, F.explode("_tokens").alias("token"), F.size("_tokens").alias("n"))


def _rarest(asked: DataFrame, postings: DataFrame, key: str) -> DataFrame | None:
    """(qid, token) with the rarest token of every query whose tokens all occur.

    None if the postings of those tokens are too many to broadcast, or if a
    query's key occurs twice. Costs one pass over the postings.
    """
    whole = asked.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min("n").alias("_n"), F.max("n").alias("_top"))
    if not whole.where((F.col("_rows") != F.col("_n")) | (F.col("_rows") != F.col("_top"))).isEmpty():
        return None
    df = postings.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    known = asked.join(df, "token").groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min("n").alias("_n"), F.min(F.struct("_df", "token")).alias("_least"))
    rows = known.where(F.col("_rows") == F.col("_n")).select(key, "_least.token", "_least._df").collect()
    if sum(r["_df"] for r in rows) > BROADCAST_ROWS:
        return None
    return asked.sparkSession.createDataFrame([(r[key], r["token"]) for r in rows], asked.select(key, "token").schema)


def batch_hits(queries: DataFrame, postings: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, doc_id) of all matches of all queries, in one plan; a doc_id is one document's.

    A large batch first finds the documents that hold the rarest token of a
    query, and counts the other tokens in those alone: nearly every query and
    document share some common word, and pairs of them are too many to hold.
    """
    asked = query_tokens(queries, key, text)
    # The tokens of the queries, not the postings, are what is broadcast; beyond the limit both sides are shuffled.
    n = asked.limit(BROADCAST_ROWS + 1).count()
    small = n <= BROADCAST_ROWS
    rarest = _rarest(asked, postings, key) if small and n > FEW_TOKENS else None
    if rarest is None:
        rows = postings.join(F.broadcast(asked) if small else asked.hint("merge"), "token")
    else:
        likely = postings.join(F.broadcast(rarest), "token").select(F.col(key).alias("_q"), F.col("doc_id").alias("_d")).distinct()
        held = postings.join(F.broadcast(likely), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
        rows = held.join(F.broadcast(asked), "token")
        rows = rows.join(F.broadcast(likely), F.col(key).eqNullSafe(F.col("_q")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    matched = rows.groupBy(key, "doc_id").agg(F.count(F.lit(1)).alias("_got"), F.first("n").alias("_n"))
    return matched.where(F.col("_got") == F.col("_n")).select(key, "doc_id")


def batch_counts(queries: DataFrame, postings: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, hits) for every query; those without matches have 0."""
    counts = batch_hits(queries, postings, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    return queries.select(key).join(counts, key, "left").select(key, F.coalesce("_hits", F.lit(0)).cast("long").alias("hits"))


def answer(cmd: Column, hits: Column) -> Column:
    """The number that a command prints: COUNT and TOP_10_COUNT the matches, TOP_10 always 1, others 0."""
    return F.when(cmd.isin("COUNT", "TOP_10_COUNT"), hits).when(cmd == "TOP_10", F.lit(1)).otherwise(F.lit(0)).cast("long")


def run_commands(commands: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, cmd, result) for a table (id, cmd, query). A NULL query has no tokens."""
    counted = batch_counts(commands.select("id", "query"), postings, "id", "query")
    return commands.join(counted, "id").select("id", "cmd", answer(F.col("cmd"), F.col("hits")).alias("result"))
