"""One query per search operator, over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import tokens, whitespace_tokens
from quillon.operators import index as ix
from quillon.operators import lists as ls
from quillon.operators import search as sx
from quillon.sources.corpus import from_table, read_jsonl
from quillon.sources.scratch import scratch_path
from quillon.sources.store import Store

MIDDLE = 500


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", F.concat(F.lit("doc"), F.col("doc_id")), "text")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(_documents(spark, sf_dir))


def _post(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return (
        f"post AS (SELECT {key} AS doc_id, unnest(list_distinct(list_transform("
        f"regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS token FROM {table})"
    )


POST = "WITH " + _post()


_stores: dict[tuple[str, str], Store] = {}


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """An index of the documents in two segments, the second appended; made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, scratch_path(spark, "store"))
        corpus = _documents(spark, sf_dir)
        store.add(corpus.where(F.col("doc_id") < MIDDLE))
        store.add(corpus.where(F.coalesce(F.col("doc_id") >= MIDDLE, F.lit(True))))
        _stores[key] = store
    return _stores[key]


def _stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    return sx.with_names(store.search(["en", "the"]), store.docs())


def _stored_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's matches: alone from the term table, together from the lists."""
    store = _stored(spark, sf_dir)
    one = store.terms().where(F.col("token").isin("en", "the")).select(F.col("token").alias("query"), F.col("df").alias("hits"))
    return one.unionByName(store.search(["en", "the"]).agg(F.count(F.lit(1)).alias("hits")).select(F.lit("en the").alias("query"), "hits"))


def _stored_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term table of an index of four segments made one."""
    store = Store(spark, scratch_path(spark, "compacted"))
    corpus = _documents(spark, sf_dir)
    for part in range(4):
        store.add(corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part))
    store.compact()
    return store.terms()


def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as JSON lines and read as a corpus: the tokens of each name."""
    path = scratch_path(spark, "jsonl")
    _documents(spark, sf_dir).select(F.col("name").alias("id"), "text").write.json(path)
    return read_jsonl(spark, path).select("name", F.size(tokens("text")).cast("long").alias("n"))


def _on_postings(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_postings(spark, sf_dir))


def _df_over(table: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return ix.terms(ix.postings(from_table(rows, F.lit(0), F.lit(""), text)))

    return run


def _token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(tokens("text")).cast("long").alias("n"))


def _whitespace_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(whitespace_tokens("text")).cast("long").alias("n"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.docs(_documents(spark, sf_dir))


def _search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _documents(spark, sf_dir)
    return sx.with_names(sx.search_and(ix.postings(corpus), "en the"), ix.docs(corpus))


def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.search_semi(_postings(spark, sf_dir), ["the", "en"])


def _queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("qid"), "text")


def _batch_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.batch_counts(_queries_table(spark, sf_dir), _postings(spark, sf_dir))


def _batch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.batch_hits(_queries_table(spark, sf_dir), _postings(spark, sf_dir))


COMMANDS = [
    (0, "COUNT", "the"), (1, "COUNT", "en the"), (2, "TOP_10", "en the"), (3, "TOP_10_COUNT", "The, THE"), (4, "COUNT", ""),
    (5, "COUNT", '+en -"the"'), (6, "FOO", "the"), (7, "COUNT", "the nosuchtoken"), (8, "TOP_10", "nosuchtoken"), (9, "COUNT", "!!! ---"),
]


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.run_commands(spark.createDataFrame(COMMANDS, "id long, cmd string, query string"), _postings(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir)
    early, late = rows.where(F.col("doc_id") < MIDDLE), rows.where(F.col("doc_id") >= MIDDLE)
    merged = ix.merge_runs(ix.posting_arrays(early), ix.posting_arrays(late))
    return merged.select("token", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.parse_posting_text(ix.posting_text(_postings(spark, sf_dir)))


def _two_lists(rows: DataFrame) -> DataFrame:
    held = rows.where(F.col("token").isin("en", "the")).groupBy().pivot("token", ["en", "the"]).agg(F.sort_array(F.collect_list("doc_id")))
    return held.select(F.array_join(ls.intersect_arrays(F.col("en"), F.col("the")).cast("array<string>"), ",").alias("ids"))


def _seek_array(rows: DataFrame) -> DataFrame:
    held = ix.posting_arrays(rows)
    at = F.lit(MIDDLE).cast("long")
    return held.select("token", ls.seek_array(F.col("ids"), at).alias("doc_id"), ls.lower_bound_array(F.col("ids"), at).cast("long").alias("pos"))


def _encoded(rows: DataFrame) -> DataFrame:
    return ls.encoded_bytes(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "token_count": _token_count,
    "whitespace_count": _whitespace_count,
    "catalog": _docs,
    "postings": _postings,
    "term_df": _on_postings(ix.terms),
    "term_df_conversations": _df_over("conversations", "text"),
    "term_df_pages": _df_over("pages", "html"),
    "term_df_part": _df_over("part", "p_name"),
    "term_df_benchmark": _df_over("benchmark", "text"),
    "index_stats": _on_postings(ix.stats),
    "posting_text": _on_postings(ix.posting_text),
    "posting_text_parsed": _parsed,
    "get_term": _on_postings(lambda p: sx.search_and(p, ["the"])),
    "get_missing": _on_postings(lambda p: sx.search_and(p, ["nosuchtoken"])),
    "search_and_2": _on_postings(lambda p: sx.search_and(p, "en the")),
    "search_and_3": _on_postings(lambda p: sx.search_and(p, "the of and")),
    "search_semi": _semi,
    "search_names": _search_names,
    "search_duplicate_token": _on_postings(lambda p: sx.search_and(p, "The, THE")),
    "search_punctuation": _on_postings(lambda p: sx.search_and(p, '+en -"the"')),
    "search_unknown": _on_postings(lambda p: sx.search_and(p, "the nosuchtoken")),
    "search_empty": _on_postings(lambda p: sx.search_and(p, "!!!")),
    "count_empty": _on_postings(lambda p: sx.count_and(p, "")),
    "count_1": _on_postings(lambda p: sx.count_and(p, "the")),
    "count_and": _on_postings(lambda p: sx.count_and(p, "en the")),
    "batch_and": _batch_and,
    "batch_hits": _batch_hits,
    "commands": _commands,
    "stored_postings": lambda spark, sf_dir: _stored(spark, sf_dir).postings().select("token", "doc_id"),
    "stored_term_df": lambda spark, sf_dir: _stored(spark, sf_dir).terms(),
    "stored_catalog": lambda spark, sf_dir: _stored(spark, sf_dir).docs(),
    "stored_get_term": lambda spark, sf_dir: _stored(spark, sf_dir).lookup(["the"]).select("doc_id"),
    "stored_search_names": _stored_names,
    "stored_count": _stored_count,
    "stored_commands": lambda spark, sf_dir: _stored(spark, sf_dir).run(spark.createDataFrame(COMMANDS, "id long, cmd string, query string")),
    "stored_compacted": _stored_compacted,
    "jsonl_source": _jsonl,
    "posting_tier": _on_postings(ls.tier),
    "varint_bytes": _on_postings(_encoded),
    "seek_ge": _on_postings(lambda p: ls.seek(p, MIDDLE)),
    "seek_array": _on_postings(_seek_array),
    "next_pos": _on_postings(ls.successor),
    "lower_bound": _on_postings(lambda p: ls.lower_bound(p, MIDDLE)),
    "merge_runs": _runs,
    "array_intersect": _on_postings(_two_lists),
}

_HAS = "SELECT doc_id FROM post WHERE token IN ({0}) GROUP BY doc_id HAVING count(*) = {1}"
_TWO = f"{POST} " + _HAS.format("'en', 'the'", 2)
_TEXT = "string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)"
_VARINT = "CASE WHEN doc_id <= 127 THEN 1 WHEN doc_id <= 8191 THEN 2 WHEN doc_id <= 262143 THEN 3 WHEN doc_id <= 4194303 THEN 4 ELSE 5 END"
_DF = "SELECT token, count(*) AS df FROM post GROUP BY token"
_ITEMS = (
    "q AS (SELECT item_id AS qid, unnest(list_distinct(t)) AS token, len(list_distinct(t)) AS n FROM (SELECT item_id, "
    "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM benchmark)), "
    "h AS (SELECT qid, doc_id FROM q JOIN post USING (token) GROUP BY qid, doc_id HAVING count(*) = min(n))"
)
_COMMANDS = ", ".join(f"({i}, '{c}', '{q}')" for i, c, q in COMMANDS)

ORACLES: dict[str, str] = {
    "token_count": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents",
    "whitespace_count": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents",
    "catalog": "SELECT doc_id, concat('doc', doc_id) AS name FROM documents",
    "postings": f"{POST} SELECT token, doc_id FROM post",
    "term_df": f"{POST} {_DF}",
    "term_df_conversations": f"WITH {_post('conversations', '0')} {_DF}",
    "term_df_pages": f"WITH {_post('pages', '0', 'html')} {_DF}",
    "term_df_part": f"WITH {_post('part', '0', 'p_name')} {_DF}",
    "term_df_benchmark": f"WITH {_post('benchmark', '0')} {_DF}",
    "index_stats": f"{POST}, d AS ({_DF}) SELECT count(*) AS vocab, CAST(sum(df) AS BIGINT) AS postings, max(df) AS max_df, CAST(sum(CASE WHEN df = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons FROM d",
    "posting_text": f"{POST} SELECT token, {_TEXT} AS ids FROM post GROUP BY token",
    "posting_text_parsed": f"{POST} SELECT token, doc_id FROM post",
    "get_term": f"{POST} SELECT doc_id FROM post WHERE token = 'the'",
    "get_missing": f"{POST} SELECT doc_id FROM post WHERE token = 'nosuchtoken'",
    "search_and_2": _TWO,
    "search_and_3": f"{POST} " + _HAS.format("'the', 'of', 'and'", 3),
    "search_semi": f"{POST} SELECT doc_id FROM post WHERE token = 'the' INTERSECT SELECT doc_id FROM post WHERE token = 'en'",
    "search_names": f"WITH {_post()}, h AS ({_HAS.format(chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'the' + chr(39), 2)}) SELECT doc_id, concat('doc', doc_id) AS name FROM h ORDER BY doc_id",
    "search_duplicate_token": f"{POST} SELECT doc_id FROM post WHERE token = 'the'",
    "search_punctuation": _TWO,
    "search_unknown": f"{POST} " + _HAS.format("'the', 'nosuchtoken'", 2),
    "search_empty": "SELECT doc_id FROM documents WHERE false",
    "count_empty": "SELECT CAST(0 AS BIGINT) AS hits",
    "count_1": f"{POST} SELECT count(*) AS hits FROM post WHERE token = 'the'",
    "count_and": f"WITH {_post()}, h AS ({_HAS.format(chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'the' + chr(39), 2)}) SELECT count(*) AS hits FROM h",
    "batch_and": f"WITH {_post()}, {_ITEMS} SELECT item_id AS qid, count(h.doc_id) AS hits FROM benchmark LEFT JOIN h ON qid = item_id GROUP BY item_id",
    "batch_hits": f"WITH {_post()}, {_ITEMS} SELECT qid, doc_id FROM h",
    "commands": f"""WITH {_post()}, c(id, cmd, query) AS (VALUES {_COMMANDS}),
        q AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS token,
              len(list_distinct(list_transform(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS n FROM c),
        h AS (SELECT id, doc_id FROM q JOIN post USING (token) GROUP BY id, doc_id HAVING count(*) = min(n)),
        k AS (SELECT c.id, c.cmd, count(h.doc_id) AS hits FROM c LEFT JOIN h ON h.id = c.id GROUP BY c.id, c.cmd)
        SELECT CAST(id AS BIGINT) AS id, cmd, CAST(CASE WHEN cmd IN ('COUNT', 'TOP_10_COUNT') THEN hits WHEN cmd = 'TOP_10' THEN 1 ELSE 0 END AS BIGINT) AS result FROM k""",
    "posting_tier": f"{POST} SELECT token, count(*) AS df, CAST(CASE WHEN count(*) = 1 THEN 1 WHEN sum({_VARINT}) <= {ls.LIST_LIMIT} THEN 2 ELSE 3 END AS INTEGER) AS tier FROM post GROUP BY token",
    "varint_bytes": f"{POST} SELECT token, CAST(sum({_VARINT}) AS BIGINT) AS bytes FROM post GROUP BY token",
    "seek_ge": f"{POST} SELECT token, coalesce(min(doc_id) FILTER (WHERE doc_id >= {MIDDLE}), max(doc_id)) AS doc_id FROM post GROUP BY token",
    "seek_array": f"{POST} SELECT token, coalesce(min(doc_id) FILTER (WHERE doc_id >= {MIDDLE}), max(doc_id)) AS doc_id, count(*) FILTER (WHERE doc_id < {MIDDLE}) AS pos FROM post GROUP BY token",
    "next_pos": f"{POST} SELECT token, doc_id, lead(doc_id) OVER (PARTITION BY token ORDER BY doc_id) AS next_id FROM post",
    "lower_bound": f"{POST} SELECT token, count(*) FILTER (WHERE doc_id < {MIDDLE}) AS pos FROM post GROUP BY token",
    "merge_runs": f"{POST} SELECT token, {_TEXT} AS ids FROM post GROUP BY token",
    "array_intersect": f"WITH {_post()}, h AS ({_HAS.format(chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'the' + chr(39), 2)}) SELECT {_TEXT} AS ids FROM h",
}

ORACLES |= {
    "stored_postings": ORACLES["postings"],
    "stored_term_df": ORACLES["term_df"],
    "stored_catalog": ORACLES["catalog"],
    "stored_get_term": ORACLES["get_term"],
    "stored_search_names": ORACLES["search_names"],
    "stored_count": f"{POST} SELECT token AS query, count(*) AS hits FROM post WHERE token IN ('en', 'the') GROUP BY token UNION ALL SELECT 'en the', count(*) FROM ({_HAS.format(chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'the' + chr(39), 2)})",
    "stored_commands": ORACLES["commands"],
    "stored_compacted": ORACLES["term_df"],
    "jsonl_source": "SELECT concat('doc', doc_id) AS name, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents",
}
