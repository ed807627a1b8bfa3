"""The batch queries ask for every word of an item, against brute force over sets of words."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from quillon.functions.text import normalized_tokens
from quillon.operators import index as ix
from quillon.operators import search as sx
from quillon.plans.queries import ORACLES, QUERIES
from oracle import SF, same

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
ITEMS = [
    (0, " ".join(WORDS)),
    (1, " ".join(WORDS[:3])),
    (2, "Alpha beta; gamma ALPHA delta, omega"),
    (3, "alpha beta gamma nosuchword"),
    (4, "!!!"),
    (5, None),
]
DOCS = [
    (0, " ".join(reversed(WORDS)) + " omega"),
    (1, " ".join(WORDS[:-1])),
    (2, "alpha beta gamma"),
    (3, "OMEGA delta gamma beta alpha"),
    (4, ""),
    (5, None),
]


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("batch")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def expected():
    held = {d: set(normalized_tokens(t or "")) for d, t in DOCS}
    asked = {q: set(normalized_tokens(t or "")) for q, t in ITEMS}
    return {q: {d for d, words in held.items() if asked[q] and asked[q] <= words} for q in asked}


def test_batch_hits_hold_every_word(spark, fixture_dir):
    got = {(r.qid, r.doc_id) for r in QUERIES["batch_hits"](spark, fixture_dir).collect()}
    assert got == {(q, d) for q, docs in expected().items() for d in docs}


def test_batch_counts_of_every_item(spark, fixture_dir):
    got = {r.qid: r.hits for r in QUERIES["batch_and"](spark, fixture_dir).collect()}
    assert got == {q: len(docs) for q, docs in expected().items()}


@pytest.mark.parametrize("name", ["batch_and", "batch_hits"])
def test_whole_items_equal_sql_of_whole_items(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


def _whole(spark, corpus, items):
    """Hits by brute force and by batch_hits, over lists of (key, text)."""
    postings = ix.postings(spark.createDataFrame(corpus, "doc_id long, text string"))
    got = sx.batch_hits(spark.createDataFrame(items, "qid long, text string"), postings)
    held = {d: set(normalized_tokens(t or "")) for d, t in corpus}
    asked = {q: set(normalized_tokens(t or "")) for q, t in items}
    return got, sorted(((q, d) for q in asked for d in held if asked[q] and asked[q] <= held[d]), key=repr)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_large_batches_hit_the_same(spark, monkeypatch, limit):
    """With and without the search for the rarest word first; limit 10 is less than the words asked for."""
    queries = spark.createDataFrame(ITEMS + [(None, "gamma")], "qid long, text string")
    rows = ix.postings(spark.createDataFrame(DOCS + [(None, "alpha beta gamma")], "doc_id long, text string"))
    monkeypatch.setattr(sx, "FEW_TOKENS", 10_000)
    plain = sorted(map(tuple, sx.batch_hits(queries, rows).collect()), key=repr)
    monkeypatch.setattr(sx, "FEW_TOKENS", 0)
    if limit < 100:
        monkeypatch.setattr(sx, "BROADCAST_ROWS", limit)
    assert sorted(map(tuple, sx.batch_hits(queries, rows).collect()), key=repr) == plain
    found, expected = _whole(spark, DOCS, ITEMS)
    assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_twice_used_keys_of_queries_stay_as_they_were(spark, monkeypatch):
    rows = ix.postings(spark.createDataFrame(DOCS, "doc_id long, text string"))
    queries = spark.createDataFrame([(0, "alpha"), (0, "beta gamma"), (1, "omega delta")], "qid long, text string")
    plain = sorted(map(tuple, sx.batch_hits(queries, rows).collect()))
    monkeypatch.setattr(sx, "FEW_TOKENS", 0)
    assert sorted(map(tuple, sx.batch_hits(queries, rows).collect())) == plain


def test_pairs_that_only_share_a_common_word_are_not_held(spark, monkeypatch):
    """300 documents and 40 items, all with a common word: 12,000 pairs, of which 40 share the items' own words."""
    corpus = [(i, f"common w{i}") for i in range(300)]
    seen = []
    group = DataFrame.groupBy

    def noted(df, *keys):
        if "doc_id" in keys:
            seen.append(df.count())
        return group(df, *keys)

    monkeypatch.setattr(sx, "FEW_TOKENS", 10)
    monkeypatch.setattr(DataFrame, "groupBy", noted)
    found, expected = _whole(spark, corpus, [(q, f"common w{q}") for q in range(40)])
    assert seen == [80]
    assert sorted(map(tuple, found.collect()), key=repr) == expected
