"""Commands over a stored index read the lists of their words alone."""

import pytest

from quillon.engine import Engine
from quillon.operators import search as sx
from quillon.plans.queries import QUERIES
from quillon.sources import store as st
from quillon.sources.store import Store

ROWS = [(0, "a", "The en x"), (1, "b", "the y"), (2, "c", "en"), (3, "d", None), (4, "e", "the EN z")]
COMMANDS = [(0, "COUNT", "the"), (1, "COUNT", "en the"), (2, "TOP_10_COUNT", "THE en, the"), (3, "COUNT", "the nosuch"), (4, "COUNT", ""), (5, "COUNT", None), (6, "TOP_10", "x"), (6, "COUNT", "x")]


def _asked(spark, rows=COMMANDS):
    return spark.createDataFrame(rows, "id long, cmd string, query string")


def _all(df):
    return sorted(map(tuple, df.collect()))


def _scans(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]


def test_registered_query_pushes_its_words_down(spark):
    scans = _scans(QUERIES["stored_commands"](spark, "/root/testdata/sf0.001"))
    assert scans and all("token IN (" in s or "In(token" in s for s in scans)


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_same_answers_as_over_all_postings(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(st, "LOOKUP_TOKENS", limit)
    store = Store(spark, str(tmp_path / "i"), 8)
    for part in (ROWS[:2], ROWS[2:]):
        store.add(spark.createDataFrame(part, "doc_id long, name string, text string"))
    for rows in (COMMANDS, COMMANDS[4:6], []):
        assert _all(store.run(_asked(spark, rows))) == _all(sx.run_commands(_asked(spark, rows), store.postings()))


def test_a_common_word_is_counted_by_many_tasks(spark, tmp_path):
    """Lists are dealt out by doc_id before they are paired with commands, and the pairs aren't shuffled again."""
    store = Store(spark, str(tmp_path / "i"), 2)
    store.add(spark.range(100).selectExpr("id AS doc_id", "concat('n', id) AS name", "'the' AS text"))
    plan = store.run(_asked(spark, COMMANDS[:2]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any("Exchange hashpartitioning(id" in x and "doc_id" in x for x in plan.splitlines())


def test_an_index_without_segments_answers_nothing_found(spark, tmp_path):
    assert _all(Store(spark, str(tmp_path / "i")).run(_asked(spark, COMMANDS[:2]))) == [(0, "COUNT", 0), (1, "COUNT", 0)]


def test_engine_reads_the_lists_of_the_words(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index_frame(spark.createDataFrame(ROWS, "doc_id long, name string, text string"))
    e.save()
    e.restore()
    out = e.run(_asked(spark, COMMANDS[:2]))
    assert all("token IN (" in s or "In(token" in s for s in _scans(out)) and _all(out) == [(0, "COUNT", 3), (1, "COUNT", 2)]
