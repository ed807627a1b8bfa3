"""The stored index, its plans, the interfaces and the commands that read standard input."""

import io
import json

import pytest
from pyspark.sql import functions as F

from quillon import MemoryDocList, MemoryInvertedIndex, cli
from quillon.engine import Engine
from quillon.operators import lists as ls
from quillon.operators import search as sx
from quillon.sources.corpus import parse_jsonl, read_jsonl
from quillon.sources.store import Store

SCHEMA = "doc_id long, name string, text string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_bucket_count_is_stored(spark, tmp_path):
    words = [f"w{i}" for i in range(20)]
    Store(spark, str(tmp_path / "i"), 8).add(spark.createDataFrame([(0, "a", " ".join(words))], SCHEMA))
    again = Store(spark, str(tmp_path / "i"), 16)
    assert again.buckets == 8
    assert all(_ids(again.lookup([w])) == [0] for w in words)


def test_lookup_prunes_and_pushes_down(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"), 8)
    store.add(spark.createDataFrame([(0, "a", "x y z"), (1, "b", "x")], SCHEMA))
    plan = _plan(store.lookup(["x"]))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan.replace("isnotnull(", "")
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,x)]" in plan or "In(token" in plan
    assert "text" not in plan


def test_rarest_list_is_broadcast_and_unknown_words_read_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    store.add(spark.createDataFrame([(i, f"n{i}", "common" + (" rare" if i == 7 else "")) for i in range(50)], SCHEMA))
    found = store.search(["common", "rare"])
    assert _ids(found) == [7]
    assert "BroadcastHashJoin" in _plan(found) and "SortMergeJoin" not in _plan(found)
    assert "Scan parquet" not in _plan(store.search(["common", "nosuch"]))


def test_long_rarest_list_is_aggregated(spark, monkeypatch):
    monkeypatch.setattr(sx, "BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4)], "token string, doc_id long")
    assert _ids(sx.search_ordered(rows, ["a", "b"], 2)) == [2]
    queries = spark.createDataFrame([(0, "a b"), (1, "b")], "qid long, text string")
    assert sorted((r.qid, r.hits) for r in sx.batch_counts(queries, rows).collect()) == [(0, 1), (1, 3)]


def test_compaction_keeps_everything(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    for i in range(5):
        store.add(spark.createDataFrame([(i, f"n{i}", f"x w{i}")], SCHEMA))
    before = sorted(map(tuple, store.postings().select("token", "doc_id").collect()))
    store.compact()
    assert len(store.segments()) == 1
    assert sorted(map(tuple, store.postings().select("token", "doc_id").collect())) == before
    assert sorted(r.name for r in store.docs().collect()) == [f"n{i}" for i in range(5)]
    store.add(spark.createDataFrame([(5, "late", "x")], SCHEMA))
    assert store.frequencies(["x"]) == {"x": 6}


def test_jsonl_numbers_without_sort_or_rdd(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id": "b", "text": "x"}\n')
    (tmp_path / "a.json").write_text('{"id": "a1", "text": "x"}\n{"id": "a2", "text": "y"}\n')
    rows = read_jsonl(spark, str(tmp_path / "*.json"), start=5)
    assert [(r.doc_id, r.name) for r in rows.orderBy("doc_id").collect()] == [(5, "a1"), (6, "a2"), (7, "b")]
    assert "Python" not in _plan(rows) and "ExistingRDD" not in _plan(rows)


def test_lines_from_the_driver(spark):
    rows = parse_jsonl(spark, ['{"id": "a", "text": "x", "more": 1}\n', "\n", '{"id": 7, "text": ""}'], 3).collect()
    assert [(r.doc_id, r.name, r.text) for r in rows] == [(3, "a", "x"), (4, "7", "")]
    with pytest.raises(ValueError, match="without id or text"):
        parse_jsonl(spark, ['{"id": "a"}'])
    with pytest.raises(json.JSONDecodeError):
        parse_jsonl(spark, ["{"])


def test_build_from_standard_input_and_demos(spark, tmp_path, capsys, monkeypatch):
    lines = '{"id": "a", "text": "hello the world"}\n{"id": "b", "text": "the"}\n'
    monkeypatch.setattr("sys.stdin", io.StringIO(lines))
    cli.main(["build-index", str(tmp_path / "i")])
    cli.main(["search", str(tmp_path / "i"), "--query", "the", "--query", "hello the"])
    assert capsys.readouterr().out.splitlines() == ["the: 2", "the: a, b", "hello the: a"]
    monkeypatch.setattr("sys.stdin", io.StringIO(lines))
    cli.main(["main", str(tmp_path / "j")])
    assert "hello: a" in capsys.readouterr().out.splitlines()


def test_engine_uses_rarest_first_when_cached(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    for i in range(6):
        e.index(f"n{i}", "common" + (" rare" if i == 2 else ""))
    e.save()
    e.restore(cache=True)
    assert e.search("common rare") == ["n2"] and e.count("rare common") == 1 and e.search("common nosuch") == []
    assert "BroadcastHashJoin" in _plan(e.hits("common rare"))
    e.clear()


def test_catalog_and_index_of_ones_own(spark, tmp_path):
    names = MemoryDocList(spark, str(tmp_path))
    assert [names.add("p"), names.add("q")] == [0, 1] and names.get(1) == "q"
    names.save()
    names.clear()
    names.restore()
    assert names.get(0) == "p"
    index = MemoryInvertedIndex(spark, str(tmp_path))
    index.add(0, ["c", "b"])
    index.add(1, ["a", "c", "a"])
    for _ in range(2):  # before and after save and restore
        assert [index.get(t) for t in "abcd"] == [[1], [0], [0, 1], []]
        assert index.search_and(["a", "c"]) == [1] and index.count_and(["a", "b"]) == 0 and index.count_and([]) == 0
        index.save()
        index.restore()
    index.add(2, ["a"])
    assert index.get("a") == [1, 2]
    index.clear()
    assert index.get("a") == []


def test_tier_options(spark):
    rows = spark.createDataFrame([("one", 1)] + [("nine", i) for i in range(1, 10)] + [("three", i) for i in range(1, 4)], "token string, doc_id long")
    tiers = lambda **k: {r.token: r.tier for r in ls.tier(rows, **k).collect()}
    assert tiers(block_size=10) == {"one": 1, "three": 2, "nine": 3}
    assert tiers(block_size=9) == {"one": 1, "three": 2, "nine": 3}
    assert tiers(block_size=9, max_level=0) == {"one": 1, "three": 2, "nine": 2}


def test_commands_broadcast_the_queries(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("token"), F.col("id").alias("doc_id"))
    asked = spark.createDataFrame([(0, "COUNT", "t1")], "id long, cmd string, query string")
    plan = _plan(sx.batch_hits(asked.select("id", "query"), rows, "id", "query"))
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
