import json
import random

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.engine import Engine
from quillon.functions import text as tx
from quillon.operators import index as ix
from quillon.operators import lists as ls
from quillon.operators import search as sx
from quillon.sources.corpus import read_commands, read_jsonl
from quillon.sources.store import Store
from quillon.streaming.ingest import ingest

TEXTS = ["Café Hello-World 42", "Kelvin İstanbul", "snake_case", "", "!!! ---", "a b\x1cc  d e", "The the THE"]


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_tokenizers_agree_with_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", tx.tokens("text").alias("a"), tx.whitespace_tokens("text").alias("b")).collect()
    for r in rows:
        assert r.a == tx.normalized_tokens(r.text)
        assert r.b == tx.tokenize(r.text)
    assert tx.normalized_tokens(TEXTS[0]) == ["caf", "hello", "world", "42"]
    assert tx.normalized_tokens(TEXTS[1]) == ["elvin", "stanbul"]


def test_pretokenized_index(spark):
    rows = spark.createDataFrame([(1, ["c", "b"]), (2, ["a", "c", "a"])], "doc_id long, tokens array<string>")
    p = ix.postings_from_tokens(rows).cache()
    expected = {"a": [2], "b": [1], "c": [1, 2], "d": []}
    for token, want in expected.items():
        assert ids(sx.search_and(p, [token])) == want
    for q, want in [("a b", []), ("a c", [2]), ("a d", []), ("b c", [1]), ("b d", []), ("a b c", []), ("", [])]:
        assert ids(sx.search_and(p, q)) == want
        assert sx.count_and(p, q).first()[0] == len(want)
        assert ids(sx.search_semi(p, q.split())) == want
    terms = ix.terms(p)
    assert sx.rarest_first(terms, ["c", "a"]) == ["a", "c"]
    assert sx.rarest_first(terms, ["c", "zz"]) is None


def test_engine_lifecycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "idx"))
    for name, text in [("id1", "hello world"), ("id2", "this is a test"), ("id3", "this is another test"), ("id3", "!!!")]:
        e.index(name, text)
    assert e.search("hello") == []
    e.save()
    e.clear()
    assert e.count("hello") == 0
    e.restore()
    assert (e.search("hello"), e.search("this test"), e.search("that"), e.search("")) == (["id1"], ["id2", "id3"], [], [])
    assert (e.count("hello"), e.count("this test"), e.count("that"), e.count("?!")) == (1, 2, 0, 0)
    assert e.store.docs().count() == 4
    e.index("late", "hello again")
    e.save()
    e.save()
    e.restore(cache=True)
    assert e.search("hello") == ["id1", "late"]
    assert e.count("hello") == 2
    commands = spark.createDataFrame([(0, "COUNT", "hello"), (1, "TOP_10", "zz"), (2, "FOO", "hello"), (3, "COUNT", None)], "id long, cmd string, query string")
    assert [r.result for r in e.run(commands).orderBy("id").collect()] == [2, 1, 0, 0]
    e.clear()


def test_duplicate_names_and_empty_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "idx"))
    e.save()
    e.restore()
    assert e.search("x") == [] and e.count("x") == 0
    e.index("same", "x y")
    e.index("same", "y x")
    e.save()
    e.restore()
    assert e.search("x y") == ["same", "same"]


def test_failed_segment_is_ignored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "idx"))
    corpus = spark.createDataFrame([(0, "a", "x")], "doc_id long, name string, text string")
    store.add(corpus)
    (tmp_path / "idx" / "seg-00001" / "docs").mkdir(parents=True)
    assert store.segments() == ["seg-00000"]
    store.add(corpus.withColumn("doc_id", F.lit(1).cast("long")))
    assert ids(sx.search_and(store.lookup(["x"]), ["x"])) == [0, 1]


def test_module_facade_needs_init(spark, tmp_path, monkeypatch):
    import quillon
    from quillon import engine

    monkeypatch.setattr(engine, "_engine", None)
    with pytest.raises(RuntimeError):
        quillon.search("x")
    quillon.init(str(tmp_path / "i"), spark)
    quillon.index("n", "one two")
    quillon.save_index()
    quillon.restore_index()
    assert quillon.search("two one") == ["n"] and quillon.count("one") == 1
    quillon.clear_index()
    assert quillon.search("one") == []


def test_jsonl_order_and_errors(spark, tmp_path):
    names = []
    for f in range(3):
        lines = [json.dumps({"id": f"f{f}r{i}", "text": "t", "extra": 1}) for i in range(50)]
        names += [f"f{f}r{i}" for i in range(50)]
        (tmp_path / f"{f}.json").write_text("\n".join(lines) + "\n")
    rows = read_jsonl(spark, str(tmp_path / "*.json")).orderBy("doc_id").collect()
    assert [r.name for r in rows] == names and [r.doc_id for r in rows] == list(range(150))
    bad = tmp_path / "bad"
    bad.write_text('{"id": "x"}\n')
    with pytest.raises(Exception, match="without id or text"):
        read_jsonl(spark, str(bad)).collect()


def test_cli(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "c.json").write_text('{"id": "a", "text": "x y"}\n{"id": "b", "text": "x"}\n')
    cli.main(["build-index", str(tmp_path / "i"), str(tmp_path / "c.json")])
    lines = "COUNT\tx\nCOUNT\tx y\textra\nTOP_10\tzz\nTOP_10_COUNT\tx\nFOO\tx\nCOUNT\n"
    (tmp_path / "q").write_text(lines)
    assert [r.query for r in read_commands(spark, str(tmp_path / "q")).orderBy("id").collect()] == ["x", "x y", "zz", "x", "x", None]
    cli.main(["do-query", str(tmp_path / "i"), str(tmp_path / "q")])
    assert capsys.readouterr().out.split() == ["2", "1", "1", "2", "0", "0"]
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO(lines))
    cli.main(["do-query", str(tmp_path / "i")])
    assert capsys.readouterr().out.split() == ["2", "1", "1", "2", "0", "0"]


def test_lists_against_python(spark):
    rng = random.Random(7)
    lists = [sorted(rng.sample(range(200), rng.randint(1, 50))) for _ in range(40)]
    rows = spark.createDataFrame([(f"t{i}", x) for i, ls_ in enumerate(lists) for x in ls_], "token string, doc_id long").cache()
    for target in (0, 57, 199, 500):
        got = {r.token: (r.doc_id) for r in ls.seek(rows, target).collect()}
        pos = {r.token: r.pos for r in ls.lower_bound(rows, target).collect()}
        for i, own in enumerate(lists):
            after = [x for x in own if x >= target]
            assert got[f"t{i}"] == (after[0] if after else own[-1])
            assert pos[f"t{i}"] == sum(x < target for x in own)
    pairs = spark.createDataFrame([(lists[i], lists[i + 1]) for i in range(39)], "a array<long>, b array<long>")
    for r in pairs.select("a", "b", ls.intersect_arrays(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == sorted(set(r.a) & set(r.b))
    tiers = spark.createDataFrame([("one", 1)] + [("few", i) for i in range(3)] + [("many", i) for i in range(100)], "token string, doc_id long")
    assert {r.token: r.tier for r in ls.tier(tiers).collect()} == {"one": 1, "few": 2, "many": 3}


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(0, "a", "x y"), (1, "b", "x")], "doc_id long, name string, text string").write.parquet(str(src))
    store = Store(spark, str(tmp_path / "idx"))
    stream = spark.readStream.schema("doc_id long, name string, text string").parquet(str(src))
    ingest(stream, store, str(tmp_path / "cp")).awaitTermination(60)
    assert ids(sx.search_and(store.lookup(["x", "y"]), "x y")) == [0]
