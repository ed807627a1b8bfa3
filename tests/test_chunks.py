"""Chunks of postings and the passes that building an index takes over its corpus."""

import uuid
from pathlib import Path

import pyarrow as pa
import pytest

from quillon.operators import chunks as ch
from quillon.operators import index as ix
from quillon.sources.store import Store

FAR = 5 << ch.SLICE_BITS
DOCS = [
    (0, "The the THE, en 7x"), (1, "enK İx the"), (FAR, "the en"), (FAR + 1, "the"), (-1, "the en"), (None, "the en"), (None, "the"),
    (2, None), (3, ""), (4, "!!! ---"), (0, "the again"), (9, "a_b-céd\x00e"),
]


def _pairs(df):
    return sorted(map(tuple, df.select("token", "doc_id").collect()), key=repr)


def _batches(rows, types):
    table = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(types.items())})
    return iter(table.to_batches(max_chunksize=4))


def _flat(batches):
    out = []
    for b in batches:
        assert all(len({None if i is None else i >> ch.SLICE_BITS for i in r["ids"]} | {r["slice"]}) == 1 for r in b.to_pylist())
        out += [(r["token"], i) for r in b.to_pylist() for i in r["ids"]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("at_once", [1, 3, 2_000_000])
def test_chunks_hold_all_postings(spark, monkeypatch, at_once):
    monkeypatch.setattr(ch, "GATHERED", at_once)
    expected = _pairs(ix.postings(spark.createDataFrame(DOCS, "doc_id long, text string")))
    assert _flat(ch._gather(_batches(DOCS, {"doc_id": pa.int64(), "text": pa.string()}))) == expected


def test_stored_postings_are_all_and_sorted(spark, tmp_path):
    corpus = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "concat('n', doc_id) AS name", "text")
    store = Store(spark, str(tmp_path / "i"), 2)
    store.add(corpus)
    assert _pairs(store.postings()) == _pairs(ix.postings(corpus))
    for f in Path(tmp_path / "i").rglob("postings/*/*.parquet"):
        held = [(r.token, (r.doc_id is not None, r.doc_id or 0)) for r in spark.read.parquet(str(f)).collect()]
        assert held == sorted(held)


def test_a_corpus_is_read_once_for_its_postings(spark, tmp_path):
    """Once for the catalog and once for the postings: no sample is taken for the order of the rows."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def note(batches):
        (seen / uuid.uuid4().hex).touch()
        yield from batches

    corpus = spark.createDataFrame([(i, f"n{i}", "x y") for i in range(20)], "doc_id long, name string, text string").coalesce(1)
    Store(spark, str(tmp_path / "i")).add(corpus.mapInArrow(note, corpus.schema))
    assert len(list(seen.iterdir())) == 2


def test_compaction_adds_up_term_tables(spark, tmp_path, monkeypatch):
    """Postings aren't counted again, and neither sampled nor shuffled one by one."""
    store = Store(spark, str(tmp_path / "i"), 2)
    for part in (DOCS[:4], DOCS[4:]):
        store.add(spark.createDataFrame(part, "doc_id long, text string").selectExpr("doc_id", "concat('n', doc_id) AS name", "text"))
    held, counts = _pairs(store.postings()), sorted(map(tuple, store.terms().collect()))

    def counted(_):
        raise AssertionError("postings were counted again")

    monkeypatch.setattr(ix, "terms", counted)
    store.compact()
    assert len(store.segments()) == 1
    assert _pairs(store.postings()) == held and sorted(map(tuple, store.terms().collect())) == counts
