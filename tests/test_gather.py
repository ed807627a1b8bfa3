"""Cutting texts into words a column at a time, against the rule one text at a time."""

import random
import re

import pyarrow as pa
import pytest

from quillon.operators import chunks as ch

LETTERS = "aAbZ09 \t\n_-éKİ\x00ſ 😀"


def _odd_rows(n):
    rnd = random.Random(1)
    text = lambda: "".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(60)))
    return [(rnd.choice([None, -5, 3, rnd.randrange(1 << 22)]), rnd.choice([None, "", text()])) for _ in range(n)]


def _record_batches(rows, text=None, size=700):
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], text or pa.string())})
    return iter(table.to_batches(max_chunksize=size))


def _postings(batches):
    return sorted(((r["token"], r["slice"], i) for b in batches for r in b.to_pylist() for i in r["ids"]), key=repr)


@pytest.mark.parametrize("text", [pa.string(), pa.large_string()])
@pytest.mark.parametrize(("gathered", "text_bytes"), [(1, 1), (50, 40), (4_000_000, 300), (4_000_000, 8 << 20)])
def test_columns_of_odd_texts(monkeypatch, text, gathered, text_bytes):
    monkeypatch.setattr(ch, "GATHERED", gathered)
    monkeypatch.setattr(ch, "TEXT_BYTES", text_bytes)
    rows = _odd_rows(3000)
    words = [(w, None if i is None else i >> ch.SLICE_BITS, i) for i, t in rows for w in sorted({w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")})]
    assert _postings(ch._gather(_record_batches(rows, text))) == sorted(words, key=repr)


def test_a_slice_of_a_batch():
    batch = next(_record_batches([(i, t) for i, t in enumerate(["zero", None, "one two", "", "three"])]))
    assert _postings(ch._gather(iter([batch.slice(1, 3)]))) == [("one", 0, 2), ("two", 0, 2)]
    assert list(ch._gather(iter([]))) == [] and list(ch._gather(iter([batch.slice(1, 1), batch.slice(0, 0)]))) == []


def test_more_words_and_slices_than_16_bits_tell():
    rows = [(i << ch.SLICE_BITS, f"w{i} common") for i in range(70_000)]
    chunks = [r for b in ch._gather(_record_batches(rows, size=10_000)) for r in b.to_pylist()]
    assert len(chunks) == 140_000 and all(r["ids"] == [r["slice"] << ch.SLICE_BITS] for r in chunks)
    assert {r["token"] for r in chunks if r["slice"] == 69_999} == {"w69999", "common"}


def test_texts_are_cut_by_columns(monkeypatch):
    """Texts aren't handed to Python one by one."""
    calls = []
    cut = ch._words
    monkeypatch.setattr(ch, "_words", lambda texts: calls.append(len(texts)) or cut(texts))
    assert len(_postings(ch._gather(_record_batches([(i, "x y") for i in range(2000)], size=1000)))) == 4000
    assert calls == [1000, 1000]
