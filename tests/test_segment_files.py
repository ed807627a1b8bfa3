"""How many files a segment gets."""

from pathlib import Path

import pytest

from quillon.sources import store as st
from quillon.sources.store import Store

WORDS = " ".join(f"w{i}" for i in range(800))


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("texts", "files"), [(5, 2), (6, 3), (1000, 40)])
def test_few_texts_make_few_files(spark, tmp_path, monkeypatch, many_partitions, texts, files):
    """A task for each two texts here, a task for each bucket at least, and as many as before for a large corpus."""
    monkeypatch.setattr(st, "TASK_TEXTS", 2)
    store = Store(spark, str(tmp_path / "i"), 1 if files == 3 else 2)
    store.add(spark.createDataFrame([(i << 20, f"n{i}", WORDS if i < 6 else "w0") for i in range(texts)], "doc_id long, name string, text string"))
    assert len(list(Path(tmp_path / "i").rglob("postings/*/*.parquet"))) == files
    assert store.postings().count() == 800 * min(texts, 6) + max(0, texts - 6)
