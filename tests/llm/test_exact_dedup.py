from quillon.llm.common import scratch_path
from quillon.llm.exact_dedup import DigestIndex, deduplicate

SCHEMA = "doc_id long, text string"


def _ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_unnamed_batches_that_overlap(spark):
    index = DigestIndex(spark, scratch_path(spark, "index"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], SCHEMA)
    second = spark.createDataFrame([(5, "b"), (6, "c"), (7, "c"), (8, None), (9, "a")], SCHEMA)
    assert _ids(deduplicate(first, index)) == [1, 2, 4]
    assert _ids(deduplicate(second, index)) == [6, 8]


def test_named_batch_run_again(spark):
    index = DigestIndex(spark, scratch_path(spark, "index"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    second = spark.createDataFrame([(3, "b"), (4, "c")], SCHEMA)
    assert _ids(deduplicate(first, index, "x")) == [1, 2]
    assert _ids(deduplicate(second, index, "y")) == [4]
    assert _ids(deduplicate(second, index, "y")) == [4]
    assert _ids(deduplicate(first, index, "x")) == [1, 2]
