import pytest

from quillon.llm.queries import ORACLES, QUERIES
from oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op7_ann", "op9_near_dedup"])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_gives_rows(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
