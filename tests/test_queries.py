import pytest

from quillon.plans.queries import ORACLES, QUERIES
from oracle import SF, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


def test_order_of_names(spark):
    ids = [r.doc_id for r in QUERIES["search_names"](spark, SF).collect()]
    assert ids and ids == sorted(ids)


def test_plan_has_no_python(spark):
    plan = QUERIES["batch_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
