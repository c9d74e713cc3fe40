"""Camera models are worked out once, whatever reads their fields."""

from gridloom.plans.catalog import QUERIES


def test_fields_are_read_from_models_that_are_there(spark):
    text = QUERIES["rpc_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in text and "Aggregate" not in text
