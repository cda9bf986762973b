"""What no plan may have: pairs without a key, and Python called for single rows."""

from __future__ import annotations

import re

import pytest

from tessera.plans import catalogue
from tessera.storage import load


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cross_join_and_no_row_udf(spark, data, name):
    p = plan(catalogue.QUERIES[name](spark, data))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|RDDScan", p), p


def test_filters_and_columns_reach_the_scan(spark, data):
    p = plan(load(spark, data, "edge_feed").filter("valid_to is null and edge_type = 'PART_OF'").select("from_node_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", p).group(1)
    assert all(f in pushed for f in ("IsNull(valid_to)", "IsNotNull(edge_type)", "EqualTo(edge_type,PART_OF)"))
    assert "ReadSchema: struct<edge_type:string,from_node_id:string,valid_to:timestamp>" in p
