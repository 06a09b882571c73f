"""Plans over the order hierarchy read its tables and don't hold its plan once for each read: drivers have little memory."""

from __future__ import annotations

import pytest

from stemma import catalog
from stemma.plans.corpus import trade_corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_and_features_are_read_from_tables(spark):
    c = trade_corpus(spark, SF)
    for df, joins in ((c.nodes, 0), (c.slots, 0), (c.of_type("customer"), 0), (c.feature("name"), 2)):
        assert "InMemoryRelation" not in plan(df) and plan(df).count("Join ") <= joins


@pytest.mark.parametrize("name", ["passages_by_reference", "reference_resolve"])
def test_references_have_small_plans(spark, name, same_as_sql):
    made = []
    same_as_sql(lambda *a: made.append(catalog.QUERIES[name](*a)) or made[0], catalog.ORACLE[name])
    assert "InMemoryRelation" not in plan(made[0]) and plan(made[0]).count("Join ") <= 4 and len(plan(made[0])) < 20_000
