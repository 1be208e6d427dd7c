"""Plan guards for every batch query: no cartesian product or broadcast
nested-loop join, and only hash aggregations (fixed-width buffers)."""

import pytest

from blockyard.plans.catalog import REGISTRY
from blockyard.plans.plan_report import STREAMS, summarise
from paths import SF_SMALL

BATCH = sorted(n for n in REGISTRY if n not in STREAMS)


@pytest.mark.parametrize("name", BATCH)
def test_plan_shape(spark, name):
    counts, _ = summarise(REGISTRY[name][0](spark, SF_SMALL))
    assert counts["CartesianProduct"] == 0 and counts["BroadcastNestedLoopJoin"] == 0
    assert counts["SortAggregate"] == 0
