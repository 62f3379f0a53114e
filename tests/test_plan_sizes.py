"""The driver holds a query's whole plan and plans it anew after every shuffle: no step may be one plan of hundreds of nodes."""

import __spark_entry__  # noqa: F401  (loads the queries in their order)
from paymatch.operators import candidates, chain, matching, similar
from paymatch.plans import queries_checks, runtime
from paymatch.sources import fixtures

BASE = "/root/testdata/sf0.001"
MOST_NODES = 130


def test_no_step_up_to_the_validation_context_is_one_large_plan(spark, monkeypatch):
    sizes = []

    def stage(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().treeString().count("\n"))
        return runtime.stage(df)

    for module in (candidates, chain, fixtures, matching, similar):
        monkeypatch.setattr(module, "stage", stage, raising=False)
    runtime.broadcast_by_measured_size(spark)
    fx = fixtures.Fixtures(spark, BASE)
    sizes.append(queries_checks.build_context(fx)._jdf.queryExecution().optimizedPlan().treeString().count("\n"))
    assert max(sizes) <= MOST_NODES, sizes
