"""Plan-shape checks: no cartesian products, no Python evaluation in the
sampling/rebalancing paths, filters and column pruning reach the scan."""

import re

from shiftlab.operators import rebalance as rb
from shiftlab.operators import split as sp
from shiftlab.operators.sampling import draw_with_replacement, sample_exact
from shiftlab.sources.tables import TABLE_KEYS, load_table
from tests.conftest import SF01

LI_KEY = TABLE_KEYS["lineitem"]
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sampling_plans_have_no_cartesian_or_python(spark):
    li = load_table(spark, SF01, "lineitem")
    plans = [
        sample_exact(li, 1000, ["l_returnflag"], LI_KEY),
        draw_with_replacement(li, 1000, ["l_returnflag"], LI_KEY),
        rb.rebalance_target(li, "l_returnflag", 0.5, LI_KEY),
        rb.rebalance_target(li, "l_returnflag", -0.5, LI_KEY),
        sp.train_test_split(li, "l_returnflag", LI_KEY),
    ]
    for df in plans:
        p = _plan(df)
        for bad in BAD:
            assert bad not in p, bad


def _wide_shuffles(df) -> list[str]:
    """The exchanges that are not below a broadcast, so that rows of the table itself pass through."""
    found, above = [], []
    for line in _plan(df).splitlines():
        depth = len(re.match(r"[ :|+-]*", line).group())
        above = [d for d in above if d < depth]
        if "BroadcastExchange" in line:
            above.append(depth)
        elif re.search("Exchange (hashpartitioning|SinglePartition)", line) and not above:
            found.append(line)
    return found


def test_sample_shuffles_only_boundary_rows(spark):
    """Only the window over the boundary buckets moves wide rows, also without automatic broadcasts."""
    li = load_table(spark, SF01, "lineitem")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (sample_exact(li, 1000, ["l_returnflag"], LI_KEY), sample_exact(li, 1000, [], LI_KEY),
                    rb.rebalance_target(li, "l_returnflag", -0.5, LI_KEY)):
            assert "SortMergeJoin" not in _plan(out).split("BroadcastExchange")[0]
            assert len(_wide_shuffles(out)) == 1, _wide_shuffles(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_projection_and_filter_reach_scan(spark):
    li = load_table(spark, SF01, "lineitem")
    out = rb.rebalance_target(li.select(*LI_KEY, "l_returnflag"), "l_returnflag", -0.5, LI_KEY)
    p = _plan(out)
    assert "IsNotNull(l_returnflag)" in p
    assert "l_extendedprice" not in p
