"""Physical plans: shuffles, pushdown, pruning, no nested-loop joins."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from barloom.functions import rolling as W
from barloom.plans import views as V

SF = "/root/testdata/sf0.001"
Q = entry_points.queries()


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_key_windows_share_one_exchange(spark):
    b = V.bars(spark, SF).select("symbol", "date", "close")
    d = b.withColumns({f"m{n}": W.sma("close", n) for n in (20, 60, 200)})
    d = d.withColumn("r", W.pct_change("m20")).withColumn("z", W.zscore("r", 20))
    assert len(re.findall(r"Exchange hashpartitioning", plan(d))) == 2  # roll-up, windows


def test_date_range_reaches_the_scan(spark):
    p = plan(Q["pr_1_date_range"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p
    assert "o_custkey" not in p  # pruned


def test_no_nested_loop_joins(spark):
    for name in ("jn_3_backward_asof", "al_3_asof_ffill", "opt_2_max_pain", "jn_10_pair_rows", "an_3_analog_outcomes",
                 "fr_3_event_proximity", "rk_3_portfolio_vol_dd"):
        p = plan(Q[name](spark, SF))
        assert "NestedLoop" not in p and "CartesianProduct" not in p, name


def test_asof_join_shuffles_its_input_once(spark):
    assert "ReusedExchange" in plan(Q["jn_3_backward_asof"](spark, SF), final=True)


def test_first_per_key_limits_before_the_shuffle(spark):
    p = plan(Q["se_2_dedupe_keep_first"](spark, SF))
    assert p.index("Exchange") < p.rindex("WindowGroupLimit")  # the inner (partial) limit lies below the exchange


def test_counts_are_combined_before_the_shuffle(spark):
    p = plan(Q["tx_5_topic_hits_daily"](spark, SF))
    assert p.count("partial_sum") > 0 and p.count("Exchange hashpartitioning") == 1


def test_rule_tables_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(Q["jn_9_broadcast_dimension"](spark, SF))


def test_chain_is_summed_per_part_before_the_join(spark):
    p = plan(V.options(spark, SF).agg(F.sum("oi")))
    assert p.rindex("partial_sum(l_quantity") > p.index("Join")
