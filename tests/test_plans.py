"""Physical plan shapes: top-k, outlier filter, no Python in the plans, pruning."""

import pytest

from conftest import SF_CHECK, SF_SMALL
from txnlens.plans.catalog import QUERIES


def plan(df):
    # a fresh Dataset: a frame that already ran shows its final and initial
    # adaptive plans together, which would count every operator twice
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", ["busiest_hours", "top_states", "top_spenders", "most_active_customers"])
def test_topk_is_take_ordered(spark, key):
    assert "TakeOrderedAndProject" in plan(QUERIES[key](spark, SF_SMALL))


def test_outlier_filter_has_no_join(spark):
    df = QUERIES["amount_low_outliers"](spark, SF_SMALL)
    text = optimized(df)
    assert "scalar-subquery" in text.lower() or "ScalarSubquery" in text
    assert "Join Cross" not in text and "CartesianProduct" not in plan(df)
    df.collect()
    assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                   "CartesianProduct"):
        assert marker not in p, (key, marker)


def test_scan_reads_only_needed_columns(spark):
    p = plan(QUERIES["txn_by_channel"](spark, SF_SMALL))
    assert "struct<event_id:bigint,value:double>" in p
    assert "props" not in p


def test_channel_report_shuffles_only_partial_sums(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(QUERIES["txn_by_channel"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in p
    below = p[p.index("partial_count"):]
    assert "hashpartitioning" not in below and "rangepartitioning" not in below


def scans(df, table):
    """Scans of a table in the plan that ran, subqueries included; what is reused counts once."""
    df.collect()
    found, todo, seen = set(), [df._jdf.queryExecution().executedPlan()], 0
    while todo and seen < 5000:
        node, seen = todo.pop(), seen + 1
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind in ("ReusedExchangeExec", "ReusedSubqueryExec"):
            todo.append(node.child())
        elif kind == "FileSourceScanExec" and f"{table}.parquet" in node.toString():
            found.add(node.id())
        for of in (node.children(), node.subqueries()):
            todo += [of.apply(i) for i in range(of.size())]
    return len(found)


ONE_SCAN = ["geography", "error_rate_by_type", "refund_customers", "customer_risk", "risk_band_counts", "customer_tiers", "tier_summary", "txn_by_channel"]
TWO_SCANS = ["amount_quantiles", "iqr_bounds"]


@pytest.mark.parametrize("key", [*ONE_SCAN, *TWO_SCANS, "amount_low_outliers", "amount_high_outliers"])
def test_scans_of_events(spark, key):
    folder = SF_CHECK if key == "refund_customers" else SF_SMALL  # where it has rows; an empty result's plan is cut down
    assert scans(QUERIES[key](spark, folder), "events") == (1 if key in ONE_SCAN else 2 if key in TWO_SCANS else 3)


@pytest.mark.parametrize("key", ["heavy_spenders", "heavy_cities"])
def test_bounded_top_k_reads_three_times(spark, key):
    assert scans(QUERIES[key](spark, SF_SMALL), "events") == 3


@pytest.mark.parametrize("key", ["describe_users", "describe_credit_score", "income_quantiles"])
def test_scans_of_customers(spark, key):
    assert scans(QUERIES[key](spark, SF_SMALL), "customer") == 2


def test_user_scan_pruned(spark):
    p = plan(QUERIES["gender_counts"](spark, SF_SMALL))
    assert "c_name" not in p and "c_mktsegment" not in p


def _single_partition_windows(plan_text):
    """Window operators whose input is gathered into a single partition."""
    lines = plan_text.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        for nxt in lines[i + 1:i + 4]:
            if "Exchange" in nxt:
                if "SinglePartition" in nxt:
                    found.append(line.strip()[:80])
                break
    return found


# Windows over one partition are only allowed where the rows are bounded by a
# domain (years, states, error types), by the cells of a quantile's brackets or by the partition count.
BOUNDED_SINGLE_PARTITION = {"revenue_growth", "geography", "error_rate_by_type", "customer_tiers", "tier_summary",
                            "revenue_growth_merged", "geography_merged",
                            # running sums over the cells of the brackets
                            "amount_quantiles", "income_quantiles", "iqr_bounds", "amount_low_outliers", "amount_high_outliers",
                            "income_low_outliers", "income_high_outliers", "describe_credit_score"}


def test_single_partition_windows_only_on_bounded_rows(spark):
    seen = {k for k, q in QUERIES.items() if _single_partition_windows(plan(q(spark, SF_SMALL)))}
    assert seen <= BOUNDED_SINGLE_PARTITION, seen - BOUNDED_SINGLE_PARTITION
    assert "revenue_growth" in seen  # the detector works


def test_amount_is_parsed_once_per_row(spark):
    from txnlens.schemas import NUM_PATTERN
    # every report: at most one parse site, except where a scalar subquery
    # re-plans the same aggregate (its shuffle is reused at run time), and the
    # quantiles, which read the column in two passes, and outliers in a third; the passes
    # of the tiers share the exchange of the customers' totals (test_scans_of_events);
    # the merged reports read three batches; the bounded top-k reports read the table three times
    over = {k for k, q in QUERIES.items() if plan(q(spark, SF_SMALL)).count(NUM_PATTERN) > 1}
    assert over <= {"heavy_spenders", "heavy_customers", "heavy_states", "heavy_cities", "refund_customers", "customer_tiers", "tier_summary", "revenue_growth_merged", "geography_merged", "amount_quantiles", "iqr_bounds", "amount_low_outliers", "amount_high_outliers"}, over


@pytest.mark.parametrize("key", ["amount_quantiles", "iqr_bounds", "describe_users", "income_high_outliers", "customer_tiers", "tier_summary"])
def test_quantiles_run_no_job_while_the_plan_is_built(spark, key):
    group = f"build-{key}"
    spark.sparkContext.setJobGroup(group, key)
    QUERIES[key](spark, SF_SMALL)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
