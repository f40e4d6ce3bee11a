"""Plan checks: no Python UDF, pruned scans, no single-partition exchange
over row data in the scalable evaluation and ranking paths."""

import pytest

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ANALYTIC = ["a2_conversion_by_segment", "a10_segment_lift", "a12_conversion_report", "q8_quality_report",
            "h1_roc_auc", "h6_roc_curve", "e6_stratified_split", "e8_smote_samples", "t5_gains_table",
            "k2_domain_violations", "e11_prepared_set"]


@pytest.mark.parametrize("name", ANALYTIC)
def test_no_python_udf(spark, name):
    from __spark_entry__ import queries
    p = _plan(queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_scan_reads_only_needed_columns(spark):
    from __spark_entry__ import queries
    df = queries()["a2_conversion_by_segment"](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in p and "o_custkey" not in p


def test_score_table_has_no_single_partition_row_exchange(spark):
    """Row-level running sums are windows partitioned by score bucket; the
    only global window (over bucket totals) is computed beforehand and
    checkpointed, so the row plan has no single-partition exchange."""
    from pyspark.sql import functions as F

    from callrank.operators import evaluate
    df = spark.range(0, 20000).select((F.col("id") % 2).alias("label"),
                                      (F.col("id") * 37 % 5003).cast("double").alias("score"))
    p = _plan(evaluate.score_table(df))
    assert "SinglePartition" not in p
    assert "windowspecdefinition(_b" in p and "hashpartitioning(_b" in p


def test_split_plan_has_no_range_sort_of_all_rows(spark):
    from callrank.operators import split
    from callrank.plans import fixtures as fx
    o = fx.ord_frame(spark, SF_SMALL, "o_orderkey").select("o_orderkey", "label")
    p = _plan(split.stratified_split(o, "label", ["o_orderkey"]))
    assert "rangepartitioning" not in p


def test_split_compares_hashes_without_moving_rows(spark):
    """One scan of the rows, joined with the classes' cutoffs: no exchange,
    union or window over rows."""
    from callrank.operators import split
    from callrank.plans import fixtures as fx
    o = fx.ord_frame(spark, SF_SMALL, "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice", "label")
    p = _plan(split.stratified_split(o, "label", ["o_orderkey"]))
    assert "hashpartitioning" not in p and "Union" not in p and "Window" not in p
    assert p.count("Scan parquet") == 2 and "BroadcastHashJoin" in p


def test_fold_ranks_shuffle_rows_once(spark):
    """One exchange of rows, by class and prefix; the offsets are broadcast."""
    from callrank.operators import split
    from callrank.plans import fixtures as fx
    o = fx.ord_frame(spark, SF_SMALL, "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice", "label")
    p = _plan(split.stratified_folds(o, "label", ["o_orderkey"]))
    assert p.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in p and "rangepartitioning" not in p
