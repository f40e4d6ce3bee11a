"""Randomised checks of the exact evaluation operators against brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callrank.operators import evaluate

rows = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40)
SET = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _brute_auc(data):
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@SET
@given(rows)
def test_auc_equals_pair_count(spark, data):
    df = spark.createDataFrame([(float(y), float(s)) for y, s in data], "label double, score double")
    got = evaluate.roc_auc(df, buckets=3).first()["auc"]
    exp = _brute_auc(data)
    assert (got is None and exp is None) or abs(got - exp) < 1e-12


@SET
@given(rows)
def test_threshold_grid_equals_direct_counts(spark, data):
    df = spark.createDataFrame([(y, s / 6.0) for y, s in data], "label int, score double")
    ts = [0.25, 0.5, 0.75]
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.threshold_grid(df, thresholds=ts).collect()}
    for t in ts:
        tp = sum(1 for y, s in data if y == 1 and s / 6.0 >= t)
        fp = sum(1 for y, s in data if y == 0 and s / 6.0 >= t)
        fn = sum(1 for y, s in data if y == 1 and s / 6.0 < t)
        tn = sum(1 for y, s in data if y == 0 and s / 6.0 < t)
        assert got[t] == (tp, fp, fn, tn)
