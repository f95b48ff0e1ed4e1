"""Metrics against brute force over all rows."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.operators import bootstrap as BS, fairness as FA, metrics as M


def brute(y, s, w=None):
    y, s = np.asarray(y), np.asarray(s)
    w = np.ones(len(y)) if w is None else w
    P, N = (y == 1).sum(), (y == 0).sum()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    ap, last = 0.0, 0.0
    pts = [(0.0, 0.0, np.inf)]
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        wfp = w[sel & (y == 0)].sum()
        ap += (tp / P - last) * tp / (tp + wfp)
        last = tp / P
        pts.append((fp / N, tp / P, t))
    return auc, ap, pts


def table(spark, y, s):
    return spark.createDataFrame([("v", int(a), float(b), 10.0 * (i + 1)) for i, (a, b) in enumerate(zip(y, s))], "variant string, y int, score double, amount double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=4, max_size=40), st.sampled_from([1.0, 0.02]))
def test_ranking_metrics(spark, rows, rate):
    y, s = [r[0] for r in rows] + [0, 1], [r[1] / 8 for r in rows] + [0.3, 0.6]
    w = np.where(np.array(y) == 0, 1 / rate, 1.0)
    auc, ap, pts = brute(y, s, w)
    c = M.roc_curve(table(spark, y, s), ["variant"], neg_rate=rate)
    r = M.threshold_free(c, ["variant"]).first()
    assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)
    assert r["ks"] == pytest.approx(max(t - f for f, t, _ in pts)) and r["gini"] == pytest.approx(2 * auc - 1)
    xs = np.linspace(0, 0.01, 2001)
    area = np.trapezoid(np.interp(xs, [p[0] for p in pts], [p[1] for p in pts]), xs) if len({p[0] for p in pts}) == len(pts) else None
    if area is not None:
        assert r["pauc_1pct"] == pytest.approx(0.5 * (1 + (area - 0.00005) / (0.01 - 0.00005)), abs=1e-6)
    for o in M.operating_points(c, ["variant"]).collect():
        f, t, thr = [p for p in pts if p[0] <= o["target"]][-1]
        assert o["recall"] == pytest.approx(t) and o["step_up_rate"] == pytest.approx(f)
        assert o["threshold"] == (None if thr == np.inf else thr)
        assert o["tp"] + o["fn"] == sum(y) and o["fp"] + o["tn"] == pytest.approx(round((len(y) - sum(y)) / rate), abs=1)


def test_corners_keep_the_areas(spark):
    r = np.random.default_rng(1)
    y = (r.random(300) < 0.3).astype(int)
    s = np.round(r.random(300) * 0.6 + y * 0.2, 2)
    df = table(spark, y, s)
    full, corner = (M.roc_curve(df, ["variant"], drop_collinear=d) for d in (False, True))
    a, b = M.threshold_free(full, ["variant"]).first(), M.threshold_free(corner, ["variant"]).first()
    assert corner.count() < full.count()
    for m in ("roc_auc", "ks", "pauc_1pct"):
        assert a[m] == pytest.approx(b[m])


def test_cost_points(spark):
    y, s = [1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5]
    c = M.roc_curve(table(spark, y, s), ["variant"], amount="amount")
    r = M.cost_amount(c, ["variant"], cost_fp=17.0).first()
    # flag the top three: no missed amount, one false positive
    assert (r["threshold"], r["min_cost"], r["recall"], r["amount_recovered"]) == (0.7, 17.0, 1.0, 40.0)
    r = M.cost_amount(c, ["variant"], cost_fp=1000.0, allow_none=True).first()
    assert r["threshold"] == 0.9 and r["min_cost"] == 30.0
    worst = M.roc_curve(table(spark, [0, 1], [0.9, 0.1]), ["variant"], amount="amount")
    assert M.cost_amount(worst, ["variant"], cost_fp=1000.0, allow_none=True).first()["threshold"] is None
    k = {x["ratio"]: x["threshold"] for x in M.cost_ratio(c, ["variant"], (1, 10)).collect()}
    assert k == {1: 0.9, 10: 0.7}


def test_calibration_bins(spark):
    df = table(spark, [0, 1, 1, 0], [0.3, 0.30000000000000004, 1.0, -0.5])
    assert sorted(r["bin"] for r in M.calibration(df, ["variant"]).collect()) == [0, 2, 3, 9]
    s = M.calibration_summary(M.calibration(df, ["variant"]), ["variant"]).first()
    assert s["brier"] == pytest.approx((0.09 + 0.49 + 0 + 0) / 4) and 0 <= s["ece"] <= 1


def test_eer_takes_the_first_minimum(spark):
    df = table(spark, [1, 1, 0, 0], [0.9, 0.6, 0.7, 0.1])
    r = M.per_user_eer(M.roc_curve(df, ["variant"]), "variant").first()
    assert r["eer"] == pytest.approx(0.5) and r["roc_auc"] == pytest.approx(0.75)
    perfect = M.per_user_eer(M.roc_curve(table(spark, [1, 0], [0.9, 0.1]), ["variant"]), "variant").first()
    assert perfect["eer"] == 0.0


def test_bootstrap_brackets_the_estimate_in_any_slicing(spark):
    r = np.random.default_rng(2)
    y = (r.random(4000) < 0.2).astype(int)
    s = np.round(r.normal(0, 1, 4000) + y, 2)
    df = table(spark, y, s)
    point = M.threshold_free(M.roc_curve(df, ["variant"]), ["variant"]).first()
    a = {x["metric"]: x for x in BS.bootstrap_ci(df, reps=120).collect()}
    b = {x["metric"]: x for x in BS.bootstrap_ci(df.repartition(7), reps=120, slice_rows=60).collect()}
    for m in ("roc_auc", "pr_auc"):
        assert a[m]["ci_low"] < point[m] < a[m]["ci_high"] and abs(a[m]["mean"] - point[m]) < 0.01
    for m in BS.METRICS:
        assert a[m]["mean"] == pytest.approx(b[m]["mean"]) and a[m]["ci_low"] == pytest.approx(b[m]["ci_low"])


def test_poisson_weights_are_repeatable_and_have_the_right_moments():
    cells = np.arange(3000) * 7919
    for lam in (1.0, 12.0, 400.0):
        w = BS.poisson(cells, np.full(3000, lam), 20, 5, 1)
        assert abs(w.mean() / lam - 1) < 0.02 and abs(w.var() / lam - 1) < 0.06
        assert (w == BS.poisson(cells, np.full(3000, lam), 20, 5, 1)).all()
    assert (BS.poisson(cells, np.ones(3000), 20, 6, 1) != BS.poisson(cells, np.ones(3000), 20, 5, 1)).any()


def test_paired_bootstrap_sees_a_real_gain(spark):
    r = np.random.default_rng(3)
    y = (r.random(3000) < 0.3).astype(int)
    base = r.normal(0, 1, 3000)
    rows = [(int(a), float(round(b, 2)), float(round(b + 1.2 * a, 2))) for a, b in zip(y, base)]
    df = spark.createDataFrame(rows, "y int, old double, new double")
    d = {x["metric"]: x for x in BS.paired_bootstrap(df, "old", "new", reps=100).collect()}
    assert d["pr_auc"]["ci_low"] > 0
    same = {x["metric"]: x for x in BS.paired_bootstrap(df.withColumn("copy", F.col("old")), "old", "copy", reps=50).collect()}
    assert same["roc_auc"]["std"] == pytest.approx(0, abs=1e-12)


def test_gate_and_fairness(spark):
    exp = spark.createDataFrame([("a", 0.5, 0.01), ("b", 0.5, 0.01), ("c", 0.5, 0.01)], "metric string, expected double, tolerance double")
    got = spark.createDataFrame([("a", 0.505), ("b", 0.52)], "metric string, value double")
    assert {r["metric"]: r["passed"] for r in M.drift_gate(got, exp).collect()} == {"a": 1, "b": 0, "c": 0}
    caught = spark.createDataFrame([(19, 4), (None, 4), (4, 19), (19, None)], "o int, n int").select(M.earlier_catch(F.col("o"), F.col("n")))
    assert [r[0] for r in caught.collect()] == [1, 1, 0, 0]
    rates = spark.createDataFrame([("x", 0.5), ("y", 0.3)], "cohort string, rate double")
    r = FA.disparate_impact(rates).first()
    assert r["impact_ratio"] == pytest.approx(0.6) and r["passes"] == 0
    b = spark.createDataFrame([(True,), (True,), (False,)], "selected boolean")
    f = FA.friction_change(b, b.filter("selected = false")).first()
    assert f["rate_before"] == pytest.approx(2 / 3) and f["rate_after"] == 0 and f["relative_reduction_pct"] == pytest.approx(100)


def test_missing_scores_rank_last_in_any_slicing(spark):
    scores = [0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.4, 0.4, 0.3, 0.2, 0.1, 0.05, float("nan"), None, None]
    y = [1, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1, 1, 0]
    df = spark.createDataFrame([("m", a, b) for a, b in zip(y, scores)], "variant string, y int, score double")
    plain, sliced = M.roc_curve(df, ["variant"]), M.roc_curve(df, ["variant"], hot_rows=3)
    rows = lambda c: sorted(map(tuple, c.select("threshold", "tp", "fp", "pos", "neg", "n_pos", "n_neg").collect()))
    assert rows(plain) == rows(sliced) and len(rows(plain)) == 11
    assert rows(plain)[0] == (float("-inf"), 7, 8, 2, 1, 7, 8)
    a, b = (M.threshold_free(c, ["variant"]).first() for c in (plain, sliced))
    assert a == b
    boots = [{r["metric"]: r["mean"] for r in BS.bootstrap_ci(df, reps=40, slice_rows=n).collect()} for n in (3, 1000)]
    assert boots[0] == pytest.approx(boots[1])


def test_parity_cost_without_a_safe_cohort(spark):
    from wardline.operators import fairness as FA

    df = spark.createDataFrame([("hot", 0.9, 1), ("hot", 0.2, 0)], "cohort string, score double, y int")
    r = FA.parity_cost(df, "cohort", "safe", "hot", 0.5).first()
    assert r["safe_rate"] is None and r["recall_parity"] is None and r["recall_global"] == 1.0
