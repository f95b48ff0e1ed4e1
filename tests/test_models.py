"""Detectors: invariants on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.models import iforest as IF, keystroke as KS, scale as SC, supervised as SV
from wardline.operators import metrics as M


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(r.normal(0, 1, (1500, 2)))]
    rows += [(2000 + i, float(a), float(b), 1) for i, (a, b) in enumerate(r.normal(0, 1, (30, 2)) * 0.5 + [7, -7])]
    return spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


def test_forest_ranks_outliers_first_and_repeats(spark, blobs):
    nodes = IF.iforest_fit(blobs, ["a", "b"], "id", trees=60, size=128)
    s = IF.iforest_score(blobs, nodes, ["a", "b"], 128)
    auc = M.threshold_free(M.roc_curve(s.select(F.lit("v").alias("variant"), "y", "score"), ["variant"]), ["variant"]).first()["roc_auc"]
    assert auc > 0.98
    lo, hi = s.agg(F.min("score"), F.max("score")).first()
    assert 0 < lo < hi < 1
    again = IF.iforest_fit(blobs.repartition(5), ["a", "b"], "id", trees=60, size=128)
    assert nodes.exceptAll(again).count() == 0
    per = IF.tree_samples(blobs, ["a", "b"], "id", 60, 128, 42).groupBy("tree").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert per[1] == 128 and per[0] > 90 and per[2] == 60
    big = IF.tree_samples(blobs, ["a", "b"], "id", 2, 16, 42)  # one tree per drawn row
    assert big.count() == big.select("id").distinct().count()
    risk = IF.serving_risk(s, contamination=0.02).agg(F.avg(F.when(F.col("y") == 1, F.col("ml_risk"))), F.avg(F.when(F.col("y") == 0, F.col("ml_risk")))).first()
    assert risk[0] > risk[1]


def test_forest_cuts_between_neighbouring_numbers(spark):
    lo = 1.0
    hi = float(np.nextafter(lo, 2))
    rng = np.random.default_rng(0)
    assert {IF.draw_cut(rng, lo, hi) for _ in range(200)} == {lo}
    df = spark.createDataFrame([(i, hi if i % 2 else lo, 0.0) for i in range(64)], "row_id long, x double, z double")
    nodes = IF.iforest_fit(df, ["x", "z"], "row_id", trees=40, size=16)
    got = {r["row_id"]: r["score"] for r in IF.iforest_score(df, nodes, ["x", "z"], size=16).collect()}
    assert len(got) == 64 and all(0 < v < 1 for v in got.values())


def test_mean_path_matches_the_formula():
    assert IF.mean_path(1) == 0 and IF.mean_path(2) == 1 and IF.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_scale_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    r = SC.standard_scale(df, ["a", "c"]).orderBy("a").collect()
    assert [(x["a_z"], x["c_z"]) for x in r] == [(-1.0, 0.0), (1.0, 0.0)]


def test_keystroke_detectors_against_numpy(spark):
    r = np.random.default_rng(4)
    centre = {s: r.normal(0, 2, 5) for s in "abc"}
    rows, n = [], 0
    for s in "abc":
        for _ in range(40):
            rows.append((n, s, [float(x) for x in centre[s] + r.normal(0, 0.5, 5)]))
            n += 1
    df = spark.createDataFrame(rows, "id long, subject string, v array<double>")
    m = KS.scaled_manhattan(df, "subject", "id", "v", 5, enrol=20, impostor=3)
    assert m.filter("y = 0").count() == 60 and m.filter("y = 1").count() == 18
    x = {s: np.array([q[2] for q in rows if q[1] == s]) for s in "abc"}
    mu, mad = x["a"][:20].mean(0), np.abs(x["a"][:20] - x["a"][:20].mean(0)).mean(0)
    got = {(q["user"], q["id"]): q["score"] for q in m.collect()}
    assert got[("a", 25)] == pytest.approx((np.abs(x["a"][25] - mu) / mad).sum()) and got[("a", 41)] == pytest.approx((np.abs(x["b"][1] - mu) / mad).sum())
    inv = np.linalg.pinv(np.cov(x["a"][:20], rowvar=False) + 1e-3 * np.eye(5))
    h = {(q["user"], q["id"]): q["score"] for q in KS.mahalanobis(df, "subject", "id", "v", 5, enrol=20, impostor=3).collect()}
    d = x["a"][25] - mu
    assert h[("a", 25)] == pytest.approx(d @ inv @ d, rel=1e-6)
    eer = M.eer_summary(M.per_user_eer(M.roc_curve(m, ["user"], drop_collinear=True), "user")).first()
    assert eer["users"] == 3 and eer["mean_eer"] < 0.2


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(6)
    rows = []
    for i in range(1200):
        y = int(r.random() < 0.3)
        rows.append((i, f"u{i % 60}", y, float(r.normal(y * 2, 1)) if i % 9 else None, float(r.normal()), "xy"[int(r.random() < 0.3 + 0.4 * y)], float(y) + r.normal() * 0.01))
    return spark.createDataFrame(rows, "row_id long, user string, y int, a double, noise double, kind string, leak double").cache()


COLS = ["a", "noise", "kind"]


def test_gbt_arms_and_nulls(spark, labelled):
    train, test = SV.hash_split(labelled, "row_id", 0.7)
    out = SV.gbt_fit_score(train, test, {"full": COLS, "noise": ["noise"]}, "y", maxIter=5)
    full, noise = (SV.ranking(out, "y", f"score_{k}").first()["roc_auc"] for k in ("full", "noise"))
    assert out.count() == test.count() and full > 0.8 > noise


def test_selection_tools(spark, labelled):
    train, val = SV.hash_split(labelled, "row_id", 0.7)
    b = SV.bake_off(train, val, COLS, "y", {"gbt": {"params": {"maxIter": 3}}, "logistic": {"balance": True, "params": {"maxIter": 10}}})
    assert [r["rank"] for r in b.orderBy("rank").collect()] == [1, 2] and b.filter("roc_auc > 0.75").count() == 2
    s = SV.search(train, val, COLS, "y", {"maxDepth": [2, 3], "maxIter": [2]}, 2)
    assert s.count() == 2
    model = SV.fit(train, COLS, "y", maxIter=3)
    imp = {r["feature"]: r["importance"] for r in SV.permutation_importance(model, val, COLS, "y", "row_id", repeats=1).collect()}
    assert max(imp, key=imp.get) == "a"
    audit = {r["arm"]: r["roc_auc"] for r in SV.leakage_audit(train, val, COLS + ["leak"], "y", ["leak"], maxIter=2).collect()}
    assert "without_leak" in audit and audit["all"] > 0.99 > audit["without_suspects"]


def test_grouped_folds_and_calibration(spark, labelled):
    oof = SV.grouped_oof(labelled, COLS, "y", "user", k=3, maxIter=2)
    assert oof.count() == labelled.count() and oof.groupBy("user").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    best, apply, table = SV.calibrate(oof, "y", "score")
    brier = {r["method"]: r["brier"] for r in table.collect()}
    assert brier[best] == min(v for k, v in brier.items() if k != "none") and brier[best] <= brier["none"] + 1e-3
    assert apply(oof).filter("calibrated < -1e-9 or calibrated > 1.000000001").count() == 0


def test_fits_share_encoding_and_one_order(spark, labelled, monkeypatch):
    train, test = SV.hash_split(labelled, "row_id", 0.7)
    calls = []
    for name in ("encoders", "hash_ranks"):
        monkeypatch.setattr(SV, name, lambda *a, _f=getattr(SV, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    swept = {r["metric"]: r["mean"] for r in SV.seed_sweep(train, test, COLS, "y", [1, 2], maxIter=2).collect()}
    assert calls == ["encoders"]
    alone = [SV.ranking(SV.score(SV.fit(train, COLS, "y", "gbt", s, subsamplingRate=0.8, maxIter=2), test, COLS), "y").first() for s in (1, 2)]
    assert swept["pr_auc"] == pytest.approx(np.mean([r["pr_auc"] for r in alone]), abs=0.02)
    model = SV.fit(train, COLS, "y", maxIter=2)
    calls.clear()
    SV.permutation_importance(model, test, COLS, "y", "row_id", repeats=1).collect()
    assert calls.count("hash_ranks") == 1 + len(COLS)


def test_generator_draws_what_spark_draws(spark):
    from wardline.models import boost as B

    java = spark._jvm.org.apache.spark.util.random.XORShiftRandom
    for seed in (1, 42, -7, 2**40 + 3):
        one = java(seed)
        assert list(B.drawn(seed - 4, 3, 0, 60, 0.8)) == [one.nextDouble() < 0.8 for _ in range(60)]
        assert B.first_int(seed) == java(seed).nextInt()
        assert (B.drawn(seed, 2, 0, 5000, 0.5)[777:1777] == B.drawn(seed, 2, 777, 1000, 0.5)).all()


def test_thresholds_follow_the_sample():
    from wardline.models import boost as B

    assert list(B.thresholds(np.array([3.0, 1.0, 1.0]), 3.0, 255)) == [2.0]
    assert list(B.thresholds(np.array([0.0, 2.0]), 2.0, 255)) == [1.0] and not len(B.thresholds(np.zeros(4), 4.0, 255))
    many = np.arange(1.0, 6601.0)  # a sample larger than expected: MLlib cuts once more per stride
    assert len(B.thresholds(many, 6600.0, 255)) == 255 and len(B.thresholds(many, 6540.0, 255)) > 255


def boosted_like_mllib(labelled, arms, monkeypatch, block=None, **params):
    """Metrics of ``boost`` and of MLlib for the same arms, and the names of MLlib's estimators that ran."""
    from wardline.models import boost as B

    if block:
        monkeypatch.setattr(B, "BLOCK_ROWS", block)
    train, test = SV.hash_split(labelled, "row_id", 0.7)
    cols = sorted({c for num, text in (a[0] for a in arms) for c in num + text})
    train, test = SV.encoded(SV.materialize(train), test, cols, "y")
    ran, make = [], SV.estimator
    monkeypatch.setattr(SV, "estimator", lambda *a, **k: ran.append(a[0]) or make(*a, **k))
    got = {r["arm"]: r for r in SV.boost_rank(train, test, arms, "y", **params).collect()}
    used = list(ran)
    alone = [SV.fit_rank(train, test, types, "y", "gbt", seed, **params).first() for types, seed in arms]
    return [(got[i]["pr_auc"], got[i]["roc_auc"]) for i in range(len(arms))], [(r["pr_auc"], r["roc_auc"]) for r in alone], used


@pytest.mark.parametrize("params", [{"maxIter": 3, "subsamplingRate": 0.8}, {"maxIter": 2, "maxDepth": 6, "minInstancesPerNode": 4, "minInfoGain": 0.01, "stepSize": 0.3}])
def test_fits_grow_together_as_mllib_grows_them(spark, labelled, monkeypatch, params):
    wide = labelled.withColumn("zero", F.lit(0.0)).repartition(3, "row_id")
    arms = [((["a", "noise", "zero"], ["kind"]), 1), ((["a", "noise", "zero"], ["kind"]), 2), ((["noise"], []), 2), (([], ["kind"]), 2), ((["zero"], []), 2)]
    got, alone, ran = boosted_like_mllib(wide, arms, monkeypatch, **params)
    assert not ran  # before: one fit of MLlib after the other
    assert np.array(got) == pytest.approx(np.array(alone), abs=1e-3)


def test_many_blocks_and_a_sampled_table(spark, monkeypatch):
    from wardline.models import boost as B

    rows = spark.range(0, 100_000, 1, 3).withColumn("u", F.rand(3)).select(
        F.col("id").alias("row_id"), (F.rand(4) < 0.2 + 0.5 * F.pow("u", 3)).cast("int").alias("y"), F.when(F.col("id") % 7 > 0, F.col("u")).alias("a"),
        F.floor(F.rand(5) * 50).cast("double").alias("noise"), F.when(F.rand(6) < 0.5, "x").otherwise("z").alias("kind"))
    dealt = []
    make = B.dealt
    monkeypatch.setattr(B, "dealt", lambda *a: dealt.append(make(*a)) or dealt[-1])
    monkeypatch.setattr(B, "TASK_BLOCKS", 2)
    arms = [((["a", "noise"], ["kind"]), s) for s in (5, 6)]
    got, alone, ran = boosted_like_mllib(SV.materialize(rows), arms, monkeypatch, 4096, maxIter=3, subsamplingRate=0.8)
    assert not ran and np.array(got) == pytest.approx(np.array(alone), abs=1e-4)
    held = dealt[0].glom().map(len).collect()
    assert len(held) > 3 and max(held) <= 2 * min(held)


def test_what_boost_does_not_know_goes_to_mllib(spark, labelled, monkeypatch):
    arms = [((["a"], ["kind"]), 1), ((["noise"], []), 1)]
    got, alone, ran = boosted_like_mllib(labelled, arms, monkeypatch, maxIter=2, minWeightFractionPerNode=0.01)
    assert ran == ["gbt", "gbt"] and got == alone
    with pytest.raises(Exception, match="(?i)label"):
        SV.seed_sweep(labelled.withColumn("y", F.when(F.col("row_id") % 50 > 0, F.col("y"))), labelled, ["a"], "y", [1], maxIter=1)


def test_sweep_and_audit_grow_their_fits_in_one_go(spark, labelled, monkeypatch):
    train, test = SV.hash_split(labelled, "row_id", 0.7)
    ran, make = [], SV.estimator
    monkeypatch.setattr(SV, "estimator", lambda *a, **k: ran.append(a[0]) or make(*a, **k))
    swept = {r["metric"]: r for r in SV.seed_sweep(train, test, COLS, "y", [1, 2, 2], maxIter=2).collect()}
    assert not ran and set(swept) == {"pr_auc", "roc_auc"}
    alone = [SV.ranking(SV.score(SV.fit(train, COLS, "y", "gbt", s, subsamplingRate=0.8, maxIter=2), test, COLS), "y").first() for s in (1, 2)]
    assert swept["roc_auc"]["mean"] == pytest.approx(np.average([r["roc_auc"] for r in alone], weights=[1, 2]), abs=1e-2)
    ran.clear()
    audit = [(r["arm"], r["pr_auc"], r["roc_auc"]) for r in SV.leakage_audit(train, test, [*COLS, "leak"], "y", ["a", "kind"], seed=3, maxIter=2).collect()]
    assert not ran and [x[0] for x in audit] == ["all", "without_leak", "without_suspects"]
    for (_, ap, auc), cols in zip(audit, ([*COLS, "leak"], COLS, ["noise", "leak"])):
        r = SV.ranking(SV.score(SV.fit(train, cols, "y", "gbt", 3, maxIter=2), test, cols), "y").first()
        assert (ap, auc) == pytest.approx((r["pr_auc"], r["roc_auc"]), abs=1e-3)


def test_seed_sweep_and_verdicts(spark, labelled):
    train, test = SV.hash_split(labelled, "row_id", 0.7)
    s = SV.seed_sweep(train, test, COLS, "y", [1, 2], maxIter=2)
    assert s.filter("min <= mean and mean <= max").count() == 2
    rows = [("a", 0.01, 0.5, 0.6), ("b", -0.01, 0.5, 0.505), ("c", None, None, 0.02)]
    m = spark.createDataFrame(rows, "detector string, ci_low double, old_value double, new_value double")
    v = lambda r: [x["verdict"] for x in SV.keep_or_replace(m, r).orderBy("detector").collect()]
    assert v("ci") == ["replace", "keep_incumbent", "keep_incumbent"] and v("margin") == ["replace", "keep_incumbent", "replace"]
    assert v("lower") == ["keep_incumbent"] * 3


def test_selection_and_stability_jobs(spark, labelled, tmp_path):
    from wardline import jobs

    train, rest = SV.hash_split(labelled, "row_id", 0.6)
    val, test = SV.hash_split(rest, "row_id", 0.5, seed=8)
    out = jobs.selection_job(train, val, test, COLS, "y", {"maxDepth": [2, 3], "maxIter": [2, 4]}, str(tmp_path / "sel"), trials=2, reps=30, maxIter=1, maxDepth=1)
    assert out["trials"].count() == 2 and out["intervals"].count() == 5
    ci = out["intervals"].filter("metric = 'pr_auc'").first()["ci_low"]
    assert out["verdict"].first()["verdict"] == ("replace" if ci > 0 else "keep_incumbent")
    st = jobs.stability_job(train, test, COLS + ["leak"], "y", ["leak"], str(tmp_path / "st"), seeds=(1, 2), maxIter=2)
    assert st["seeds"].count() == 2 and st["leakage"].count() == 3


def test_gate_parity_and_cold_start_jobs(spark, tmp_path):
    from wardline import jobs

    m = spark.createDataFrame([("auc", 0.9), ("ap", 0.2)], "metric string, value double")
    e = spark.createDataFrame([("auc", 0.91, 0.02), ("ap", 0.5, 0.1), ("ks", 0.1, 1.0)], "metric string, expected double, tolerance double")
    c = spark.createDataFrame([("slow", 19, 4), ("never", None, 3), ("later", 2, 5), ("lost", 2, None)], "metric string, old int, new int")
    got = {r["metric"]: r["passed"] for r in jobs.headline_job(m, e, c, str(tmp_path / "h")).collect()}
    assert got == {"auc": 1, "ap": 0, "ks": 0, "slow": 1, "never": 1, "later": 0, "lost": 0}
    rows = lambda *d: spark.createDataFrame([(i, f"u{i % 2}", i, x) for i, x in enumerate(d)], "event_id long, identity_id string, s long, decision string").selectExpr(
        "event_id", "identity_id", "timestamp_seconds(s) as ts", "decision")
    f = jobs.cold_start_job(rows("STEP_UP", "STEP_UP", "ALLOW"), rows("ALLOW", "STEP_UP", "BLOCK"), str(tmp_path / "c")).first()
    assert (f["rate_before"], f["rate_after"]) == (1.0, 0.5)
    s = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.8, 1), ("b", 0.7, 0), ("b", 0.2, 1)], "cohort string, score double, y int")
    assert jobs.parity_job(s, "cohort", "a", "b", 0.5, str(tmp_path / "p")).first()["safe_rate"] == 0.5


def plain_isotonic(rows):
    """Pool adjacent violators, one row after the other; the fitted value of each distinct score."""
    ties = {}
    for x, y in rows:
        s, n = ties.get(x, (0.0, 0))
        ties[x] = (s + y, n + 1)
    blocks = []
    for x in sorted(ties):
        blocks.append([*ties[x], [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps", "one"])
@pytest.mark.parametrize("ranges,fan_in", [(1, 8), (9, 2), (30, 3)])
def test_isotonic_blocks_equal_plain_pooling(spark, shape, ranges, fan_in):
    import random

    from wardline.models import isotonic as I

    r = random.Random(ranges)
    chance = {"noise": lambda x: 0.4, "rising": lambda x: x, "falling": lambda x: 1 - x, "steps": lambda x: round(x * 4) / 4, "one": lambda x: 1.0}[shape]
    rows = [(x, int(r.random() < chance(x))) for _ in range(1 if shape == "one" else 700) for x in [round(r.random(), r.choice([1, 4]))]]
    df = spark.createDataFrame(rows + [(None, 1), (float("nan"), 0)], "score double, y int")
    blocks = I.isotonic_blocks(df, ranges=ranges, fan_in=fan_in)
    want = plain_isotonic(rows)
    found = sorted(tuple(b) for b in blocks.collect())
    assert sum(b[3] for b in found) == len(rows) and all(a[1] < b[0] and a[2] < b[2] for a, b in zip(found, found[1:]))
    assert {x: next(v for low, high, v, _ in found if low <= x <= high) for x in want} == pytest.approx(want)
    for most in (200_000, 5):
        got = {x["score"]: x["calibrated"] for x in I.isotonic_map(blocks, most)(df).collect()}
        assert {x: v for x, v in got.items() if x in want} == pytest.approx(want) and got[None] is None
    between = spark.createDataFrame([(-9.0,), (9.0,), (found[0][1] + 1e-9,)], "score double")
    a, b, c = (x["calibrated"] for x in I.isotonic_map(blocks)(between).orderBy("score").collect()) if len(found) == 1 else \
        (next(x["calibrated"] for x in I.isotonic_map(blocks)(between).collect() if x["score"] == s) for s in (-9.0, found[0][1] + 1e-9, 9.0))
    assert a == pytest.approx(found[0][2]) and a <= b + 1e-12 <= c + 1e-9 and max(a, b, c) == pytest.approx(found[-1][2])
    with pytest.raises(ValueError):
        I.isotonic_map(I.isotonic_blocks(df.limit(0)))
