"""The hot-key forms must equal the plain windows, row for row."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from wardline.functions import expr as X
from wardline.operators import drift, encode as E, history as H, metrics as M, ordered as O, splits as S
from wardline.plans import fixtures as V


def skewed(spark, n=3000, seed=1):
    """A third of all rows belong to one key, some keys are null, several rows share a time."""
    r = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else (None if i % 3 == 1 and i % 2 else f"k{r.randrange(40)}")
        rows.append((i, k, t0 + timedelta(seconds=r.randrange(n // 2) * 7), r.choice("abcde"), round(r.random(), 3)))
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp, country string, v double").repartition(6)


def same(a, b, *cols, places=9):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    fix = lambda r: tuple(round(x, places) if isinstance(x, float) else x for x in r)
    left, right = sorted(map(fix, a.select(*cols).collect()), key=key), sorted(map(fix, b.select(*cols).collect()), key=key)
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=1e-7)), (x, y)


def test_probe_finds_only_hot_keys(spark):
    df = skewed(spark)
    s = O.probe(df, ["key"], F.unix_micros("ts"), hot_rows=100)
    assert s.split and {r["key"] for r in s.cuts.collect()} >= {"hot", None}
    assert not O.probe(df, ["key"], F.unix_micros("ts"), hot_rows=5000).split
    per = O.with_slice(df, s, F.unix_micros("ts")).groupBy("key", "_slice").count().agg(F.max("count")).first()[0]
    assert per < 250  # a hot key of 1000 rows no longer sits in one group


@pytest.mark.parametrize("kind,before", [("sum", False), ("sum", True), ("min", False), ("max", False)])
def test_running_split_equals_plain(spark, kind, before):
    df = skewed(spark)
    order, pos = [F.col("ts"), F.col("event_id")], F.unix_micros("ts")
    plain = O.running(df, ["key"], order, {"x": (kind, F.col("v"))}, O.Slicing(("key",), None), pos, before)
    split = O.running(df, ["key"], order, {"x": (kind, F.col("v"))}, O.probe(df, ["key"], pos, 100), pos, before)
    same(plain, split, "event_id", "key", "x")


def test_ordinal_and_previous_event(spark):
    df = skewed(spark)
    same(H.causal_index(df, "key", "ts", "event_id", "n"), H.causal_index(df, "key", "ts", "event_id", "n", hot_rows=100), "event_id", "n")
    a = H.impossible_travel(df, "key", "ts", "event_id")
    b = H.impossible_travel(df, "key", "ts", "event_id", hot_rows=100, block=50)
    same(a, b, "event_id", "prev_country", "hours_since", "impossible")


def test_trailing_count_matches_range_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-299_999_999, 0)
    want = df.withColumn("n_recent", F.count(F.lit(1)).over(w))
    same(want, H.trailing_count(df, "key", "ts", 300), "event_id", "n_recent")
    same(want, H.trailing_count(df, "key", "ts", 300, hot_rows=60), "event_id", "n_recent")


def test_replay_features_split_equals_plain(spark, sf):
    e = V.identity_events(spark, sf)
    hot = e.withColumn("identity_id", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("identity_id")))
    from wardline.schemas import FEATURES

    plain, split = H.replay_features(hot), H.replay_features(hot, hot_rows=60, block=230)
    same(plain, split, "event_id", "n", *FEATURES)


def test_device_count_split_equals_plain(spark, sf):
    e = V.identity_events(spark, sf).withColumn("device_id", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("device_id")))
    same(H.device_identity_count(e), H.device_identity_count(e, hot_rows=50), "event_id", "identities_so_far")


def _recursion(risks):
    ewma = cusum = 0.0
    out = []
    for r in risks:
        base = ewma if ewma > 0 else r
        cusum = max(0.0, cusum + r - base - 0.015)
        ewma = r if ewma == 0 else ewma + 0.03 * (r - ewma)
        out.append((ewma, cusum))
    return out


def test_drift_blocks_equal_recursion(spark):
    r = random.Random(5)
    risks = [0.0] * 3 + [round(r.random() * 0.6, 4) for _ in range(6000)]
    rows = [(i, "hot", datetime(2024, 1, 1) + timedelta(seconds=i), x) for i, x in enumerate(risks)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, risk double")
    want = _recursion(risks)
    for kw in ({}, {"hot_rows": 900}):
        got = drift.risk_cusum(df, ["key"], ["ts", "event_id"], F.unix_micros("ts"), **kw).orderBy("event_id").collect()
        for g, (e, c) in zip(got, want):
            assert abs(g["ewma"] - e) < 1e-9 and abs(g["cusum"] - c) < 1e-7
    e = drift.risk_ewma(df, ["key"], ["ts"], F.unix_micros("ts"), block=1500).orderBy("event_id").collect()
    assert max(abs(g["ewma"] - w[0]) for g, w in zip(e, want)) < 1e-9


def test_mean_shift_split_equals_plain(spark):
    df = skewed(spark).withColumn("risk", F.col("v"))
    a = drift.mean_shift(df, ["key"], ["ts", "event_id"], F.unix_micros("ts"))
    b = drift.mean_shift(df, ["key"], ["ts", "event_id"], F.unix_micros("ts"), hot_rows=100, block=40)
    same(a, b, "event_id", "shift", "ks", "shift_fired")


def test_roc_split_equals_plain(spark, sf):
    s = V.score_variants(spark, sf)
    a, b = M.roc_curve(s, ["variant"], amount="amount"), M.roc_curve(s, ["variant"], amount="amount", hot_rows=50)
    same(a, b, "variant", "threshold", "tp", "fp", "n_pos", "n_neg", "caught", places=4)
    a, b = (M.roc_curve(s, ["variant"], drop_collinear=True, hot_rows=h) for h in (10**6, 50))
    same(a, b, "variant", "threshold", "tp", "fp", "pos", "neg")


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.8, 0.999, 1.0])
def test_exact_quantile_brackets(spark, q):
    import numpy as np

    r = random.Random(3)
    values = [round(r.gauss(0, 1), 4) for _ in range(5000)] + [0.25] * 2500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = float(np.quantile(values, q))
    assert abs(S.exact_quantile(df, F.col("v"), q) - want) < 1e-12
    assert abs(S.exact_quantile(df, F.col("v"), q, final_rows=50) - want) < 1e-12


def test_frequency_encoding_head_and_tail(spark):
    df = skewed(spark)
    a = E.frequency_encoding(df, df, "key", head=1000)
    b = E.frequency_encoding(df, df, "key", head=2)
    same(a, b, "event_id", "f_key")
    assert df.count() == b.count()




def test_drift_scenarios(spark):
    creeping = [.10, .12, .15, .18, .22, .26, .30, .34, .38, .42]
    stable = [.12, .10, .13, .11, .12, .10, .11, .12, .10, .13]
    ramp = [min(.05 + .0133 * i, .44) for i in range(40)]
    flat = [.12] * 60
    rows = [(i, k, datetime(2024, 1, 1) + timedelta(minutes=i), x)
            for k, xs in (("creep", creeping), ("stable", stable), ("ramp", ramp), ("flat", flat)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, risk double")
    m = drift.mean_shift(df, ["key"], ["ts"], F.unix_micros("ts")).filter("shift_fired = 1").select("key").distinct()
    fired = {r[0] for r in m.collect()}
    assert "creep" in fired and "stable" not in fired and "flat" not in fired
    c = drift.risk_cusum(df, ["key"], ["ts"], F.unix_micros("ts")).filter("cusum_fired = 1").select("key").distinct()
    fired = {r[0] for r in c.collect()}
    assert "ramp" in fired and "flat" not in fired
    assert X.micros("ts") is not None
