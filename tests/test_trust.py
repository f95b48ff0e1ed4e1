"""Scenario tests of the trust fold, batch and streaming, and of the decision views."""

import json
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import history as H
from wardline.plans import fixtures as V
from wardline.sources import readers as R, tables as TB
from wardline.streaming import fold as T, trust as TR

T0 = datetime(2024, 3, 1, 14)
EVENT_DDL = (
    "event_id long, ts timestamp, identity_id string, event_type string, channel string, device_id string, geo string, hour_of_day int, "
    "amount double, is_new_beneficiary boolean, recovery_contact_changed boolean, sim double, ml double"
)


def event(i, minutes, identity="u1", event_type="login", channel="mobile_app", device=None, geo="IN-GJ", hour=14, amount=None,
          payee=False, contact=False, sim=0.95, ml=0.1):
    return (i, T0 + timedelta(minutes=minutes), identity, event_type, channel, device or f"dev_{identity}", geo, hour, amount, payee, contact, sim, ml)


def run(spark, events, outcomes=None, params=T.Params(), **kw):
    df = spark.createDataFrame(events, EVENT_DDL)
    out = spark.createDataFrame(outcomes, "identity_id string, ts timestamp, passed boolean") if outcomes else None
    kw = {"similarity": "sim", "ml_risk": "ml"} | kw
    return [r.asDict() for r in TR.explain(TR.trust_decisions(df, out, params=params, **kw)).orderBy("ts", "event_id").collect()]


def warm(n=15, start=0, step=7, **kw):
    return [event(start + i, i * step, **kw) for i in range(n)]


def test_routine_is_allowed(spark):
    r = run(spark, warm(16))[-1]
    assert r["decision"] == "ALLOW" and r["trust"] >= 650 and r["risk_band"] == "LOW"


def test_takeover_is_challenged_with_a_reason(spark):
    bad = event(99, 200, event_type="transaction", channel="internet_banking", device="dev_attacker", geo="RU-MOW", hour=3,
                amount=95_000.0, payee=True, sim=0.2, ml=0.9)
    r = run(spark, warm() + [bad])[-1]
    assert r["decision"] != "ALLOW"
    assert any(x.split(":")[0] in ("NEW_DEVICE", "BEHAVIOUR_MISMATCH", "GEO_ANOMALY") for x in r["reason_codes"])
    assert r["counterfactual"].startswith("Would have scored lower")


def test_recovery_on_unknown_device_is_challenged(spark):
    bad = event(99, 200, event_type="account_recovery", device="x", hour=3, contact=True, ml=0.9)
    r = run(spark, warm() + [bad])[-1]
    assert r["decision"] != "ALLOW" and r["step_up_method"] in ("video_kyc", None)


def test_refused_event_does_not_enter_the_profile(spark):
    bad = event(98, 200, event_type="transaction", device="dev_evil", geo="RU-MOW", hour=3, amount=95_000.0, payee=True, sim=0.1, ml=0.95)
    rows = run(spark, warm() + [bad, event(99, 210, device="dev_evil")])
    assert rows[-2]["known_devices"] == rows[-3]["known_devices"] == 1
    assert rows[-1]["new_device"] == 1.0


def test_step_up_outcomes_move_trust(spark):
    start = run(spark, warm(3))[-1]["trust"]
    again = [event(50, 60, ml=0.5, sim=0.5)]
    base = run(spark, warm(3) + again)[-1]["trust"]
    after = lambda p: run(spark, warm(3) + again, [("u1", T0 + timedelta(minutes=30), p)])[-1]["trust"]
    assert start > 700
    gain = base - start
    assert after(True) == min(min(start + 250, 1000) + gain, 1000) and after(False) == start - 400 + gain


def test_impossible_travel_flags_and_keeps_flagging(spark):
    rows = run(spark, warm(4, step=2) + [event(50, 10, geo="RU-MOW"), event(51, 11, geo="RU-MOW")])
    assert [r["impossible"] for r in rows] == [False] * 4 + [True, True]
    assert rows[-1]["reason_codes"][0] == C.TRAVEL_REASON
    legacy = run(spark, warm(4, step=2) + [event(50, 10, geo="RU-MOW")], params=T.Params.named("before"))
    assert not legacy[-1]["impossible"]


def test_cold_prior_is_one_shot_and_only_benign(spark):
    r = run(spark, [event(1, 0), event(2, 1, ml=None)])
    assert r[0]["new_device"] == 0.2 and r[0]["new_geo"] == 0.25
    bad = dict(event_type="transaction", channel="internet_banking", amount=50_000.0, payee=True, hour=3)
    a = run(spark, [event(1, 0, **bad)])[0]
    b = run(spark, [event(1, 0, **bad)], params=T.Params(cold_prior=False))[0]
    assert a["new_device"] == 0.4 and a["event_risk"] == b["event_risk"]
    refused = [event(1, 0, ml=0.99, sim=0.0), event(2, 1, ml=0.99, sim=0.0)]
    r = run(spark, refused)
    assert r[0]["events_seen"] == 0 and r[1]["new_device"] == 0.4  # still cold, prior already used


def test_recovery_is_rate_limited(spark):
    down = [event(10 + i, i, event_type="transaction", geo="RU-MOW", device=f"z{i}", amount=99_000.0, payee=True, sim=0.0, ml=1.0) for i in range(2)]
    benign = [event(100 + i, 10 + i * 0.5, channel="branch") for i in range(40)]
    rows = run(spark, down + benign)
    low = rows[1]["trust"]
    assert low < rows[-1]["trust"] <= low + C.RECOVERY_CAP
    free = run(spark, down + benign, params=T.Params.named("before"))
    assert free[-1]["trust"] > low + C.RECOVERY_CAP


def test_degraded_modes(spark):
    priv = run(spark, [event(1, 0, event_type="privileged_access", channel="admin_console", ml=None, sim=None)])[0]
    assert priv["degraded"] and priv["decision"] != "ALLOW" and priv["risk_band"] == "DEGRADED_FAILCLOSED"
    routine = run(spark, warm(7, ml=None, sim=None))[-1]
    assert routine["degraded"] and routine["decision"] == "ALLOW" and routine["risk_band"] == "DEGRADED_FAILOPEN"


def test_creeping_risk_goes_to_review_until_verified(spark):
    ramp = [event(100 + i, 100 + i * 70, ml=min(0.05 + 0.03 * i, 0.7)) for i in range(25)]
    rows = run(spark, warm(10) + ramp)
    first = next(i for i, r in enumerate(rows) if r["drift_review"])
    assert rows[first]["risk_band"] == "DRIFT_REVIEW" and rows[first]["reason_codes"][0] == C.DRIFT_REASON
    legacy = run(spark, warm(10) + ramp, params=T.Params.named("before"))
    assert not any(r["drift_review"] for r in legacy)
    when = rows[first]["ts"] + timedelta(minutes=1)
    calm = [event(900, 100 + 26 * 70, ml=0.05)]
    assert run(spark, warm(10) + ramp[: first - 9] + calm)[-1]["decision"] == "STEP_UP"
    assert run(spark, warm(10) + ramp[: first - 9] + calm, [("u1", when, True)])[-1]["decision"] == "ALLOW"


def test_fold_equals_replay_when_everything_is_allowed(spark, sf):
    """With every event allowed the adaptive history is the full history."""
    rows = [event(i, i * 90, identity=f"u{i % 3}", hour=i % 24, amount=float(100 + i % 7) if i % 2 else None, ml=0.0, sim=1.0,
                  event_type="transaction" if i % 2 else "login") for i in range(120)]
    df = spark.createDataFrame(rows, EVENT_DDL)
    d = TR.trust_decisions(df, similarity="sim", ml_risk="ml", params=T.Params(cold_prior=False, drift=False))
    assert d.filter("decision <> 'ALLOW'").count() == 0
    f = H.replay_features(df, behavior="sim")
    both = d.join(f.select("event_id", *[F.col(c).alias(f"r_{c}") for c in C.FEATURES]), "event_id").collect()
    assert len(both) == 120
    for r in both:
        for c in C.FEATURES:
            assert abs(r[c] - r[f"r_{c}"]) < 1e-9, (c, r)


def test_sliced_hot_identity_equals_one_pass(spark, sf):
    e = V.identity_events(spark, sf).withColumn("identity_id", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("identity_id")))
    o = e.filter("event_id % 40 = 0").select("identity_id", "ts", F.lit(True).alias("passed"))
    p = T.Params(require_model=False)
    a, b = TR.trust_decisions(e, o, params=p), TR.trust_decisions(e, o, params=p, hot_rows=60)
    assert a.count() == b.count() == e.count() and a.exceptAll(b).count() == 0


def test_stream_equals_batch_and_late_is_set_aside(spark, sf):
    events = V.identity_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    days = [r[0] for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i, part in enumerate([days[:10], days[10:20], days[20:]]):
        events.filter(F.to_date("ts").isin(part)).coalesce(1).write.parquet(f"{root}/in/batch={i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    q = TR.device_stage(stream).writeStream.format("parquet").option("path", f"{root}/staged").option("checkpointLocation", f"{root}/c1") \
        .trigger(availableNow=True).start()
    q.awaitTermination(240)
    staged = spark.read.parquet(f"{root}/staged")
    want = H.device_sharing(events)
    assert staged.select("event_id", "device_sharing").exceptAll(want.select("event_id", "device_sharing")).count() == 0
    staged.coalesce(1).write.parquet(f"{root}/events")
    p = T.Params(require_model=False)

    def score():
        prepared = TR.prepare(spark.readStream.schema(staged.schema).parquet(f"{root}/events"))
        TB.write_decisions(TR.trust_stream(prepared, p), f"{root}/decisions", f"{root}/c2", available_now=True).awaitTermination(240)
        return spark.read.parquet(f"{root}/decisions")

    got = score()
    batch = TR.trust_decisions(events, params=p)
    cols = ["event_id", "trust", "decision", "risk_band", F.round("event_risk", 9).alias("r")]
    assert got.count() == events.count()
    assert got.filter("decision = 'LATE'").count() == 0
    assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    # a replayed micro-batch adds nothing
    TB.append_new_decisions(got.drop("bucket").limit(100), f"{root}/decisions")
    assert spark.read.parquet(f"{root}/decisions").count() == events.count()
    # an event older than its identity's last one is reported as LATE and changes nothing
    old = staged.orderBy("ts").limit(1).withColumns({"event_id": F.lit(10**9).cast("long"), "ts": F.lit(T0 - timedelta(days=400))})
    old.coalesce(1).write.mode("append").parquet(f"{root}/events")
    late = score().filter("event_id = 1000000000").collect()
    assert [r["decision"] for r in late] == ["LATE"]


def test_client_view_hides_internals_and_audit_view_keeps_them(spark):
    bad = event(99, 200, event_type="transaction", device="x", geo="RU-MOW", hour=3, amount=95_000.0, payee=True, sim=0.2, ml=0.9)
    df = spark.createDataFrame(warm() + [bad], EVENT_DDL)
    d = TR.explain(TR.trust_decisions(df, similarity="sim", ml_risk="ml"))
    client = TR.to_client(d)
    assert set(client.columns) == {"event_id", "decision", "step_up_method", "challenge_id", "message"}
    for r in client.collect():
        assert (r["challenge_id"] is not None) == (r["decision"] == "STEP_UP")
        assert r["message"] == C.CLIENT_MESSAGE[r["decision"]]
    body = json.loads(TR.to_audit_payload(d).filter("event_id = 99").first()["payload"])
    assert list(body) == sorted(body) and body["reasons"] and len(body["feature_contributions"]) == 5


def test_step_up_limits(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(i, "a", at(i), True) for i in range(7)] + [(10, "a", at(400), True)]
    rows += [(100 + i, "b", at(i), False) for i in range(5)] + [(110, "b", at(6), True)]
    rows += [(200 + i, "c", at(i), False) for i in range(22)] + [(230, "c", at(30), True)]
    df = spark.createDataFrame(rows, "attempt_id long, identity_id string, ts timestamp, valid boolean")
    s = {r["attempt_id"]: r["status"] for r in TR.step_up_limits(df).collect()}
    assert s == {r["attempt_id"]: r["status"] for r in TR.step_up_limits(df, hot_rows=6).collect()}
    assert [s[i] for i in range(7)] == ["accepted"] * 5 + ["refused_accepted"] * 2 and s[10] == "accepted"
    assert s[110] == "accepted" and s[104] == "rejected"
    assert s[219] == "rejected" and s[220] == "refused_failures" and s[230] == "refused_failures"


@pytest.mark.parametrize("trust,risk,band", [(650, 0.44, "LOW"), (650, 0.45, "ELEVATED"), (400, 0.64, "ELEVATED"), (399, 0.1, "HIGH"), (150, 0.9, "HIGH"), (149, 0.1, "CRITICAL")])
def test_bands_and_policy_agree(spark, trust, risk, band):
    for et in ("login", "privileged_access", "onboarding"):
        df = spark.createDataFrame([(trust, risk, et)], "t int, r double, e string").withColumn("b", X.risk_band(F.col("t"), F.col("r")))
        r = df.select("b", X.decision(F.col("b"), F.col("e")).alias("d"), X.step_up_method(F.col("b"), F.col("e")).alias("m")).first()
        assert r["b"] == band and (r["d"], r["b"], r["m"]) == T.decide(trust, risk, et)


def test_event_validation(spark):
    ok = {"event_id": 1, "ts": "2024-01-01T00:00:00Z", "identity_id": "u", "event_type": "login", "channel": "api", "device_id": "d", "geo": "IN-GJ", "hour_of_day": 3}
    cases = [ok, ok | {"behavior_score": 0.99}, ok | {"hour_of_day": 24}, ok | {"channel": "fax"}, {k: v for k, v in ok.items() if k != "geo"}, ok | {"amount": "x"}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("{oops",), (None,)], "raw string")
    good, bad = R.validate_events(df)
    assert good.count() == 1 and good.first()["is_new_beneficiary"] is False
    assert sorted(r["problem"] for r in bad.collect()) == sorted(
        ["unknown_field", "hour_of_day", "channel", "missing_field", "wrong_type", "malformed", "malformed"])


def test_null_geo_and_running_statistics(spark):
    import random

    import numpy as np

    ds = run(spark, [event(1, 0, geo=None), event(2, 60, geo="IN-DEL"), event(3, 120, geo=None)])
    assert len(ds) == 3
    a, r = T.Amounts(), random.Random(3)
    seen = []
    for i in range(900):
        x = r.lognormvariate(8, 2)
        seen = (seen + [x])[-200:]
        a.add(x)
        if i in (3, 150, 199, 200, 399, 400, 899):
            want = min(x / 100000, 1.0) if len(seen) < 5 else min(abs(5.0 - np.mean(seen)) / (3 * max(np.std(seen), 1.0)), 1.0)
            assert abs(a.deviation(x if len(seen) < 5 else 5.0) - want) < 1e-9
    h = T.Hours([23, 1])
    assert (h.distance(23), h.distance(0), h.distance(12), T.Hours().distance(3)) == (0, 1, 11, 6)
    s = T.State()
    s.devices.add("d")
    s.hours.add(5)
    s.amounts.add(9.0)
    assert T.State.load(s.dump()).dump() == s.dump()


def random_rows(seed, identities, most):
    """Prepared rows with outcomes, nulls, travels, long histories and every event type."""
    import random

    import pandas as pd

    r = random.Random(seed)
    rows = []
    for k in range(identities):
        at = 1_700_000_000.0
        for _ in range(r.randint(1, most)):
            at += r.choice([0, 5, 60, 900, 4000])
            risky = r.random() < 0.15
            rows.append({
                "event_id": len(rows), "identity_id": None if k == 3 else f"u{k}", "ts": pd.Timestamp(at, unit="s"), "kind": 2 if r.random() < 0.05 else 1, "passed": r.random() < 0.5,
                "event_type": r.choice(C.EVENT_TYPES) if risky else "login", "device_id": f"d{r.randint(0, 1 + 4 * risky)}", "geo": r.choice([None, "IN-GJ", "IN-MH", "RU-MOW", ""]) if risky else "IN-GJ",
                "hour_of_day": r.randint(0, 23), "amount": r.choice([float("nan"), r.lognormvariate(7, 2)]), "ml_risk": r.choice([float("nan"), 0.1, r.random()]) if risky else 0.05,
                "ts_seconds": at, "prior_ok": r.random() < 0.5, "static_risk": r.random() * (0.5 if risky else 0.1), "behavior_anomaly": 0.1, "event_criticality": 0.2, "channel_risk": 0.3,
                "new_beneficiary": 0.0, "recovery_change": 0.0, "device_sharing": 0.0,
            })
    return pd.DataFrame(rows)


@pytest.mark.parametrize("params", [T.Params(), T.Params(require_model=False), T.Params.named("before")])
def test_lockstep_equals_the_fold(params):
    import pandas as pd

    from wardline.streaming import lockstep

    for seed, identities, most in ((1, 60, 25), (2, 9, 900), (3, 1, 1)):
        rows = random_rows(seed, identities, most)
        want, who, s = [], object(), None
        for row in rows.itertuples(index=False):
            if row.identity_id != who:
                who, s = row.identity_id, T.State()
            if row.kind == 2:
                T.settle(s, bool(row.passed))
            else:
                want.append(T.advance(s, row, params))
        for buffer, batch in ((10**6, 10**6), (200, 64), (50, 300)):
            got = pd.concat(lockstep.runner(params, buffer)(iter([rows[i:i + batch].reset_index(drop=True) for i in range(0, len(rows), batch)])), ignore_index=True)
            expected = pd.DataFrame.from_records(want, columns=got.columns)
            pd.testing.assert_frame_equal(got.where(got.notna(), None), expected.where(expected.notna(), None), check_dtype=False, rtol=1e-9)
        if seed == 2:
            assert {"ALLOW", "STEP_UP", "BLOCK"} <= set(expected["decision"]) and expected["drift_review"].any() == params.drift and expected["impossible"].any() == params.travel
