"""Whole jobs on small made-up files."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline import jobs, schemas as C
from wardline.streaming import trust as TR

T0 = datetime(2020, 2, 1)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write(folder, name, header, rows):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(",".join(header) + "\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    return path


def test_payments_job(spark, folder):
    r = random.Random(1)
    rows = []
    for i in range(900):
        fraud = int(r.random() < 0.15)
        amount = round(r.random() * 100 + 300 * fraud, 2)
        old = amount if fraud else round(r.random() * 900, 2)
        rows.append((r.randrange(1, 740), r.choice(["TRANSFER", "PAYMENT"]), amount, f"C{i}", old, round(max(old - amount, 0), 2), r.choice("CM") + str(i % 30), 0, amount, fraud, int(fraud and r.random() < 0.2)))
    p = write(folder, "p.csv", C.PAYMENTS.names, rows)
    out = jobs.payments_job(spark, p, f"{folder}/out", neg_cap=300, reps=20, maxIter=3, maxDepth=3)
    board = {x["variant"]: x for x in out["leaderboard"].collect()}
    assert set(board) == {"full", "behavioral"} and board["full"]["roc_auc"] > 0.9 and board["full"]["pr_auc_low"] <= board["full"]["pr_auc_high"]
    assert out["baseline_lift"].first()["rule_recall"] < 0.6 and out["cost"].filter("recall > 0").count() == 2
    test_rows = sum(1 for x in rows if x[0] > 600)
    assert spark.read.parquet(f"{folder}/out/scores").count() == 2 * test_rows
    docs = {x["variant"]: x.asDict(recursive=True) for x in spark.read.json(f"{folder}/out/evaluation/document").collect()}
    assert set(docs) == {"full", "behavioral"}
    for name, doc in docs.items():
        assert set(doc) == {"variant", "counts", "threshold_free", "operating_points", "cost", "calibration", "baseline_lift", "bootstrap"}
        assert doc["counts"]["n_pos"] + doc["counts"]["n_neg"] == test_rows and doc["counts"]["is_probability"]
        assert doc["threshold_free"]["roc_auc"] == pytest.approx(board[name]["roc_auc"]) and len(doc["operating_points"]) >= 5 and len(doc["bootstrap"]) == 5


def test_cards_job_with_a_search(spark, folder):
    """Tuning on the last fifth of the training time, a map chosen there, one evaluation of the test rows, and stability."""
    r = random.Random(7)
    tx = []
    for i in range(600):
        y = int(r.random() < 0.3)
        tx.append([i, y, 1000 + i] + [round(r.random() + 0.7 * y, 3)] + [round(r.random(), 3)] * (len(C.CARD_NUM) - 1) + [r.choice("WC")] * len(C.CARD_CAT))
    idn = [[i] + [r.random()] * 5 + ["mobile", f"dev{i % 5}", "Android 7", "chrome 6", "New", "F", "N"] for i in range(0, 600, 3)]
    t = write(folder, "t2.csv", ["TransactionID", "isFraud", "TransactionDT", *C.CARD_NUM, *C.CARD_CAT], tx)
    d = write(folder, "i2.csv", ["TransactionID", *C.IDENTITY_NUM, *C.IDENTITY_CAT], idn)
    out = jobs.cards_job(spark, t, d, f"{folder}/out2", reps=20, space={"maxDepth": [2, 3]}, trials=2, maxIter=2)
    assert out["selection_trials"].count() == 2 and out["selection_verdict"].count() == 1
    briers = {x["method"]: x for x in out["selection_calibration"].collect()}
    assert set(briers) == {"none", "isotonic", "logistic"}
    chosen = [m for m, x in briers.items() if x["chosen"]]
    assert len(chosen) == 1 and briers[chosen[0]]["brier"] == min(briers[m]["brier"] for m in ("isotonic", "logistic"))
    assert {x["variant"] for x in out["selection_evaluation"].collect()} == {"old", "tuned"}
    scored = spark.read.parquet(f"{folder}/out2/selection/scores")
    assert scored.count() == 120 and scored.filter("calibrated between 0 and 1").count() == 120
    assert out["seeds"].count() >= 1 and out["leakage"].count() == 3


def test_cards_job(spark, folder):
    r = random.Random(2)
    tx, idn = [], []
    for i in range(500):
        y = int(r.random() < 0.2)
        tx.append([i, y, 1000 + i] + [round(r.random() + y, 3)] + [round(r.random(), 3)] * (len(C.CARD_NUM) - 1) + [r.choice("WC")] * len(C.CARD_CAT))
        if i % 3 == 0:
            idn.append([i] + [r.random()] * 5 + ["mobile", f"dev{i % 5}", "Android 7", "chrome 6", "New", "F", "N"])
    t = write(folder, "t.csv", ["TransactionID", "isFraud", "TransactionDT", *C.CARD_NUM, *C.CARD_CAT], tx)
    d = write(folder, "i.csv", ["TransactionID", *C.IDENTITY_NUM, *C.IDENTITY_CAT], idn)
    out = jobs.cards_job(spark, t, d, f"{folder}/out", reps=0, maxIter=2, maxDepth=3)
    board = {x["variant"]: x["roc_auc"] for x in out["leaderboard"].collect()}
    assert set(board) == {"txn_only", "with_device", "with_device_identity_subset"} and board["txn_only"] > 0.7
    assert spark.read.parquet(f"{folder}/out/scores").select("row_id").distinct().count() == 100


LOGIN_HEADER = ["Login Timestamp", "User ID", "Round-Trip Time [ms]", "Country", "ASN", "Browser Name and Version", "OS Name and Version",
                "Device Type", "Login Successful", "Is Attack IP", "Is Account Takeover"]


def logins(folder, n=700):
    r = random.Random(3)
    rows = []
    for i in range(n):
        ato = r.random() < 0.12
        country = "RU" if ato and r.random() < 0.8 else r.choice(["NO", "US", "IN"])
        rows.append((T0 + timedelta(minutes=37 * i), f"u{r.randrange(60)}", r.randrange(10, 900), country, r.randrange(5), f"Chrome {i % 4}", "iOS 13", "mobile", r.random() > 0.05, ato and r.random() < 0.3, ato))
    return write(folder, "l.csv", LOGIN_HEADER, rows)


def test_login_jobs(spark, folder):
    p = logins(folder)
    out = jobs.logins_job(spark, p, f"{folder}/out", neg_cap=200, reps=0, maxIter=3, maxDepth=3)
    board = {x["variant"]: x["roc_auc"] for x in out["leaderboard"].collect()}
    assert set(board) == {"noip", "ip", "ip_flag"} and board["noip"] > 0.7
    assert jobs.compare_reports({"a": out["leaderboard"], "b": out["leaderboard"]}).count() == 6
    lift = jobs.travel_job(spark, p).first()
    assert lift["takeovers"] >= lift["takeovers_with_prior"] >= lift["takeovers_flagged"] > 0
    replay = jobs.replay_job(spark, p, f"{folder}/r")
    risk = jobs.serving_job(replay, f"{folder}/m", trees=20)
    assert risk.count() == replay.count() and risk.filter("ml_risk < 0 or ml_risk > 1").count() == 0
    private = jobs.privacy_job(replay, f"{folder}/d", b"secret")
    assert abs(private["ledger"].first()["total_epsilon"] - 1.1126) < 1e-3 and private["cohort_means"].columns[0] == "cohort"
    events = jobs.login_events(jobs.S.login_population(jobs.R.read_logins(spark, p), "genuine"))
    d = TR.trust_decisions(events.join(risk.select("event_id", "ml_risk"), "event_id"), ml_risk="ml_risk")
    rates, verdict = jobs.fairness_job(d, "geo", min_size=20)
    assert d.filter("degraded").count() == 0 and rates.count() >= 3 and 0 <= verdict.first()["impact_ratio"] <= 1


def test_keystroke_job(spark, folder):
    r = random.Random(4)
    rows = [(f"s{s}", 1 + k // 20, k % 20, *[round(r.gauss(s, 0.3), 4) for _ in range(4)]) for s in range(3) for k in range(40)]
    p = write(folder, "k.csv", ["subject", "sessionIndex", "rep", "H.a", "DD.a.b", "UD.a.b", "H.b"], rows)
    out = jobs.keystroke_job(spark, p, f"{folder}/out", enrol=20, impostor=3, reps=20)
    s, ci = out["summary"].first(), out["interval"].first()
    assert s["users"] == 3 and s["mean_eer"] < 0.2 and ci["ci_low"] <= ci["ci_high"]


def test_insider_job(spark, folder):
    r = random.Random(5)
    lo, dev, fil = [], [], []
    stamp = lambda d, h: (datetime(2010, 1, 4) + timedelta(days=d, hours=h, minutes=r.randrange(60))).strftime("%m/%d/%Y %H:%M:%S")
    for u in range(12):
        for d in range(25):
            bad = u == 3 and 15 <= d <= 17
            for k in range(r.randrange(1, 4)):
                lo.append((len(lo), stamp(d, 22 if bad else 9), f"u{u}", f"pc{u}", "Logon"))
            for k in range(r.randrange(0, 3) + 9 * bad):
                dev.append((len(dev), stamp(d, 23 if bad else 10), f"u{u}", f"pc{u}", "Connect"))
            for k in range(r.randrange(0, 3) + 9 * bad):
                fil.append((len(fil), stamp(d, 23 if bad else 11), f"u{u}", f"pc{u}"))
    head = ["id", "date", "user", "pc", "activity"]
    paths = [write(folder, "logon.csv", head, lo), write(folder, "device.csv", head, dev), write(folder, "file.csv", head[:4], fil),
             write(folder, "ins.csv", ["dataset", "scenario", "user", "start", "end"], [("4.2", 2, "u3", "01/19/2010 00:00:00", "01/21/2010 23:00:00")])]
    out = jobs.insider_job(spark, *paths, f"{folder}/out", trees=40, reps=0)
    board = {x["variant"]: x["roc_auc"] for x in out["leaderboard"].collect()}
    assert board["zsum"] > 0.95 and board["iforest"] > 0.9
    sweep = {x["budget"]: x for x in out["budget_sweep"].collect()}
    assert sweep[5]["users_found"] == sweep[5]["users_total"] == 1 and sweep[5]["userday_recall"] == 1.0
    assert out["budget_by_scenario"].filter("budget = 5").first()["found"] == 1
    assert out["budget_by_scenario"].select(F.max("total")).first()[0] == 1
