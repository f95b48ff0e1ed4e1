"""Readers on small hand-made files, sinks and lookups."""

import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import encode as E, joins as J, splits as S, userday as U
from wardline.sources import readers as R, tables as TB


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_payments(spark, folder):
    p = put(folder, "p.csv", ",".join(C.PAYMENTS.names) + "\n25,TRANSFER,100.5,C1,100.5,0.0,M2,0.0,90.0,1,0\n48,PAYMENT,10,C1,0,0,C3,5,15,0,0\n")
    df = X.balance_features(R.read_payments(spark, p))
    assert df.schema["isFraud"].dataType.simpleString() == "tinyint"
    a, b = df.orderBy("step").collect()
    assert (a["err_orig"], a["err_dest"], a["orig_emptied"], a["dest_zero_before"], a["amount_eq_oldorig"]) == (0.0, 10.5, 1, 1, 1)
    assert a["amt_ratio"] == pytest.approx(100.5 / 101.5) and b["frac_orig_moved"] == 5.0 and b["amt_ratio"] == 10.0
    h = df.orderBy("step").select(X.hour_from_step(F.col("step")), X.is_merchant(F.col("nameDest"))).collect()
    assert [tuple(r) for r in h] == [(1, 1), (0, 0)]


def test_card_tables(spark, folder):
    cols = ["TransactionID", "isFraud", "TransactionDT", *C.CARD_NUM, *C.CARD_CAT, "V1"]
    t = put(folder, "t.csv", ",".join(cols) + "\n" + ",".join(["1", "0", "86400"] + ["1.5"] * len(C.CARD_NUM) + ["W"] * len(C.CARD_CAT) + ["9"]) + "\n"
            + ",".join(["2", "1", "86500"] + [""] * len(C.CARD_NUM) + [""] * len(C.CARD_CAT) + ["9"]) + "\n")
    icols = ["TransactionID", *C.IDENTITY_NUM, *C.IDENTITY_CAT, "id_99"]
    i = put(folder, "i.csv", ",".join(icols) + "\n" + ",".join(["2"] + ["0.5"] * 5 + ["mobile", "SM-1", "Android 7.0", "chrome 63.0", "New", "F", "N"] + ["z"]) + "\n")
    tx, idn = R.read_card_txns(spark, t), R.read_card_identity(spark, i)
    assert "V1" not in tx.columns and "id_99" not in idn.columns
    idn = E.top_k_bucket(idn, "DeviceInfo", 100).withColumn("os", X.family(F.col("id_30"), lower=True))
    out = J.left_join_flag(tx, idn, "TransactionID", "has_identity").orderBy("TransactionID").collect()
    assert [r["has_identity"] for r in out] == [0, 1] and out[1]["os"] == "android" and out[1]["DeviceInfo_top"] == "SM-1"
    assert out[1]["TransactionAmt"] is None and out[0]["TransactionAmt"] == 1.5


def test_logins(spark, folder):
    head = " Login Timestamp ,User ID,Round-Trip Time [ms],Country,ASN,Browser Name and Version,OS Name and Version,Device Type,Login Successful,Is Attack IP,Is Account Takeover\n"
    rows = ["2020-02-03 12:43:30.772,1,10,NO,29695,Chrome 79.0,iOS 13.4,mobile,True,False,False", "bad,1,10,NO,1,Chrome,iOS,mobile,True,False,False",
            "2020-02-04 01:00:00,2,x,US,2,,,desktop,false,TRUE,1"]
    df = R.read_logins(spark, put(folder, "l.csv", head + "\n".join(rows) + "\n")).orderBy("ts")
    a, b = df.collect()
    assert (a["success"], a["attack_ip"], a["takeover"]) == (True, False, False) and (b["success"], b["attack_ip"], b["takeover"]) == (False, True, True)
    assert df.select(X.device_key(F.col("device_type"), F.col("browser_full"), F.col("os_full"))).collect()[1][0] == "desktop|unknown|unknown"
    r = S.rtt_feature(df, "rtt_ms", impute=True).collect()
    assert r[0]["rtt"] == r[1]["rtt"] and S.rtt_feature(df, "rtt_ms").collect()[1]["rtt"] is None
    assert S.login_population(df, "success").count() == 1 and S.login_population(df, "genuine").count() == 1


def test_keystrokes(spark, folder):
    df, feats = R.read_keystrokes(spark, put(folder, "k.csv", "subject,sessionIndex,rep,H.period,DD.period.t\ns1,1,1,0.1,0.2\n"))
    assert feats == ["H_period", "DD_period_t"] and df.first()["DD_period_t"] == 0.2


def test_activity_and_windows(spark, folder):
    log = put(folder, "logon.csv", "id,date,user,pc,activity\n{1},01/02/2010 05:59:59,u1,p1,Logon\n{2},01/02/2010 20:00:00,u1,p2,Logon\n{3},01/02/2010 08:00:00,u1,p2,Logoff\n{4},01/03/2010 09:00:00,u1,p2,Logon\n")
    win = put(folder, "ins.csv", "dataset,scenario,user,start,end\n4.2,1,u1,01/03/2010 01:00:00,01/05/2010 02:00:00\n5.1,2,u1,01/01/2010 01:00:00,02/05/2010 02:00:00\n4.2,2,u1,01/03/2010 00:00:00,01/04/2010 00:00:00\n")
    a = R.read_activity(spark, log, "logon").filter("activity = 'Logon'")
    ud = U.userday_logons(a).orderBy("day")
    r = ud.collect()
    assert [(x["n_logon"], x["n_off_logon"], x["n_pcs"], x["n_other_pc"]) for x in r] == [(2, 2, 2, 1), (1, 0, 1, 0)]
    w = R.read_windows(spark, win, "4.2")
    assert w.count() == 2
    lab = J.interval_label(ud, w).orderBy("day").collect()
    assert [x["y"] for x in lab] == [0, 1]  # two windows of one user do not duplicate the day


def test_modal_tie_takes_the_smaller_value(spark):
    df = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", "b"), ("u", "a"), ("v", "z")], "user string, pc string")
    assert {r["user"]: r["modal_pc"] for r in U.modal_value(df, "user", "pc").collect()} == {"u": "a", "v": "z"}


def test_manifest(spark, folder):
    os.mkdir(f"{folder}/data")
    put(f"{folder}/data", "a.txt", "hello")
    put(f"{folder}/data", "b.txt", "world")
    sums = spark.createDataFrame([("a.txt", hashlib.sha256(b"hello").hexdigest()), ("b.txt", "00"), ("c.txt", "00")], "file string, sha256 string")
    out = {r["file"]: r["status"] for r in R.verify_manifest(spark, f"{folder}/data", sums).collect()}
    assert out == {"a.txt": "ok", "b.txt": "mismatch", "c.txt": "missing"}


def test_reports_and_tables(spark, folder):
    m = spark.createDataFrame([("d1", "auc", 0.9), ("d1", "ap", 0.4), ("d2", "auc", 0.7)], "detector string, metric string, value double")
    TB.write_report(m, f"{folder}/r", ["detector"])
    docs = [json.loads(x[0]) for x in spark.read.text(f"{folder}/r").collect()]
    assert {d["detector"]: len(d["metrics"]) for d in docs} == {"d1": 2, "d2": 1}
    TB.write_leaderboard(m, f"{folder}/l")
    assert spark.read.csv(f"{folder}/l", header=True).count() == 3
    TB.save_table(m, f"{folder}/t", ["detector"])
    assert TB.load_table(spark, f"{folder}/t").exceptAll(m.select("metric", "value", "detector")).count() == 0
    assert [r[0] for r in TB.audit_tail(spark.range(100).toDF("seq"), 3).collect()] == [97, 98, 99]


def test_samples_and_caps(spark):
    df = spark.range(5000).select("id", (F.col("id") % 50 == 0).cast("int").alias("y"))
    s = S.stratified_sample(df, "y", 0.1, 1, "id")
    n = s.count()
    assert s.filter("y = 1").count() == 100 and 350 < n - 100 < 650
    assert S.stratified_sample(df.repartition(9), "y", 0.1, 1, "id").exceptAll(s).count() == 0
    c = S.cap_negatives(df, "y", 77, 1, "id")
    assert c.count() == 177 and c.exceptAll(S.cap_negatives(df.repartition(5), "y", 77, 1, "id")).count() == 0
    assert S.thin_negatives(df, "y", 0.0, 1, "id").count() == 100
    assert 0 < S.stratified_sample(df, "y", 0.1, 1).count() < 5000


def test_json_event_stream(spark, folder):
    os.mkdir(f"{folder}/in")
    ok = {"event_id": 1, "ts": "2024-01-01T00:00:00Z", "identity_id": "u", "event_type": "login", "channel": "api", "device_id": "d", "geo": "IN-GJ", "hour_of_day": 3}
    put(f"{folder}/in", "a.json", json.dumps(ok) + "\n{broken\n")
    raw = R.read_event_stream(spark, "json", {"path": f"{folder}/in"})
    good, bad = R.validate_events(raw)
    for name, df in (("good", good), ("bad", bad)):
        q = df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/c_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(f"{folder}/good").count() == 1 and spark.read.parquet(f"{folder}/bad").first()["problem"] == "malformed"
    with pytest.raises(ValueError):
        R.read_event_stream(spark, "nope", {})


def test_events_are_parsed_once(spark):
    ok = {"event_id": 1, "ts": "2024-01-01T00:00:00Z", "identity_id": "u", "event_type": "login", "channel": "api", "device_id": "d", "geo": "IN-GJ", "hour_of_day": 3}
    texts = [json.dumps(ok), json.dumps(ok | {"amount": None}), json.dumps(ok | {"amount": "much"}), json.dumps(ok | {"amount": {"a": 1}}), json.dumps(ok | {"ts": ""}),
             json.dumps(ok | {"hour_of_day": None}), json.dumps(ok | {"hour_of_day": 24}), "[1]", "", None, "{}", json.dumps(ok)[:-1] + ', "amount": 1, "amount": "x"}']
    good, bad = R.validate_events(spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("raw", F.regexp_replace("raw", "IN-GJ", "IN-MH")))
    for df in (good, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("regexp_replace(") == 1 and "get_json_object" not in plan
    assert good.count() == 3
    want = ["hour_of_day", "malformed", "malformed", "malformed", "missing_field", "missing_field"] + ["wrong_type"] * 3
    assert sorted(r["problem"] for r in bad.collect()) == want


def test_nonce_stream_drops_copies(spark, folder):
    from wardline.operators.tokens import nonce_stream

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "nonce string, t string") \
        .select("nonce", F.to_timestamp("t").alias("ts")).write.parquet(f"{folder}/n")
    src = spark.readStream.schema("nonce string, ts timestamp").parquet(f"{folder}/n")
    q = nonce_stream(src, "nonce", "ts").writeStream.format("parquet").option("path", f"{folder}/o").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(f"{folder}/o").select("nonce").collect()) == ["a", "b"]


def test_decisions_are_stored_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from wardline.sources import tables as TB

    path = str(tmp_path / "decisions")
    rows = lambda *r: spark.createDataFrame(list(r), "event_id long, ts string, decision string").withColumn("ts", F.to_timestamp("ts"))
    TB.append_new_decisions(rows((1, "2024-01-01", "ALLOW"), (2, None, "ALLOW"), (3, "2024-01-05", "BLOCK"), (3, "2024-01-04", "STEP_UP")), path, 4)
    TB.append_new_decisions(rows((1, "2024-01-02", "BLOCK"), (2, None, "ALLOW"), (4, "2024-01-02", "ALLOW"), (None, "2024-01-02", "ALLOW")), path, 4)
    TB.append_new_decisions(rows((4, "2023-01-01", "BLOCK")), path, 4)
    got = {r["event_id"]: r["decision"] for r in spark.read.parquet(path).collect()}
    assert got == {1: "ALLOW", 2: "ALLOW", 3: "STEP_UP", 4: "ALLOW"} and spark.read.parquet(path).count() == 4


def test_label_split_without_positives(spark):
    from wardline.operators import splits as S

    df = spark.createDataFrame([(1, 0), (2, 0)], "s long, y int").selectExpr("timestamp_seconds(s) as ts", "y")
    before, after, _ = S.split_label_quantile(df, "ts", "y")
    assert before.count() == 2 and after.count() == 0


def test_small_batches_do_not_read_the_store(spark, folder):
    """Ids are looked up through the files' key filters: rows read from the store stay far below its size, and resent ids are still found."""
    path = f"{folder}/store"
    ids = spark.range(200_000).select(F.xxhash64("id").alias("event_id"), F.current_timestamp().alias("ts"), F.lit("ALLOW").alias("decision"))
    for i in range(4):
        TB.append_new_decisions(ids.filter(F.pmod(F.hash("event_id"), F.lit(4)) == i), path)
    fresh = [r[0] for r in spark.range(10**9, 10**9 + 300).select(F.xxhash64("id")).collect()]

    def rows_read(wanted):
        df = TB.stored_ids(spark, path, "bigint", wanted)
        found = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan

        def scan(p):
            return p.metrics().apply("numOutputRows").value() if p.nodeName().startswith("Scan") else sum(scan(p.children().apply(i)) for i in range(p.children().size()))

        return found, scan(plan)

    assert rows_read(fresh) == (0, 0)
    known = [r[0] for r in ids.limit(2).collect()]
    found, read = rows_read(fresh[:20] + known)
    assert found == 2 and 0 < read < 200_000
    again = spark.createDataFrame([(i, None, "BLOCK") for i in known + fresh[:5]], "event_id long, ts timestamp, decision string")
    TB.append_new_decisions(again, path)
    back = spark.read.parquet(path)
    assert back.count() == 200_005 and back.filter("decision = 'BLOCK'").count() == 5
