"""The streaming trust job end to end, and its stages: equal to batch, restarted, replayed, and with state that expires."""

import json
import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import audit as A, tokens as TK
from wardline.plans import fixtures as V
from wardline.streaming import fold as T, job as J, stages as S, trust as TR

T0 = datetime(2024, 3, 1)
KEY = b"test key"
PARAMS = T.Params(require_model=False)
COLS = ["event_id", "trust", "decision", "risk_band", "round(event_risk, 9) as r", "device_sharing"]


def arrive(folder, number, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-{number}.json", "w") as f:
        f.write("".join(x + "\n" for x in lines))
    os.utime(f"{folder}/part-{number}.json", (1_700_000_000 + number, 1_700_000_000 + number))  # read in this order


def as_json(df):
    return [r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()]


def finish(queries):
    for q in queries:
        assert q.awaitTermination(300)


@pytest.fixture(scope="module")
def table(spark, sf):
    events = V.identity_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("idempotency_key", F.lit(None).cast("string")).cache()


def test_job_equals_batch_over_restarts_and_a_repeated_batch(spark, table, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    days = [r[0] for r in table.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    part = lambda a, b: table.filter(F.to_date("ts").isin(days[a:b]))
    settled = spark.createDataFrame(
        [(r["identity_id"], r["ts"] + timedelta(seconds=1), i % 2 == 0) for i, r in enumerate(part(0, 20).orderBy("event_id").limit(40).collect())], "identity_id string, ts timestamp, passed boolean")
    settled.coalesce(1).write.parquet(str(tmp_path / "outcomes"))

    def run():
        outcomes = spark.readStream.schema(settled.schema).parquet(str(tmp_path / "outcomes"))
        finish(J.start(spark, home, "json", {"path": src, "maxFilesPerTrigger": "1"}, outcomes, KEY, 4, True, params=PARAMS, lateness="60 days"))
        return spark.read.parquet(f"{home}/decisions")

    junk = ["{oops", json.dumps({"event_id": 1}), as_json(table.limit(1))[0].replace("hour_of_day\":", "hour_of_day\":9")]
    for i, (a, b) in enumerate([(0, 8), (8, 16)]):
        arrive(src, i, as_json(part(a, b)) + junk)
    run()
    arrive(src, 2, as_json(part(16, len(days))))
    got = run()  # a new query over the same home: state, chains and progress go on
    want = TR.trust_decisions(table, settled, params=PARAMS)
    assert got.count() == table.count() and got.selectExpr(*COLS).exceptAll(want.selectExpr(*COLS)).count() == 0
    assert spark.read.parquet(f"{home}/quarantine").groupBy("problem").count().count() >= 2 and spark.read.parquet(f"{home}/quarantine").count() >= 5

    records = J.chain(spark, home)
    verdict = A.verify_chain(records, KEY).collect()
    assert sum(r["n"] for r in verdict) == table.count() and all(r["intact"] == 1 for r in verdict)
    last = max(int(x) for x in os.listdir(f"{home}/progress/answers/commits") if x.isdigit())
    before = sorted(map(tuple, records.collect()))
    heads = sorted(map(tuple, J.heads_before(spark, f"{home}/heads", last + 1).collect()))
    assert {(h[0], h[1]) for h in heads} == {(r["shard"], r["n"]) for r in verdict}
    for name in (str(last), f".{last}.crc"):  # as if the driver had died after the sink and before the commit
        if os.path.exists(f"{home}/progress/answers/commits/{name}"):
            os.unlink(f"{home}/progress/answers/commits/{name}")
    again = run()
    assert again.count() == table.count() and sorted(map(tuple, J.chain(spark, home).collect())) == before
    assert sorted(map(tuple, J.heads_before(spark, f"{home}/heads", last + 1).collect())) == heads


def test_replays_get_the_stored_result_and_conflicts_none(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "home")

    def event(i, minutes, key=None, amount=None, who="u1", device="d1"):
        return json.dumps({"event_id": i, "ts": (T0 + timedelta(minutes=minutes)).isoformat() + "Z", "identity_id": who, "event_type": "transaction", "channel": "api", "device_id": device,
                           "geo": "IN-GJ", "hour_of_day": 10, "amount": amount, "idempotency_key": key})

    # key k: scored, the same again in the same file; then events that lower the trust; then the same again and another body
    arrive(src, 0, [event(1, 0, "k", 50.0), event(2, 0, "k", 50.0), event(3, 1), event(4, 1, None, 9e5, device="d9")])
    arrive(src, 1, [event(5, 0, "k", 50.0), event(6, 0, "k", 51.0), event(7, 0, "k", 50.0, "u2"), event(8, 3, "other", 1.0)])
    # two days later the key is free; the profile's stored results have gone by the batch after
    arrive(src, 2, [event(9, 2 * 1440, "k", 77.0)])
    arrive(src, 3, [event(10, 2 * 1440, "k", 77.0), event(11, 4 * 1440, "late key", 1.0)])
    finish(J.start(spark, home, "json", {"path": src, "maxFilesPerTrigger": "1"}, None, KEY, 2, True, params=PARAMS, lateness="30 days", keep=86_400.0))
    rows = {r["event_id"]: r for r in spark.read.parquet(f"{home}/answers").collect()}
    kinds = {i: r["request"] for i, r in rows.items()}
    assert kinds == {1: "scored", 2: "replay", 3: "scored", 4: "scored", 5: "replay", 6: "conflict", 7: "conflict", 8: "scored", 9: "scored", 10: "replay", 11: "scored"}
    same = ["trust", "decision", "risk_band", "step_up_method", "event_risk", "device_sharing", "events_seen", "amount"]
    for again, first in ((2, 1), (5, 1), (10, 9)):
        assert [rows[again][c] for c in same] == [rows[first][c] for c in same]
    assert rows[4]["trust"] != rows[1]["trust"] and rows[6]["decision"] is None and rows[7]["trust"] is None
    stored = spark.read.parquet(f"{home}/decisions")
    assert sorted(r["event_id"] for r in stored.collect()) == [1, 3, 4, 8, 9, 11]
    assert sum(r["n"] for r in A.verify_chain(J.chain(spark, home), KEY).collect()) == 6


def stream_of(spark, tmp_path, frame, lots):
    """A stream over one file per lot of rows, in order."""
    for i, lot in enumerate(lots):
        path = f"{tmp_path}/in/part-{i}.parquet"
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        pd.DataFrame(lot, columns=frame.columns).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_nonce_is_kept_until_its_own_expiry(spark, tmp_path):
    """Short and long expiries, reuse inside a file, across files, at the expiry itself and after it; freed state leaves the store."""
    frame = spark.createDataFrame([], "id long, nonce string, ts timestamp, at double, exp double")
    base = T0.timestamp() + 0.0

    def row(i, nonce, at, life):
        return (i, nonce, datetime.fromtimestamp(base + at), base + at, base + at + life)

    lots = [
        [row(1, "short", 0, 60), row(2, "long", 0, 5000), row(3, "short", 30, 60), row(4, "dead", 1, -1)],
        [row(5, "short", 60, 60), row(6, "dead", 10, 50), row(7, "long", 100, 10)],
        [row(8, "short", 61, 60), row(9, "long", 4999, 1), row(10, "x", 200, 1)],
        [row(11, "long", 5001, 60), row(12, "short", 4000, 60)],
        [row(13, "y", 90_000, 1)], [row(14, "z", 90_001, 1)],
    ]
    src = stream_of(spark, tmp_path, frame, lots).withWatermark("ts", "1000 seconds")
    q = S.nonce_stage(src, "nonce", "ts", "at", "exp", "id").writeStream.format("parquet").option("path", f"{tmp_path}/o") \
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = {r["id"]: r["replayed"] for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0, 9: 1, 10: 0, 11: 0, 12: 0, 13: 0, 14: 0}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] < max(kept)


def test_stages_alone_equal_their_batch_forms(spark, tmp_path):
    """Requests without repeats after expiry: the stage and the batch status agree; a free key counts anew only in the stage."""
    frame = spark.createDataFrame([], "id long, caller string, key string, body string, ts timestamp, at double")
    rows = [(i, f"c{i % 2}", f"k{i % 5}", f"b{i % 3 if i % 7 else 9}", T0 + timedelta(seconds=i), T0.timestamp() + i) for i in range(60)]
    src = stream_of(spark, tmp_path, frame, [rows[:25], rows[25:40], rows[40:]]).withWatermark("ts", "1 hour")
    q = S.request_stage(src, "caller", "key", "body", "ts", "at", "id", 3600.0).writeStream.format("parquet").option("path", f"{tmp_path}/o") \
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = {r["id"]: r["request"] for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    batch = TK.idempotency_status(spark.createDataFrame(rows, frame.schema), "caller", "key", "body", "ts", "id")
    assert got == {r["id"]: r["status"] for r in batch.collect()} and set(got.values()) == {"first", "replay", "conflict"}
