"""Digests, tokens, audit chains, the vault and private exports."""

import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import crypto as K, expr as X
from wardline.operators import audit as A, privacy as P, tokens as TK
from wardline.plans import fixtures as V

T0 = datetime(2024, 3, 1)
KEY = b"secret"


def test_hmac_matches_the_standard_library(spark):
    texts = ["", "a", "ü€", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"k", b"k" * 64, b"k" * 100):
        got = [r[0] for r in df.select(K.hmac_sha256(F.col("t"), key)).collect()]
        assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    with pytest.raises(ValueError):
        K.pseudonymize(F.col("t"), None)
    assert len(df.select(K.pseudonymize(F.col("t"), KEY)).first()[0]) == 24


def test_base64url_round_trip(spark):
    df = spark.createDataFrame([(bytes(range(n)),) for n in range(1, 12)], "b binary").select("b", K.b64url_encode(F.col("b")).alias("e"))
    assert df.filter("e like '%=%' or e like '%+%' or e like '%/%'").count() == 0
    assert df.filter(K.b64url_decode(F.col("e")) != F.col("b")).count() == 0


def tokens(spark, payloads, key=KEY):
    df = spark.createDataFrame([(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(payloads)], "row_id long, p string")
    return df.select("row_id", K.sign_token(F.col("p"), key).alias("token"))


def test_assertion_cases(spark):
    base = dict(challenge_id="c", identity_id="u1", method="otp_sms", result="pass", issued_at=100.0, nonce="n0", exp=220.0)
    cases = [base, base, base | {"nonce": "n2", "identity_id": "u2"}, base | {"nonce": "n3", "exp": 99.0}, base | {"nonce": "n4", "issued_at": 200.0},
             {k: v for k, v in base.items() if k != "method"}, base | {"nonce": "n6"}]
    df = tokens(spark, cases)
    forged = tokens(spark, [base | {"nonce": "n7"}], b"other").select(F.lit(7).cast("long").alias("row_id"), "token")
    seg = F.split("token", r"\.")
    swapped = df.filter("row_id = 6").select(F.lit(8).cast("long").alias("row_id"), F.concat(F.lit("A"), "token").alias("token"))
    junk = spark.createDataFrame([(9, "a.b.c"), (10, "nodots"), (11, None)], "row_id long, token string")
    every = df.unionByName(forged).unionByName(swapped).unionByName(junk).withColumns({"identity_id": F.lit("u1"), "ts": F.timestamp_seconds(F.col("row_id"))})
    out = {r["row_id"]: (r["status"], r["result"]) for r in TK.assertion_status(every, KEY, F.lit(110.0)).collect()}
    assert seg is not None
    assert out[0] == ("accepted", "pass") and out[1] == ("replayed", None) and out[2][0] == "identity_mismatch" and out[3][0] == "expired"
    assert out[4][0] == "future" and out[5][0] == "malformed" and out[6][0] == "accepted" and out[7][0] == "bad_signature"
    assert out[8][0] in ("bad_signature", "malformed") and {out[i][0] for i in (9, 10, 11)} == {"malformed"}


def test_rejected_tokens_do_not_use_up_a_nonce(spark):
    base = dict(challenge_id="c", identity_id="u1", method="m", result="pass", issued_at=100.0, nonce="n", exp=220.0)
    df = tokens(spark, [base | {"identity_id": "u2"}, base]).withColumns({"identity_id": F.lit("u1"), "ts": F.timestamp_seconds(F.col("row_id"))})
    out = {r["row_id"]: r["status"] for r in TK.assertion_status(df, KEY, F.lit(110.0)).collect()}
    assert out == {0: "identity_mismatch", 1: "accepted"}


def test_behavior_token_cases(spark):
    att = dict(kind="device_attestation", device_id="d1", verdict="MEETS_DEVICE_INTEGRITY", issued_at=100.0, exp=200.0)
    beh = dict(kind="behavior_similarity", device_id="d1", identity_id="u1", similarity=0.9, issued_at=100.0, exp=200.0)
    pairs = [(att, beh), (att | {"device_id": "d2"}, beh), (att | {"verdict": "NO"}, beh), (att, beh | {"similarity": "NaN"}), (att, beh | {"kind": "device_attestation"}),
             (att, beh | {"identity_id": "u2"}), (att | {"exp": 50.0}, beh), (att, beh | {"similarity": 7.5}), (att, beh | {"issued_at": 130.0}), (att, beh | {"similarity": "Infinity"})]
    a = tokens(spark, [p[0] | {"nonce": f"a{i}"} for i, p in enumerate(pairs)]).withColumnRenamed("token", "device_attestation")
    b = tokens(spark, [p[1] | {"nonce": f"b{i}"} for i, p in enumerate(pairs)]).withColumnRenamed("token", "behavior_assertion")
    df = a.join(b, "row_id").withColumnRenamed("row_id", "event_id")
    extra = df.filter("event_id = 0").withColumn("event_id", F.lit(50).cast("long"))  # replay of the good pair
    none = df.filter("event_id = 0").withColumns({"event_id": F.lit(51).cast("long"), "device_attestation": F.lit(None).cast("string")})
    df = df.unionByName(extra).unionByName(none).withColumns({"device_id": F.lit("d1"), "identity_id": F.lit("u1"), "ts": F.timestamp_seconds(F.col("event_id"))})
    out = {r["event_id"]: r["similarity"] for r in TK.resolve_behavior(df, KEY, KEY, F.lit(110.0)).collect()}
    assert out.pop(0) == 0.9 and out.pop(7) == 1.0 and set(out.values()) == {None}
    forged = TK.resolve_behavior(df, b"other", KEY, F.lit(110.0)).filter("similarity is not null")
    assert forged.count() == 0


def test_idempotency(spark):
    rows = [(1, "a", "k", "f1"), (2, "a", "k", "f1"), (3, "a", "k", "f2"), (4, "b", "k", "f2"), (5, "a", None, "f1")]
    df = spark.createDataFrame([(*r, T0 + timedelta(seconds=r[0])) for r in rows], "id long, caller string, key string, fp string, ts timestamp")
    out = {r["id"]: r["status"] for r in TK.idempotency_status(df, "caller", "key", "fp", "ts", "id").collect()}
    assert out == {1: "first", 2: "replay", 3: "conflict", 4: "first", 5: "no_key"}


def chain(spark, n=20, key=KEY):
    rows = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("shard"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("payload"))
    return A.append_chain(rows, key)


def verdicts(df, key=KEY):
    return {r["shard"]: (r["intact"], r["first_bad"]) for r in A.verify_chain(df, key).collect()}


def test_chain_intact_tampered_and_recomputed(spark):
    c = chain(spark).cache()
    assert verdicts(c) == {"s0": (1, None), "s1": (1, None)}
    edited = c.withColumn("payload", F.when((F.col("shard") == "s0") & (F.col("seq") == 2), "evil").otherwise(F.col("payload")))
    assert verdicts(edited) == {"s0": (0, 2), "s1": (1, None)}
    assert verdicts(c.filter("not (shard = 's1' and seq = 4)"))["s1"] == (0, 5)
    # an attacker without the key rebuilds every hash: links fit, the keyed digest does not
    payloads = edited.select("shard", F.timestamp_micros("ts_us").alias("ts"), F.col("seq").alias("row_id"), "payload")
    rebuilt = A.append_chain(payloads, b"guess")
    assert verdicts(rebuilt, None)["s0"] == (1, None) and verdicts(rebuilt)["s0"][0] == 0
    c.unpersist()


def test_checkpoint_catches_truncation_and_chains_continue(spark):
    c = chain(spark).cache()
    head = A.head_checkpoint(c, KEY).cache()
    ok = {r["shard"]: r["matches"] for r in A.verify_checkpoint(c, head, KEY).collect()}
    assert ok == {"s0": 1, "s1": 1}
    cut = c.filter("not (shard = 's0' and seq = 9)")
    assert {r["shard"]: r["matches"] for r in A.verify_checkpoint(cut, head, KEY).collect()} == {"s0": 0, "s1": 1}
    gone = c.filter("shard <> 's1'")
    assert {r["shard"]: r["matches"] for r in A.verify_checkpoint(gone, head, KEY).collect()} == {"s0": 1, "s1": 0}
    more = spark.range(20, 26).select(F.lit("s0").alias("shard"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), F.col("id").alias("row_id"), F.lit("x").alias("payload"))
    longer = c.unionByName(A.append_chain(more, KEY, head))
    assert verdicts(longer) == {"s0": (1, None), "s1": (1, None)} and longer.filter("shard = 's0'").count() == 16
    c.unpersist(), head.unpersist()


def test_vault_erasure_is_durable(spark, sf):
    from wardline.session import materialize

    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "identity_id string")
    keys = materialize(P.new_keys(ids))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "event_id long, identity_id string, payload string")
    stones = spark.createDataFrame([], "identity_id string")
    vault = P.vault_put(rows, keys, stones).cache()
    assert vault.select("pii_ref").distinct().count() == 3 and len(vault.first()["pii_ref"]) == 16
    left, stones = P.erase(keys, stones, ids.filter("identity_id = 'b'"))
    got = {r["identity_id"]: r["payload"] for r in P.vault_get(vault, left).collect()}
    assert got == {"a": "x", "b": None, "c": "z"}
    assert P.vault_put(rows, keys, stones).filter("identity_id = 'b'").count() == 0  # no resurrection
    assert P.reconsent(stones, ids.filter("identity_id = 'b'")).count() == 0
    old = keys.withColumn("created_ts", F.when(F.col("identity_id") == "a", F.lit(T0 - timedelta(days=366))).otherwise(F.lit(T0)))
    assert [r[0] for r in P.expire_keys(old, T0).select("identity_id").collect()] == ["a"]
    vault.unpersist()


def test_private_export(spark):
    n = 400
    means = spark.range(n).select(F.concat(F.lit("u"), "id").alias("identity_id"), *[F.lit(0.5).alias(c) for c in C.FEATURES],
                                  F.when(F.col("id") < 5, "tiny").otherwise("big").alias("cohort"))
    with pytest.raises(ValueError):
        P.dp_cohort_means(means, 0.0, KEY)
    rows = P.dp_cohort_means(means, 4.0, KEY).collect()
    assert [r["cohort"] for r in rows] == ["big"]
    vals = [rows[0][c] for c in C.FEATURES]
    assert all(0 <= v <= 1 for v in vals) and len({round(v, 6) for v in vals}) > 1 and any(abs(v - 0.5) > 1e-3 for v in vals)
    again = P.dp_cohort_means(means.repartition(7), 4.0, KEY).collect()
    assert [again[0][c] for c in C.FEATURES] == pytest.approx(vals)
    led = spark.createDataFrame([("d", 4.0, 1e-5)], "dataset string, noise_multiplier double, delta double")
    r = P.privacy_ledger(led).first()
    assert abs(r["mean_epsilon"] - 1.0126) < 1e-3 and abs(r["total_epsilon"] - 1.1126) < 1e-3
    bad = spark.createDataFrame([("d", 0.0, 1e-5)], "dataset string, noise_multiplier double, delta double")
    with pytest.raises(Exception, match="positive"):
        P.privacy_ledger(bad).collect()


def test_noise_has_the_right_spread(spark):
    d = spark.range(4000).select(P._gauss(KEY, F.col("id").cast("string")).alias("g"), X.laplace(P._uniform(KEY, F.col("id").cast("string")) - 0.5, 10.0).alias("l"))
    r = d.agg(F.avg("g"), F.stddev_pop("g"), F.avg("l"), F.stddev_pop("l")).first()
    assert abs(r[0]) < 0.06 and abs(r[1] - 1) < 0.05 and abs(r[2]) < 1.0 and abs(r[3] - 14.14) < 1.2


def test_template_similarity(spark):
    rows = [([100.0, 120.0, 90.0, 110.0], [101.0, 119.0, 91.0, 109.0]), ([100.0, 120.0, 90.0, 110.0], [300.0, 20.0, 400.0, 5.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.25])]
    df = spark.createDataFrame(rows, "t array<double>, o array<double>")
    got = [r[0] for r in df.select(X.template_similarity(F.col("t"), F.col("o"))).collect()]
    assert got[0] == pytest.approx(0.990476, abs=1e-6) and got[1:4] == [0.0, 0.0, 0.0] and got[4] == 0.75


def test_device_graph_counts(spark):
    from wardline.operators import history as H

    rows = [(i, T0 + timedelta(seconds=i), "dev", w) for i, w in enumerate(["i1", "i2", "i1"])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, device_id string, identity_id string")
    got = {r["event_id"]: r["identities_so_far"] for r in H.device_identity_count(df).collect()}
    assert got == {0: 1, 1: 2, 2: 2}
    assert H.identities_per_device(df).first()["identities"] == 2 and H.identities_per_device(df, True).first()["identities"] == 2
    assert V is not None


def test_releases_have_their_own_noise_and_a_name_works_once(spark, tmp_path):
    means = spark.range(400).select(F.concat(F.lit("u"), "id").alias("identity_id"), *[F.lit(0.5).alias(c) for c in C.FEATURES], F.lit("all").alias("cohort"))
    vals = {r: [P.dp_cohort_means(means.repartition(n), 4.0, KEY, release=r).first()[c] for c in C.FEATURES] for r, n in (("a", 1), ("b", 1), (None, 1))}
    assert vals["a"] == pytest.approx([P.dp_cohort_means(means.repartition(5), 4.0, KEY, release="a").first()[c] for c in C.FEATURES])
    assert all(abs(x - y) > 1e-9 for x, y in zip(vals["a"], vals["b"])) and vals["a"] != vals[None]
    path = str(tmp_path / "ledger")
    assert P.open_release(spark, path, "logins", "a", 4.0).count() == 1
    assert P.open_release(spark, path, "logins", "b", 2.0).count() == 2
    with pytest.raises(ValueError, match="already"):
        P.open_release(spark, path, "logins", "a", 8.0)
    for bad in (("logins", "../x", 4.0), ("logins", "c", 0.0)):
        with pytest.raises(ValueError):
            P.open_release(spark, path, *bad)
    assert {r["dataset"]: r["releases"] for r in P.privacy_ledger(P.open_release(spark, path, "pay", "a", 4.0)).collect()} == {"logins": 2, "pay": 1}


def test_row_ids_tell_nulls_by_place(spark):
    rows = [(None, "a"), ("a", None), ("a", None), (None, None), (None, "a"), ("x", "y")]
    df = spark.createDataFrame(rows, "p string, q string")
    by = lambda d: sorted((r["p"] or "-", r["q"] or "-", r["row_id"]) for r in X.with_row_id(d).collect())
    got = by(df)
    assert len({r[2] for r in got}) == 6
    assert by(df.repartition(5)) == got and by(df.orderBy(F.desc("q")).coalesce(1)) == got


def test_busy_days_have_more_chains_and_heads_show_what_is_missing(spark):
    rows = spark.range(900).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("payload"),
                                   F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") < 800, F.col("id")).otherwise(86_400 * (F.col("id") - 798))).alias("ts"))
    dealt = A.sharded(rows, per_chain=100)
    by_day = {r["d"]: r["n"] for r in dealt.groupBy(F.substring("shard", 1, 10).alias("d")).agg(F.count_distinct("shard").alias("n")).collect()}
    assert sorted(by_day.values()) == [1] * 100 + [8] and dealt.columns == ["row_id", "payload", "ts", "shard"]
    chain = A.append_chain(dealt, KEY).cache()
    assert all(r["intact"] for r in A.verify_chain(chain, KEY).collect())
    heads = A.chain_of_heads(chain, KEY)
    assert heads.count() == 108 and A.verify_chain(heads, KEY).first()["intact"] == 1
    end = A.head_checkpoint(heads, KEY).first()["checkpoint"]
    lost = chain.filter(F.col("shard") != chain.first()["shard"])
    assert A.head_checkpoint(A.chain_of_heads(lost, KEY), KEY).first()["checkpoint"] != end
    assert A.head_checkpoint(A.chain_of_heads(chain.repartition(3), KEY), KEY).first()["checkpoint"] == end
    chain.unpersist()
