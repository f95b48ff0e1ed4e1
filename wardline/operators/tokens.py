"""Signed-token checks, single-use nonces and idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import crypto as K, expr as X
from wardline.session import materialize

ASSERTION = "challenge_id string, identity_id string, method string, result string, issued_at double, nonce string, exp double"
ATTESTATION = "kind string, device_id string, verdict string, nonce string, issued_at double, exp double"
BEHAVIOR = "kind string, device_id string, identity_id string, similarity string, nonce string, issued_at double, exp double"
SKEW = 5.0


def nonce_status(df: DataFrame, nonce: str, ts: str, row_id: str, out: str = "replayed", where: Column | None = None) -> DataFrame:
    """0 for the first use of a nonce, 1 for every later one; rows outside ``where`` get null and use nothing.

    First uses come from a map-side-combined minimum, so one nonce repeated in a third of the rows is cheap.
    """
    used = F.col(nonce).isNotNull() & (where if where is not None else F.lit(True))
    # the condition sits inside the aggregate: as a filter it would be pushed below the token checks and
    # repeat their digests in every predicate
    first = df.groupBy(nonce).agg(F.min(F.when(used, F.struct(ts, row_id))).alias("_m")).filter("_m is not null")
    ids = first.select(F.col(f"_m.{row_id}").alias(row_id), F.lit(1).alias("_first"))
    flagged = df.join(ids, row_id, "left")
    return flagged.withColumn(out, F.when(used, 1 - F.coalesce(F.col("_first"), F.lit(0)))).drop("_first")


def nonce_stream(stream: DataFrame, nonce: str, ts: str, keep: str = "10 minutes") -> DataFrame:
    """Streaming single use: later copies within the retention time are dropped."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([nonce])


def idempotency_status(df: DataFrame, caller: str, key: str, fingerprint: str, ts: str, row_id: str) -> DataFrame:
    """``first`` for the first request of a (caller, key), ``replay`` for the same body, ``conflict`` otherwise.

    The first fingerprint per key is a combined minimum; requests join it back.
    """
    keyed = df.filter(F.col(key).isNotNull())
    body = F.struct(F.col(ts).alias("t"), F.col(row_id).alias("i"), F.col(fingerprint).alias("f"))
    first = keyed.groupBy(caller, key).agg(F.min(body).alias("_f"))
    status = F.when(F.col(row_id) == F.col("_f.i"), "first").when(F.col(fingerprint) == F.col("_f.f"), "replay").otherwise("conflict")
    judged = keyed.join(first, [caller, key]).withColumn("status", status).select(*df.columns, "status")
    # requests without a key never take part, so they are not shuffled
    return judged.unionByName(df.filter(F.col(key).isNull()).withColumn("status", F.lit("no_key")))


def assertion_status(df: DataFrame, key: bytes, now: Column, token: str = "token", identity: str = "identity_id",
                     ts: str = "ts", row_id: str = "row_id") -> DataFrame:
    """Verdict on each step-up assertion, tested in a fixed order; only a fully valid one consumes its nonce."""
    opened = K.open_token(df, token, key, ASSERTION, "_t")
    p = lambda n: F.col(f"_t_payload.{n}")
    missing = F.lit(False)
    for n in ("challenge_id", "identity_id", "method", "result", "issued_at", "nonce", "exp"):
        missing = missing | p(n).isNull()
    reason = (
        F.when(~F.col("_t_well_formed"), "malformed")
        .when(~F.col("_t_authentic"), "bad_signature")
        .when(missing, "malformed")
        .when(p("identity_id") != F.col(identity), "identity_mismatch")
        .when(now > p("exp"), "expired")
        .when(p("issued_at") > now + SKEW, "future")
    )
    # a few short columns per row are written once; the nonces' first uses and the statuses come from them, so no token is verified twice
    judged = materialize(opened.select(row_id, ts, reason.alias("_reason"), p("nonce").alias("_nonce"), p("result").alias("_result")))
    judged = nonce_status(judged, "_nonce", ts, row_id, "_replay", where=F.col("_reason").isNull())
    status = F.coalesce(F.col("_reason"), F.when(F.col("_replay") == 1, "replayed").otherwise("accepted"))
    judged = judged.select(row_id, status.alias("status"), F.when(status == "accepted", F.col("_result")).alias("result"))
    return df.drop("status", "result").join(judged, row_id)


def resolve_behavior(df: DataFrame, attest_key: bytes, behavior_key: bytes, now: Column, ts: str = "ts", row_id: str = "event_id") -> DataFrame:
    """Trusted ``similarity`` in [0, 1], or null (missing) whenever any check of either token fails.

    Each nonce is used up by the first event that passes every other check.
    """
    opened = K.open_token(K.open_token(df, "device_attestation", attest_key, ATTESTATION, "_a"), "behavior_assertion", behavior_key, BEHAVIOR, "_b")
    a, b = (lambda n: F.col(f"_a_payload.{n}")), (lambda n: F.col(f"_b_payload.{n}"))
    fresh = lambda t: (now <= t("exp")) & (t("issued_at") <= now + SKEW)
    sim = b("similarity").try_cast("double")
    finite = sim.isNotNull() & ~F.isnan(sim) & (F.abs(sim) != F.lit(float("inf")))
    ok = (
        (a("kind") == "device_attestation") & (b("kind") == "behavior_similarity") & fresh(a) & fresh(b) & (a("verdict") == "MEETS_DEVICE_INTEGRITY")
        & (a("device_id") == F.col("device_id")) & (b("device_id") == F.col("device_id")) & (b("identity_id") == F.col("identity_id"))
        & (F.length(a("nonce")) > 0) & (F.length(b("nonce")) > 0) & finite
    )
    # as in `assertion_status`: both tokens are verified once per row
    judged = materialize(opened.select(row_id, ts, F.coalesce(ok, F.lit(False)).alias("_ok"), a("nonce").alias("_an"), b("nonce").alias("_bn"),
                                       X.clip(sim, 0.0, 1.0).alias("_sim")))
    for nonce, out in (("_an", "_ar"), ("_bn", "_br")):
        judged = nonce_status(judged, nonce, ts, row_id, out, where=F.col("_ok"))
    used = F.col("_ok") & (F.col("_ar") == 0) & (F.col("_br") == 0)
    return df.drop("similarity").join(judged.select(row_id, F.when(used, F.col("_sim")).alias("similarity")), row_id)
