"""Batch and streaming trust decisions around the shared fold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import history as H, ordered as O
from wardline.streaming import fold as T, lockstep
from wardline.streaming.keyed import keyed_fold
from wardline.streaming.stages import device_stage, trust_stream  # noqa: F401  the streaming forms, beside the batch ones

FOLD_INPUT = [
    "event_id", "identity_id", "ts", "kind", "passed", "event_type", "device_id", "geo", "hour_of_day", "amount", "ml_risk",
    "ts_seconds", "prior_ok", "static_risk", *T.PASSED,
]


def _timestamped(df: DataFrame) -> DataFrame:
    """``ts`` as a timestamp; a column that is one stays as it is and keeps its watermark."""
    return df if dict(df.dtypes)["ts"] == "timestamp" else df.withColumn("ts", F.col("ts").cast("timestamp"))


def prepare(events: DataFrame, similarity: str | None = None, ml_risk: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Everything about an event that no earlier decision can change (needs ``device_sharing``); columns of ``keep`` are handed on."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = _timestamped(events).withColumns({
        "behavior_anomaly": F.coalesce(1 - F.col(similarity), F.lit(C.NEUTRAL_BEHAVIOR)) if similarity else F.lit(C.NEUTRAL_BEHAVIOR),
        "event_criticality": X.criticality(F.col("event_type")),
        "channel_risk": X.channel_risk(F.col("channel")),
        "new_beneficiary": flag("is_new_beneficiary").cast("double"),
        "recovery_change": flag("recovery_contact_changed").cast("double"),
        "prior_ok": X.cold_prior_applies(F.col("event_type"), F.col("channel"), flag("is_new_beneficiary"), flag("recovery_contact_changed"), F.col("amount")),
        "ml_risk": F.col(ml_risk).cast("double") if ml_risk else F.lit(None).cast("double"),
        "kind": F.lit(1),
        "passed": F.lit(None).cast("boolean"),
    })
    static = F.lit(0.0)
    for c in T.PASSED:
        static = static + F.lit(C.WEIGHTS[c]) * F.col(c)
    df = df.withColumns({"static_risk": static, "ts_seconds": X.micros("ts") / 1e6, "amount": F.col("amount").cast("double")})
    return df.select(*FOLD_INPUT, *keep)


def outcome_rows(outcomes: DataFrame, like: DataFrame) -> DataFrame:
    """Step-up outcomes (identity_id, ts, passed) in the fold's input shape; same-time events come first."""
    have = _timestamped(outcomes).select("identity_id", "ts", "passed")
    have = have.withColumns({"kind": F.lit(2), "ts_seconds": X.micros("ts") / 1e6})
    zero = {"event_id", "hour_of_day", "prior_ok"}  # kept non-null so that whole batches keep their integer types
    have = have.withColumns({f.name: F.lit(0 if f.name in zero else None).cast(f.dataType) for f in like.schema if f.name not in have.columns})
    return have.select(*like.columns)


def trust_decisions(events: DataFrame, outcomes: DataFrame | None = None, similarity: str | None = None,
                    ml_risk: str | None = None, params: T.Params = T.Params(), hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """One decision per event, folding each identity in event time.

    A decision depends on the decisions before it, so one identity is one sequence; a task folds many of them in lockstep. A hot identity runs in time slices that hand the profile on. Device
    sharing, which crosses identities, is computed up front.
    """
    rows = prepare(H.device_sharing(events), similarity, ml_risk)
    if outcomes is not None:
        rows = rows.unionByName(outcome_rows(outcomes, rows))

    def step(state: T.State, row):
        if row.kind == 2:
            T.settle(state, bool(row.passed))
            return None
        return T.advance(state, row, params)

    return keyed_fold(
        rows, "identity_id", ["ts", "kind", "event_id"], T.State, step, T.RESULT, position=F.col("ts_seconds"), dump=T.State.dump,
        load=T.State.load, hot_rows=hot_rows, many=lockstep.runner(params), probe_on=events.select("identity_id", (X.micros("ts") / 1e6).alias("ts_seconds")),
    )


def explain(decisions: DataFrame) -> DataFrame:
    """Reasons, contributions, attribution and counterfactual of every decision (native expressions)."""
    contrib, attr = X.contributions(), X.attribution()
    none = F.array().cast("array<string>")
    extra = F.concat(
        F.when(F.col("drift_review"), F.array(F.lit(C.DRIFT_REASON))).otherwise(none),
        F.when(F.col("impossible"), F.array(F.lit(C.TRAVEL_REASON))).otherwise(none),
    )
    return decisions.withColumns({
        "reason_codes": F.concat(extra, X.reasons(contrib)),
        "feature_contributions": F.slice(contrib, 1, 5),
        "attribution": attr,
        "counterfactual": X.counterfactual(attr, F.col("amount"), F.col("amount_mean")),
    })


# ---- views of decisions ------------------------------------------------------------
def identity_snapshot(decisions: DataFrame) -> DataFrame:
    """Latest trust, known devices and allowed events per identity."""
    last = F.max_by(F.struct("trust", "known_devices", "events_seen"), F.struct("ts", "event_id"))
    return decisions.filter("decision <> 'LATE'").groupBy("identity_id").agg(last.alias("s")).select("identity_id", "s.*")


def to_client(decisions: DataFrame) -> DataFrame:
    """What a client may see: decision, method only for a challenge, a fixed message; no detector internals."""
    text = F.create_map(*[F.lit(x) for kv in C.CLIENT_MESSAGE.items() for x in kv])
    challenged = F.col("decision") == "STEP_UP"
    challenge = F.substring(F.sha2(F.concat_ws("|", F.lit("challenge"), F.col("event_id").cast("string")), 256), 1, 12)
    return decisions.select(
        "event_id", "decision", F.when(challenged, F.col("step_up_method")).alias("step_up_method"),
        F.when(challenged, challenge).alias("challenge_id"), F.try_element_at(text, F.col("decision")).alias("message"),
    )


def to_audit_payload(explained: DataFrame) -> DataFrame:
    """Canonical JSON of the full decision (fields in sorted order, rounded numbers)."""
    pairs = lambda c, v: F.transform(F.col(c), lambda x: F.array(F.round(x[v], 4).cast("string"), x["name"]))
    body = explained.select(
        "event_id", "identity_id", "ts",
        F.lit("assessment").alias("type"), F.col("trust").alias("trust_score"), "risk_band", "decision",
        F.col("reason_codes").alias("reasons"), pairs("feature_contributions", "value").alias("feature_contributions"),
        pairs("attribution", "phi").alias("shap_values"), "counterfactual", "ml_risk",
        F.round("det_risk", 4).alias("det_risk"), F.round("event_risk", 4).alias("event_risk"), "degraded",
    )
    fields = [c for c in body.columns if c != "ts"]
    return body.select("event_id", "ts", X.canonical_json(*fields).alias("payload"))


def step_up_limits(attempts: DataFrame, window: float = 300.0, max_failures: int = 20, max_accepted: int = 5,
                   hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """Status of each step-up attempt (attempt_id, identity_id, ts, valid).

    20 failures inside the window refuse everything; only accepted attempts use up the accepted budget, so
    garbage cannot lock an identity out. Whether an attempt counts depends on earlier refusals.
    """
    src = attempts.select("attempt_id", "identity_id", "ts", "valid", (X.micros("ts") / 1e6).alias("t"))

    def step(state: dict, row):
        for k in ("bad", "good"):
            state[k] = [x for x in state[k] if row.t - x < window]
        if len(state["bad"]) >= max_failures:
            status = "refused_failures"
        elif not row.valid:
            state["bad"].append(row.t)
            status = "rejected"
        elif len(state["good"]) >= max_accepted:
            status = "refused_accepted"
        else:
            state["good"].append(row.t)
            status = "accepted"
        return row.attempt_id, row.identity_id, status

    return keyed_fold(src, "identity_id", ["t", "attempt_id"], lambda: {"bad": [], "good": []}, step,
                      "attempt_id long, identity_id string, status string", position=F.col("t"), dump=json.dumps, load=json.loads, hot_rows=hot_rows)
