"""Queries that force the sliced paths with a small ``hot_rows``, against the SQL of the plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import drift, history as H, metrics as M
from wardline.plans import fixtures as V
from wardline.plans import q_history, q_metrics, q_trust  # noqa: F401  (their SQL is reused)
from wardline.plans.q_history import _R, _risk
from wardline.plans.q_metrics import curve_sql
from wardline.plans.registry import QUERIES, query
from wardline.streaming import fold, trust as TR

HOT = 30


def _like(name: str) -> str:
    return QUERIES[name].sql


_MISSING_SQL = V.SQL_VARIANTS.replace("variants as (", "all_variants as (") + """,
variants as (select * replace (case when row_id % 50 < 2 then cast('-infinity' as double) else score end as score) from all_variants)"""


@query(
    "roc_curve_missing", "K1,E15",
    f"with {_MISSING_SQL}, {curve_sql()} select variant, greatest(threshold, -1.0) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, "
    "round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(caught, 2) as caught from curve",
)
def roc_curve_missing(spark, sf):
    """Null and NaN scores rank last, here on the sliced path."""
    i = F.col("row_id") % 50
    s = V.score_variants(spark, sf).withColumn("score", F.when(i == 1, F.lit(float("nan"))).when(i > 1, F.col("score")))
    c = M.roc_curve(s, ["variant"], amount="amount", hot_rows=100)
    return c.select("variant", F.greatest("threshold", F.lit(-1.0)).alias("threshold"), "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"),
                    F.round("caught", 2).alias("caught"))


@query("causal_index_sliced", "E1", _like("causal_index"))
def causal_index_sliced(spark, sf):
    p = V.payments(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("step") * 3600))
    p = H.causal_index(p, "nameOrig", "ts", "row_id", "orig_txn_idx", hot_rows=HOT)
    return H.causal_index(p, "nameDest", "ts", "row_id", "dest_in_deg", hot_rows=HOT).select("row_id", "orig_txn_idx", "dest_in_deg")


@query("device_identity_count_sliced", "E11", _like("device_identity_count"))
def device_identity_count_sliced(spark, sf):
    return H.device_identity_count(V.identity_events(spark, sf), hot_rows=HOT).select("event_id", "identities_so_far")


@query("trailing_rate_sliced", "E16", _like("trailing_rate"))
def trailing_rate_sliced(spark, sf):
    return H.trailing_count(V.table(spark, sf, "events"), "user_id", "ts", 300, hot_rows=HOT).select("event_id", "n_recent")


@query("replay_features_sliced", "E7-E11,J15", _like("replay_features"))
def replay_features_sliced(spark, sf):
    f = H.replay_features(V.identity_events(spark, sf), hot_rows=HOT, block=256)
    return f.select("event_id", "identity_id", *[_R(c) for c in C.FEATURES])


@query("drift_cusum_sliced", "E12,E13", _like("drift_cusum"))
def drift_cusum_sliced(spark, sf):
    d = drift.risk_cusum(_risk(spark, sf), ["user_id"], ["ts", "event_id"], X.micros("ts"), hot_rows=HOT)
    return d.select("event_id", _R("ewma"), _R("cusum"), "cusum_fired")


@query("trust_decisions_sliced", "I1", _like("trust_decisions"))
def trust_decisions_sliced(spark, sf):
    d = TR.trust_decisions(V.identity_events(spark, sf), params=fold.Params(require_model=False), hot_rows=40)
    return d.select("event_id", "identity_id", "trust", "risk_band", "decision", F.coalesce("step_up_method", F.lit("none")).alias("step_up_method"),
                    F.floor(F.col("event_risk") * 1e6 + 0.3).alias("event_risk_ppm"), "impossible", "drift_review", "events_seen", "known_devices")
