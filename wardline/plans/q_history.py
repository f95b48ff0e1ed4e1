"""Causal history, travel, drift and rate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import drift, history as H, joins as J
from wardline.plans import fixtures as V
from wardline.plans.registry import query

_R = lambda c: F.round(F.col(c), 6).alias(c)

SQL_REPLAY = V.SQL_EVENTS + """,
h as (
  select *, row_number() over w - 1 as n,
    row_number() over (partition by identity_id, device_id order by ts, event_id) as rd,
    row_number() over (partition by identity_id, geo order by ts, event_id) as rg,
    list(hour_of_day) over (partition by identity_id order by ts, event_id rows between 200 preceding and 1 preceding) as hours,
    row_number() over (partition by device_id, identity_id order by ts, event_id) as ri
  from identity_events window w as (partition by identity_id order by ts, event_id)),
z as (
  select event_id, count(*) over w as an, avg(amount) over w as am, stddev_pop(amount) over w as sd
  from identity_events where amount is not null
  window w as (partition by identity_id order by ts, event_id rows between 200 preceding and 1 preceding)),
s as (
  select event_id, sum(cast(ri = 1 as int)) over (partition by device_id order by ts, event_id) as c from h),
features as (
  select h.event_id, h.ts, identity_id, event_type, channel, device_id, geo, amount, is_new_beneficiary, recovery_contact_changed, n,
    case when n = 0 then 0.4 when rd = 1 then 1.0 else 0.0 end as new_device,
    case when n = 0 then 0.5 when rg = 1 then 1.0 else 0.0 end as new_geo,
    case when n = 0 then 0.5 else list_min(list_transform(hours, lambda x: least(abs(hour_of_day - x), 24 - abs(hour_of_day - x)))) / 12.0 end as hour_deviation,
    case when amount is null then 0.0 when an < 5 then least(amount / 100000, 1.0)
         else least(abs(amount - am) / (3 * greatest(sd, 1.0)), 1.0) end as amount_zscore,
    0.5 as behavior_anomaly,
    case event_type when 'login' then 0.2 when 'transaction' then 0.4 when 'profile_change' then 0.5
      when 'onboarding' then 0.6 when 'account_recovery' then 0.8 when 'privileged_access' then 0.9 end as event_criticality,
    case channel when 'branch' then 0.1 when 'mobile_app' then 0.3 when 'internet_banking' then 0.4
      when 'api' then 0.5 when 'admin_console' then 0.7 end as channel_risk,
    cast(is_new_beneficiary as double) as new_beneficiary,
    cast(recovery_contact_changed as double) as recovery_change,
    least(2.0 * (1 - power(cast(0.5 as double), n + 1)) / 15.0, 1.0) as velocity,
    least((c - 1) / 3.0, 1.0) as device_sharing
  from h left join z using (event_id) join s using (event_id)),
risked as (
  select *, least(greatest(0.14*new_device + 0.10*new_geo + 0.05*hour_deviation + 0.11*amount_zscore + 0.15*behavior_anomaly
    + 0.07*event_criticality + 0.04*channel_risk + 0.08*new_beneficiary + 0.12*recovery_change + 0.04*velocity
    + 0.10*device_sharing, 0.0), 1.0) as det_risk from features)"""

_FEATURE_SQL = ", ".join(f"round({f}, 6) as {f}" for f in C.FEATURES)


@query("replay_features", "E7-E11,J15,L1", f"with {SQL_REPLAY} select event_id, identity_id, {_FEATURE_SQL} from features")
def replay_features(spark, sf):
    return H.replay_features(V.identity_events(spark, sf)).select("event_id", "identity_id", *[_R(f) for f in C.FEATURES])


def risked(spark, sf):
    return H.replay_features(V.identity_events(spark, sf)).withColumn("det_risk", X.det_risk())


@query(
    "risk_bands", "L2,L3,L6,L7,L8",
    f"""with {SQL_REPLAY}, bands as (
      select event_type, det_risk, case when det_risk < 0.45 then 'LOW' when det_risk < 0.65 then 'ELEVATED' else 'HIGH' end as band from risked),
    d as (select *, case when band = 'LOW' then 'ALLOW' else 'STEP_UP' end as decision,
      case when band = 'LOW' then null when event_type in ('account_recovery', 'onboarding') then 'video_kyc'
           when band = 'HIGH' then 'otp_sms' else 'device_biometric' end as method from bands)
    select event_type, band, decision, coalesce(method, 'none') as method, count(*) as events, round(avg(det_risk), 6) as mean_risk
    from d group by all""",
)
def risk_bands(spark, sf):
    """Flagship: features, deterministic risk, band and decision at the start score."""
    r = risked(spark, sf).withColumn("event_risk", X.blend(F.lit(None).cast("double"), F.col("det_risk")))
    r = r.withColumn("band", X.risk_band(F.lit(C.START_TRUST), F.col("event_risk")))
    r = r.withColumn("decision", X.decision(F.col("band"), F.col("event_type")))
    r = r.withColumn("method", F.coalesce(X.step_up_method(F.col("band"), F.col("event_type")), F.lit("none")))
    return r.groupBy("event_type", "band", "decision", "method").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg("det_risk"), 6).alias("mean_risk")
    )


@query(
    "cold_prior", "L4",
    f"""with {SQL_REPLAY} select event_id,
      round(new_device * f, 6) as new_device, round(new_geo * f, 6) as new_geo from (
      select *, case when n = 0 and event_type in ('login', 'transaction') and channel in ('mobile_app', 'internet_banking', 'branch')
        and not is_new_beneficiary and not recovery_contact_changed and (amount is null or amount < 25000) then 0.5 else 1.0 end as f
      from features) where n = 0""",
)
def cold_prior(spark, sf):
    f = H.cold_prior(H.replay_features(V.identity_events(spark, sf)))
    return f.filter("n = 0").select("event_id", _R("new_device"), _R("new_geo"))


_CONTRIB_SQL = "[" + ", ".join(f"{{'v': {w} * {n}, 'n': '{n}'}}" for n, w in C.WEIGHTS.items()) + "]"
_TEXT_SQL = "case x.n " + " ".join(f"when '{k}' then '{t}'" for k, t in C.REASON_TEXT.items()) + " end"


@query(
    "reasons", "F3",
    f"""with {SQL_REPLAY}, c as (select event_id, list_sort({_CONTRIB_SQL}, 'DESC') as contrib from features),
    r as (select event_id, contrib, list_filter(contrib[1:3], lambda x: x.v > 0.05) as top from c)
    select event_id, case when len(top) = 0 then '{C.NORMAL_REASON}'
      else array_to_string(list_transform(top, lambda x: {_TEXT_SQL}), '; ') end as reasons,
      array_to_string(list_transform(contrib[1:5], lambda x: x.n), ',') as top_features from r""",
)
def reasons(spark, sf):
    f = H.replay_features(V.identity_events(spark, sf)).withColumn("_c", X.contributions())
    return f.select(
        "event_id", F.array_join(X.reasons(F.col("_c")), "; ").alias("reasons"),
        F.array_join(F.transform(F.slice("_c", 1, 5), lambda x: x["name"]), ",").alias("top_features"),
    )


_PHI_SQL = "[" + ", ".join(
    f"{{'m': -abs(round({w} * ({n} - {C.BASELINE[n]}), 4)), 'i': {i}, 'p': round({w} * ({n} - {C.BASELINE[n]}), 4), 'n': '{n}'}}"
    for i, (n, w) in enumerate(C.WEIGHTS.items())
) + "]"


@query(
    "attribution", "L11",
    f"""with {SQL_REPLAY}, a as (select event_id, list_sort({_PHI_SQL}) as a from features)
    select event_id, a[1].n as top_feature, a[1].p as top_phi, a[2].n as second_feature,
      array_to_string(list_transform(a, lambda x: x.n), ',') as ranking from a""",
)
def attribution(spark, sf):
    f = H.replay_features(V.identity_events(spark, sf)).withColumn("_a", X.attribution())
    return f.select(
        "event_id", F.col("_a")[0]["name"].alias("top_feature"), F.col("_a")[0]["phi"].alias("top_phi"),
        F.col("_a")[1]["name"].alias("second_feature"),
        F.array_join(F.transform("_a", lambda x: x["name"]), ",").alias("ranking"),
    )


@query(
    "mean_abs_attribution", "D16,F6",
    f"""with {SQL_REPLAY}, l as (""" + " union all ".join(
        f"select '{n}' as feature, abs(round({w} * ({n} - {C.BASELINE[n]}), 4)) as phi from features" for n, w in C.WEIGHTS.items()
    ) + """), m as (select feature, avg(phi) as mean_abs from l group by 1)
    select feature, round(mean_abs, 8) as mean_abs, row_number() over (order by mean_abs desc, feature) as rank from m""",
)
def mean_abs_attribution(spark, sf):
    from wardline.operators import metrics as M

    f = H.replay_features(V.identity_events(spark, sf)).select(F.explode(X.attribution()).alias("a")).select("a.name", "a.phi")
    return M.importance_rank(M.mean_abs_attribution(f, "name", "phi"), "mean_abs").select("feature", F.round("mean_abs", 8).alias("mean_abs"), "rank")


_CF_SQL = "case a[1].n " + " ".join(
    f"when '{k}' then '{t.replace(chr(39), chr(39) * 2)}'" for k, t in C.COUNTERFACTUAL_TEXT.items()
) + " end"


@query(
    "counterfactual", "L12",
    f"""with {SQL_REPLAY}, a as (select event_id, amount, am, list_sort({_PHI_SQL}) as a from features left join z using (event_id))
    select event_id, case when a[1].p <= 0 then 'No single factor dominated; behaviour was broadly consistent.'
      when a[1].n = 'amount_zscore' and amount is not null and amount <> 0 then
        case when am > 0 then 'Would have scored materially lower if the amount were closer to ≈ ₹' ||
          format('{{:,}}', cast(floor(am) as bigint)) || ' (this identity''s typical range).'
        else 'Would have scored lower if the amount were closer to this identity''s normal range.' end
      else 'Would have scored lower if ' || {_CF_SQL} || '.' end as counterfactual from a""",
)
def counterfactual(spark, sf):
    f = H.replay_features(V.identity_events(spark, sf), keep_amount_mean=True)
    return f.select("event_id", X.counterfactual(X.attribution(), F.col("amount"), F.col("amount_mean")).alias("counterfactual"))


@query("novelty", "E7", f"with {SQL_REPLAY} select event_id, new_geo from features")
def novelty(spark, sf):
    return H.novelty(V.identity_events(spark, sf), "identity_id", "geo", 0.5, "new_geo").select("event_id", "new_geo")


# ---- per-entity order -----------------------------------------------------------
@query(
    "causal_index", "E1",
    f"with {V.SQL_PAYMENTS} select row_id, row_number() over (partition by nameOrig order by step, row_id) - 1 as orig_txn_idx, "
    "row_number() over (partition by nameDest order by step, row_id) - 1 as dest_in_deg from payments",
)
def causal_index(spark, sf):
    p = V.payments(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("step") * 3600))
    p = H.causal_index(p, "nameOrig", "ts", "row_id", "orig_txn_idx")
    return H.causal_index(p, "nameDest", "ts", "row_id", "dest_in_deg").select("row_id", "orig_txn_idx", "dest_in_deg")


_TRAVEL_SQL = V.SQL_LOGINS + """, t as (
  select event_id, country, takeover, lag(country) over w as prev_country,
    (epoch_us(ts) - lag(epoch_us(ts)) over w) / 3600000000.0 as hours_since
  from logins window w as (partition by "user" order by ts, event_id)),
f as (select *, cast(coalesce(prev_country is not null and country <> prev_country and hours_since < 6, false) as int) as impossible from t)"""


@query("impossible_travel", "E2,C10", f"with {_TRAVEL_SQL} select event_id, prev_country, round(hours_since, 6) as hours_since, impossible from f")
def impossible_travel(spark, sf):
    t = H.impossible_travel(V.logins(spark, sf), "user", "ts", "event_id")
    return t.select("event_id", "prev_country", _R("hours_since"), "impossible")


@query(
    "travel_lift", "E3",
    f"""with {_TRAVEL_SQL} select count(*) filter (takeover) as takeovers,
      count(*) filter (takeover and prev_country is not null) as takeovers_with_prior,
      count(*) filter (takeover and impossible = 1) as takeovers_flagged,
      count(*) filter (not takeover and prev_country is not null) as genuine_with_prior,
      count(*) filter (not takeover and impossible = 1) as genuine_flagged,
      round(count(*) filter (takeover and impossible = 1) / greatest(count(*) filter (takeover and prev_country is not null), 1), 6) as takeover_rate,
      round(count(*) filter (not takeover and impossible = 1) / greatest(count(*) filter (not takeover), 1), 6) as genuine_rate from f""",
)
def travel_lift(spark, sf):
    t = H.impossible_travel(V.logins(spark, sf), "user", "ts", "event_id").withColumn("takeover", F.col("takeover").cast("int"))
    out = H.travel_lift(t)
    return out.withColumns({c: F.round(c, 6) for c in ("takeover_rate", "genuine_rate")})


@query(
    "first_event_per_user", "E4",
    f'with {V.SQL_LOGINS} select event_id, "user", country from logins qualify row_number() over (partition by "user" order by ts, event_id) = 1',
)
def first_event_per_user(spark, sf):
    return J.first_event(V.logins(spark, sf), "user", "ts", "event_id").select("event_id", "user", "country")


@query(
    "first_n_split", "E5",
    f'with {V.SQL_LOGINS} select event_id, cast(row_number() over (partition by "user" order by ts, event_id) <= 20 as int) as is_enrol from logins',
)
def first_n_split(spark, sf):
    return H.first_n_split(V.logins(spark, sf), "user", "ts", "event_id", 20).select("event_id", "is_enrol")


@query(
    "device_identity_count", "E11,I2",
    f"""with {V.SQL_EVENTS}, f as (select event_id, device_id, ts, row_number() over (partition by device_id, identity_id order by ts, event_id) as r from identity_events)
    select event_id, cast(sum(cast(r = 1 as int)) over (partition by device_id order by ts, event_id) as bigint) as identities_so_far from f""",
)
def device_identity_count(spark, sf):
    return H.device_identity_count(V.identity_events(spark, sf)).select("event_id", "identities_so_far")


@query(
    "identities_per_device", "D18",
    f"with {V.SQL_EVENTS} select device_id, count(distinct identity_id) as identities from identity_events group by 1",
)
def identities_per_device(spark, sf):
    return H.identities_per_device(V.identity_events(spark, sf))


@query(
    "trailing_rate", "E16",
    """with t as (select event_id, user_id, epoch_us(ts) as us from events)
    select event_id, count(*) over (partition by user_id order by us range between 299999999 preceding and current row) as n_recent from t""",
)
def trailing_rate(spark, sf):
    return H.trailing_count(V.table(spark, sf, "events"), "user_id", "ts", 300).select("event_id", "n_recent")


@query(
    "trailing_day_count", "E16",
    """with t as (select event_id, user_id, epoch_us(ts) as us from events)
    select event_id, count(*) over (partition by user_id order by us range between 86399999999 preceding and current row) as n_recent from t""",
)
def trailing_day_count(spark, sf):
    return H.trailing_count(V.table(spark, sf, "events"), "user_id", "ts", 86_400).select("event_id", "n_recent")


@query(
    "replay_head", "F1,F2",
    f"""with {V.SQL_LOGINS} select event_id, "user" from logins where success and not takeover order by "user", ts, event_id limit 500""",
)
def replay_head(spark, sf):
    from wardline.operators.splits import login_population

    g = login_population(V.logins(spark, sf), "genuine")
    return H.replay_head(g, "user", "ts", "event_id", 500).select("event_id", "user")


# ---- drift ----------------------------------------------------------------------
def _risk(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.round(F.least(F.col("value") / 125.0, F.lit(1.0)), 5).alias("risk")
    )


_RISK_SQL = "r as (select event_id, user_id, ts, round(least(value / 125.0, 1.0), 5) as risk, row_number() over (partition by user_id order by ts, event_id) as n from events)"


@query(
    "drift_cusum", "E12,E13",
    f"""with recursive {_RISK_SQL}, f(user_id, n, event_id, ewma, cusum) as (
      select user_id, n, event_id, risk, greatest(0.0, -0.015) from r where n = 1
      union all
      select r.user_id, r.n, r.event_id, case when f.ewma = 0 then r.risk else f.ewma + 0.03 * (r.risk - f.ewma) end,
        greatest(0.0, f.cusum + (r.risk - case when f.ewma > 0 then f.ewma else r.risk end - 0.015))
      from f join r on r.user_id = f.user_id and r.n = f.n + 1)
    select event_id, round(ewma, 6) as ewma, round(cusum, 6) as cusum, cast(cusum > 0.4 as int) as cusum_fired from f""",
)
def drift_cusum(spark, sf):
    d = drift.risk_cusum(_risk(spark, sf), ["user_id"], ["ts", "event_id"], X.micros("ts"))
    return d.select("event_id", _R("ewma"), _R("cusum"), "cusum_fired")


@query(
    "drift_mean_shift", "E14",
    f"""with {_RISK_SQL}, w as (select event_id, list(risk) over (partition by user_id order by n rows between 11 preceding and current row) as x from r),
    h as (select event_id, x, len(x) as n, x[1:len(x)//2] as e, x[len(x)//2+1:] as l from w where len(x) >= 8),
    s as (select event_id, n, list_avg(l) - list_avg(e) as shift,
      list_max(list_transform(x, lambda v: abs(len(list_filter(e, lambda a: a <= v)) / len(e) - len(list_filter(l, lambda a: a <= v)) / len(l)))) as ks from h)
    select event_id, round(shift, 6) as shift, round(ks, 6) as ks,
      cast(shift >= 0.08 and ks >= case n when 11 then 0.8 when 12 then 5/6 else 1.0 end - 1e-9 as int) as shift_fired from s""",
)
def drift_mean_shift(spark, sf):
    d = drift.mean_shift(_risk(spark, sf), ["user_id"], ["ts", "event_id"], X.micros("ts"))
    return d.filter("shift is not null").select("event_id", _R("shift"), _R("ks"), "shift_fired")
