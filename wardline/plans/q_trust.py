"""Trust decisions, tokens, audit, privacy and table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import crypto as K, expr as X
from wardline.operators import audit as A, fairness as FA, history as H, privacy as P, tokens as TK
from wardline.plans import fixtures as V
from wardline.plans.q_features import KEY, sql_hmac
from wardline.plans.q_history import SQL_REPLAY
from wardline.plans.registry import query
from wardline.plans.trust_sql import trust_sql
from wardline.session import materialize
from wardline.sources import readers as R, tables as TB
from wardline.streaming import fold, trust as TR

_R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def decisions(spark, sf, params=fold.Params(require_model=False)):
    return TR.trust_decisions(V.identity_events(spark, sf), params=params)


@query(
    "trust_decisions", "I1,I7,I8,L5,L9,L10",
    f"""with recursive {trust_sql()} select event_id, identity_id, shown as trust, band as risk_band, decision, coalesce(method, 'none') as step_up_method,
      cast(floor(risk * 1000000 + 0.3) as bigint) as event_risk_ppm, impossible, reviewed as drift_review, cast(allowed as bigint) as events_seen, cast(len(devices) as bigint) as known_devices from d""",
)
def trust_decisions(spark, sf):
    d = decisions(spark, sf)
    return d.select("event_id", "identity_id", "trust", "risk_band", "decision", F.coalesce("step_up_method", F.lit("none")).alias("step_up_method"),
                    F.floor(F.col("event_risk") * 1e6 + 0.3).alias("event_risk_ppm"), "impossible", "drift_review", "events_seen", "known_devices")


@query("trust_explained", "I1,L11,L12,F3")
def trust_explained(spark, sf):
    d = TR.explain(decisions(spark, sf))
    return d.select("event_id", F.col("reason_codes")[0].alias("first_reason"), "counterfactual")


@query("trust_decisions_legacy", "L13", f"with recursive {trust_sql(drift=False, cap=10**9, prior=False, travel=False)} select band as risk_band, decision, count(*) as events from d group by all")
def trust_decisions_legacy(spark, sf):
    d = decisions(spark, sf, fold.Params.named("before", require_model=False))
    return d.groupBy("risk_band", "decision").agg(F.count(F.lit(1)).alias("events"))


@query("trust_degraded", "I12", f"with recursive {trust_sql(degraded=True)} select event_type, band as risk_band, decision, count(*) as events from d group by all")
def trust_degraded(spark, sf):
    d = decisions(spark, sf, fold.Params())
    return d.groupBy("event_type", "risk_band", "decision").agg(F.count(F.lit(1)).alias("events"))


_OUTCOME = "case when event_type = 'account_recovery' then hod < 18 end"


@query(
    "trust_with_outcomes", "I3",
    f"with recursive {trust_sql(outcome=_OUTCOME)} select event_id, shown as trust, decision from d",
)
def trust_with_outcomes(spark, sf):
    e = V.identity_events(spark, sf)
    o = e.filter("event_type = 'account_recovery'").select("identity_id", "ts", (F.col("hour_of_day") < 18).alias("passed"))
    d = TR.trust_decisions(e, outcomes=o, params=fold.Params(require_model=False))
    return d.select("event_id", "trust", "decision")


@query(
    "identity_snapshot", "B26",
    f"""with recursive {trust_sql()} select identity_id, trust, cast(len(devices) as bigint) as known_devices, cast(allowed as bigint) as events_seen
      from d qualify row_number() over (partition by identity_id order by ts desc, event_id desc) = 1""",
)
def identity_snapshot(spark, sf):
    return TR.identity_snapshot(decisions(spark, sf))


_FRICTION_SQL = f"""with a as (with recursive {trust_sql()} select avg(cast(decision <> 'ALLOW' as int)) as r from d where n = 0),
  b as (with recursive {trust_sql(prior=False)} select avg(cast(decision <> 'ALLOW' as int)) as r, count(*) as n from d where n = 0)
  select b.n as n_before, round(b.r, 6) as rate_before, round(a.r, 6) as rate_after, round(b.r - a.r, 6) as absolute_reduction,
    round(coalesce(100 * (b.r - a.r) / nullif(b.r, 0), 0.0), 6) as relative_reduction_pct from a, b"""


@query("friction_change", "D19", _FRICTION_SQL)
def friction_change(spark, sf):
    """Challenge rate of each identity's first event without and with the first-contact prior."""
    before = decisions(spark, sf, fold.Params(cold_prior=False, require_model=False))
    after = decisions(spark, sf)
    first = lambda d: H_first(d).select((F.col("decision") != "ALLOW").alias("selected"))
    out = FA.friction_change(first(before), first(after))
    return out.select("n_before", *[_R(c) for c in ("rate_before", "rate_after", "absolute_reduction", "relative_reduction_pct")])


def H_first(d):
    from wardline.operators.joins import first_event

    return first_event(d, "identity_id", "ts", "event_id")


# ---- client and audit views -----------------------------------------------------
@query(
    "client_view", "B24",
    f"""with {SQL_REPLAY}, d as (select event_id, event_type, case when det_risk < 0.45 then 'ALLOW' else 'STEP_UP' end as decision,
      case when det_risk < 0.45 then null when event_type in ('account_recovery', 'onboarding') then 'video_kyc'
           when det_risk < 0.65 then 'device_biometric' else 'otp_sms' end as m from risked)
    select event_id, decision, m as step_up_method, case when decision = 'STEP_UP' then substr(sha256('challenge|'||event_id), 1, 12) end as challenge_id,
      case decision when 'ALLOW' then '{C.CLIENT_MESSAGE["ALLOW"]}' else '{C.CLIENT_MESSAGE["STEP_UP"]}' end as message from d""",
)
def client_view(spark, sf):
    r = H.replay_features(V.identity_events(spark, sf)).withColumn("event_risk", X.det_risk())
    r = r.withColumn("risk_band", X.risk_band(F.lit(C.START_TRUST), F.col("event_risk")))
    r = r.withColumns({"decision": X.decision(F.col("risk_band"), F.col("event_type")),
                       "step_up_method": X.step_up_method(F.col("risk_band"), F.col("event_type"))})
    return TR.to_client(r)


@query("audit_payload", "B25")
def audit_payload(spark, sf):
    return TR.to_audit_payload(TR.explain(decisions(spark, sf))).select("event_id", "payload")


_DEGRADED_SQL = f"""with {SQL_REPLAY}, db as (select event_id, event_type, case when det_risk < 0.45 then 'LOW' when det_risk < 0.65 then 'ELEVATED' else 'HIGH' end as band from risked)
select event_id, case when band = 'LOW' and event_type not in ('account_recovery', 'onboarding') then 'ALLOW' else 'STEP_UP' end as decision,
  case when event_type in ('account_recovery', 'onboarding') then 'DEGRADED_FAILCLOSED' else 'DEGRADED_FAILOPEN' end as risk_band,
  case when event_type in ('account_recovery', 'onboarding') then 'video_kyc' when band = 'HIGH' then 'otp_sms' when band = 'ELEVATED' then 'device_biometric' end as method
from db"""


@query("degraded_policy", "I12,L3", _DEGRADED_SQL)
def degraded_policy(spark, sf):
    r = H.replay_features(V.identity_events(spark, sf)).withColumn("event_risk", X.blend(F.lit(None).cast("double"), X.det_risk()))
    band = X.risk_band(F.lit(C.START_TRUST), F.col("event_risk"))
    r = r.withColumn("band", band)
    dec, b, m = X.degraded_policy(X.decision(F.col("band"), F.col("event_type")), F.col("band"),
                                  X.step_up_method(F.col("band"), F.col("event_type")), F.col("event_type"), F.lit(True))
    return r.select("event_id", dec.alias("decision"), b.alias("risk_band"), m.alias("method"))


@query(
    "trust_change", "L5",
    f"""with {SQL_REPLAY}, r as (select event_id, round(det_risk, 9) as r from risked) select event_id, case when r > 0.45 then
      -cast(trunc((r - 0.45) * 900) as bigint) else cast(trunc((0.45 - r) * 60) as bigint) end as delta from r""",
)
def trust_change(spark, sf):
    """Uncapped trust change of every event."""
    r = H.replay_features(V.identity_events(spark, sf)).withColumn("r", F.round(X.det_risk(), 9))
    return r.select("event_id", X.trust_delta(F.col("r")).cast("long").alias("delta"))


# ---- tokens ---------------------------------------------------------------------
@query(
    "nonce_replay", "I4",
    """select event_id, cast(row_number() over (partition by user_id % 50, props order by ts, event_id) > 1 as int) as replayed from events""",
)
def nonce_replay(spark, sf):
    e = V.table(spark, sf, "events").withColumn("nonce", F.concat_ws("|", F.col("user_id") % 50, "props"))
    return TK.nonce_status(e, "nonce", "ts", "event_id").select("event_id", "replayed")


@query(
    "idempotency_status", "I5,M6",
    """with r as (select event_id, ts, user_id as caller, case when event_type <> 'view' then props end as key,
        sha256('{"event_type":"'||event_type||'","user_id":'||user_id||'}') as fp from events),
    f as (select *, first_value(fp) over w as f0, row_number() over w as n from r window w as (partition by caller, key order by ts, event_id))
    select event_id, case when key is null then 'no_key' when n = 1 then 'first' when fp = f0 then 'replay' else 'conflict' end as status from f""",
)
def idempotency_status(spark, sf):
    e = V.table(spark, sf, "events").withColumn("fp", A.event_fingerprint("event_type", "user_id"))
    e = e.withColumn("key", F.when(F.col("event_type") != "view", F.col("props")))
    return TK.idempotency_status(e, "user_id", "key", "fp", "ts", "event_id").select("event_id", "status")


@query("event_fingerprint", "M6", """select event_id, sha256('{"event_id":'||event_id||',"event_type":"'||event_type||'","props":"'||replace(props, '"', '\\"')||'"}') as fingerprint from events""")
def event_fingerprint(spark, sf):
    return V.table(spark, sf, "events").select("event_id", A.event_fingerprint("event_id", "event_type", "props").alias("fingerprint"))


def _assertions(spark, sf):
    """Step-up assertions made from events, with every kind of fault in a fixed share of them."""
    e = V.table(spark, sf, "events")
    i, t = F.col("event_id"), X.micros("ts") / 1_000_000
    body = F.to_json(F.struct(
        F.concat(F.lit("c"), i).alias("challenge_id"),
        (t + F.when(i % 7 == 2, -10.0).otherwise(120.0)).alias("exp"),
        F.concat(F.lit("u"), F.when(i % 7 == 1, F.col("user_id") + 1).otherwise(F.col("user_id"))).alias("identity_id"),
        (t + F.when(i % 7 == 3, 60.0).otherwise(-1.0)).alias("issued_at"), F.lit("otp_sms").alias("method"),
        F.concat(F.lit("n"), F.when(i % 7 == 4, F.lit(4)).otherwise(i)).alias("nonce"),
        F.when(i % 2 == 0, "pass").otherwise("fail").alias("result"),
    ))
    good = K.sign_token(body, KEY)
    bad = K.sign_token(body, b"another-key")
    token = F.when(i % 7 == 5, bad).when(i % 7 == 6, F.lit("garbage")).otherwise(good)
    return e.select(i.alias("row_id"), "ts", F.concat(F.lit("u"), "user_id").alias("identity_id"), token.alias("token"), t.alias("now"))


@query(
    "assertion_status", "I10,M3",
    """select event_id as row_id, case event_id % 7 when 1 then 'identity_mismatch' when 2 then 'expired' when 3 then 'future'
      when 4 then case when row_number() over (partition by event_id % 7 order by ts, event_id) = 1 then 'accepted' else 'replayed' end
      when 5 then 'bad_signature' when 6 then 'malformed' else 'accepted' end as status from events""",
)
def assertion_status(spark, sf):
    return TK.assertion_status(materialize(_assertions(spark, sf)), KEY, F.col("now")).select("row_id", "status")


@query(
    "open_token", "M3,H",
    f"""select c_custkey, {sql_hmac("c_name")} = {sql_hmac("c_name")} as authentic, c_name as name, {sql_hmac("c_mktsegment")} as digest from customer""",
)
def open_token(spark, sf):
    c = V.table(spark, sf, "customer").withColumn("token", K.sign_token(F.to_json(F.struct(F.col("c_name").alias("name"))), KEY))
    c = K.open_token(c, "token", KEY, "name string", "t")
    return c.select("c_custkey", F.col("t_authentic").alias("authentic"), F.col("t_payload.name").alias("name"),
                    K.hmac_sha256(F.col("c_mktsegment"), KEY).alias("digest"))


def _signed(spark, sf):
    e = V.identity_events(spark, sf)
    i, t = F.col("event_id"), X.micros("ts") / 1_000_000
    att = F.to_json(F.struct(F.col("device_id"), (t + 60).alias("exp"), (t - 1).alias("issued_at"), F.lit("device_attestation").alias("kind"),
                             F.concat(F.lit("a"), i).alias("nonce"), F.when(i % 5 == 1, "FAILED").otherwise("MEETS_DEVICE_INTEGRITY").alias("verdict")))
    beh = F.to_json(F.struct(F.when(i % 5 == 2, F.lit("other")).otherwise(F.col("device_id")).alias("device_id"), (t + 60).alias("exp"), "identity_id",
                             (t - 1).alias("issued_at"), F.when(i % 5 == 3, "other").otherwise("behavior_similarity").alias("kind"),
                             F.concat(F.lit("b"), i).alias("nonce"), F.when(i % 5 == 4, "NaN").otherwise(((i % 100) / 100.0).cast("string")).alias("similarity")))
    return e.withColumns({"device_attestation": K.sign_token(att, KEY), "behavior_assertion": K.sign_token(beh, KEY), "now": t})


@query("resolve_behavior", "I9,C11", "select event_id, case when event_id % 5 = 0 then (event_id % 100) / 100.0 end as similarity from events")
def resolve_behavior(spark, sf):
    return TK.resolve_behavior(materialize(_signed(spark, sf)), KEY, KEY, F.col("now")).select("event_id", "similarity")


@query(
    "bind_tokens", "C11",
    f"""with {V.SQL_EVENTS} select event_id, case when event_id % 3 <> 1 and event_id % 5 <> 2 then (event_id % 100) / 100.0 end as bound_similarity from identity_events""",
)
def bind_tokens(spark, sf):
    from wardline.operators.joins import bind_tokens as bind

    e = V.identity_events(spark, sf)
    a = e.select("event_id", F.when(F.col("event_id") % 3 == 1, F.lit("x")).otherwise(F.col("device_id")).alias("device_id"))
    b = e.select("event_id", "device_id", F.when(F.col("event_id") % 5 == 2, F.lit("x")).otherwise(F.col("identity_id")).alias("identity_id"),
                 ((F.col("event_id") % 100) / 100.0).alias("similarity"))
    return bind(e, a, b).select("event_id", "bound_similarity")


_LIMIT_SQL = """with recursive a as (select event_id as attempt_id, 'u'||(user_id % 3) as identity_id, (epoch_us(ts) / 1000000.0) / 20 as t, event_type <> 'error' as valid,
    row_number() over (partition by user_id % 3 order by ts, event_id) as n from events),
  f as (select identity_id, cast(0 as bigint) as n, cast(null as bigint) as attempt_id, cast([] as double[]) as bad, cast([] as double[]) as good, '' as status from (select distinct identity_id from a)
    union all
    select identity_id, n, attempt_id, case when status = 'rejected' then list_append(bad, t) else bad end, case when status = 'accepted' then list_append(good, t) else good end, status
    from (select *, case when len(bad) >= 20 then 'refused_failures' when not valid then 'rejected' when len(good) >= 5 then 'refused_accepted' else 'accepted' end as status
      from (select a.*, list_filter(f.bad, lambda x: a.t - x < 300) as bad, list_filter(f.good, lambda x: a.t - x < 300) as good
        from f join a on a.identity_id = f.identity_id and a.n = f.n + 1)))
  select attempt_id, identity_id, status from f where n > 0"""


@query("step_up_limits", "I6", _LIMIT_SQL)
def step_up_limits(spark, sf):
    a = V.table(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("identity_id"),
        F.timestamp_seconds(X.micros("ts") / 1_000_000 / 20).alias("ts"), (F.col("event_type") != "error").alias("valid"),
    )
    return TR.step_up_limits(a)


_RAW_JSON = """'{"event_id":'||event_id||',"ts":"'||strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')||'"}'"""


@query(
    "validate_events", "B23,I11",
    """select case event_id % 9 when 1 then 'malformed' when 2 then 'unknown_field' when 3 then 'missing_field' when 4 then 'event_type'
        when 5 then 'channel' when 6 then 'hour_of_day' when 7 then 'wrong_type' else 'good' end as problem, count(*) as n from events group by 1""",
)
def validate_events(spark, sf):
    good, bad = R.validate_events(raw_events(spark, sf))
    return good.groupBy(F.lit("good").alias("problem")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    )


def raw_events(spark, sf):
    """JSON text events; eight ninths carry one fault each or none."""
    e, i = V.identity_events(spark, sf), F.col("event_id")
    j = F.to_json(F.struct(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(i % 9 != 3, F.col("identity_id")).alias("identity_id"),
        F.when(i % 9 == 4, "teleport").otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 9 == 5, "fax").otherwise(F.col("channel")).alias("channel"), "device_id", "geo",
        F.when(i % 9 == 7, "noon").when(i % 9 == 6, "24").otherwise(F.col("hour_of_day").cast("string")).alias("hour_of_day_text"), "amount",
        F.when(i % 9 == 2, F.lit(0.99)).alias("behavior_score"),
    ))
    j = F.regexp_replace(j, '"hour_of_day_text":"([0-9]+)"', '"hour_of_day":$1')
    j = F.regexp_replace(j, '"hour_of_day_text":"noon"', '"hour_of_day":"noon"')
    return e.select(F.when(i % 9 == 1, F.substring(j, 1, 20)).otherwise(j).alias("raw"))


# ---- audit ----------------------------------------------------------------------
def chain_rows(spark, sf):
    e = V.table(spark, sf, "events")
    shard = F.concat_ws("/", F.to_date("ts").cast("string"), (F.col("event_id") % 4).cast("string"))
    return e.select(shard.alias("shard"), "ts", F.col("event_id").alias("row_id"), X.canonical_json("event_id", "event_type", "user_id").alias("payload"))


def chain(spark, sf):
    return A.append_chain(chain_rows(spark, sf), KEY)


_APPEND_SQL = f"""with recursive r as (select cast(ts as date)||'/'||(event_id % 4) as shard, epoch_us(ts) as ts_us,
    row_number() over (partition by cast(ts as date), event_id % 4 order by ts, event_id) - 1 as seq,
    '{{"event_id":'||event_id||',"event_type":"'||event_type||'","user_id":'||user_id||'}}' as payload from events),
  c as (select shard, seq, ts_us, payload, lpad('', 64, '0') as prev_hash, sha256(seq||'|'||ts_us||'|'||payload||'|'||lpad('', 64, '0')) as hash from r where seq = 0
    union all
    select r.shard, r.seq, r.ts_us, r.payload, c.hash, sha256(r.seq||'|'||r.ts_us||'|'||r.payload||'|'||c.hash) from c join r on r.shard = c.shard and r.seq = c.seq + 1)
  select *, {sql_hmac("hash")} as hmac from c"""


@query("append_chain", "M2", _APPEND_SQL)
def append_chain(spark, sf):
    return chain(spark, sf)


@query("append_chain_continued", "M2", _APPEND_SQL)
def append_chain_continued(spark, sf):
    """The records after eight o'clock of each day go on from the stored heads of those before."""
    rows = chain_rows(spark, sf)
    early = F.hour("ts") < 8
    first = materialize(A.append_chain(rows.filter(early), KEY))
    return first.unionByName(A.append_chain(rows.filter(~early), KEY, A.head_checkpoint(first)))


_GENESIS_SQL = "lpad('', 64, '0')"


@query(
    "chain_of_heads", "M2,M5",
    _APPEND_SQL[:_APPEND_SQL.rindex("select *,")] + f""", h as (select shard, count(*) as n, max_by(hash, seq) as head, max(ts_us) as ts_us from c group by 1),
  o as (select row_number() over (order by ts_us, shard) - 1 as seq, ts_us, shard||'|'||n||'|'||head as payload from h),
  d as (select seq, ts_us, payload, {_GENESIS_SQL} as prev_hash, sha256(seq||'|'||ts_us||'|'||payload||'|'||{_GENESIS_SQL}) as hash from o where seq = 0
    union all
    select o.seq, o.ts_us, o.payload, d.hash, sha256(o.seq||'|'||o.ts_us||'|'||o.payload||'|'||d.hash) from d join o on o.seq = d.seq + 1)
  select 'heads' as shard, *, {sql_hmac("hash")} as hmac from d""",
)
def chain_of_heads(spark, sf):
    return A.chain_of_heads(chain(spark, sf), KEY)


_CHAIN_SQL = """r as (select 'd'||(user_id % 20) as shard, row_number() over (partition by user_id % 20 order by ts, event_id) - 1 as seq,
    epoch_us(ts) as ts_us, '{"event_id":'||event_id||',"event_type":"'||event_type||'"}' as payload, event_id from events),
  h as (select *, sha256(seq||'|'||ts_us||'|'||payload||'|'||lpad('', 64, '0')) as hash from r),
  c as (select h.*, event_id % 500 = 7 as tampered from h)"""


def flat_chain(spark, sf):
    """Records whose links are broken on purpose: every record points at the genesis value."""
    from wardline.operators import ordered as O

    e = V.table(spark, sf, "events").withColumn("shard", F.concat(F.lit("d"), F.col("user_id") % 20))
    s = O.probe(e, ["shard"], X.micros("ts"))
    e = O.ordinal(e, ["shard"], [F.col("ts"), F.col("event_id")], s, X.micros("ts"), "seq")
    e = e.select("event_id", "shard", "seq", X.micros("ts").alias("ts_us"), X.canonical_json("event_id", "event_type").alias("payload"),
                 F.lit(C.GENESIS).alias("prev_hash"))
    e = e.withColumn("hash", A.body_hash())
    return e.withColumn("payload", F.when(F.col("event_id") % 500 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))


@query(
    "check_records", "M4,C9",
    f"""with {_CHAIN_SQL} select shard, count(*) as n, count(*) filter (seq = 0) as linked, count(*) filter (not tampered) as body_ok from c group by 1""",
)
def check_records(spark, sf):
    c = A.check_records(flat_chain(spark, sf))
    return c.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("linked").alias("linked"), F.count_if("body_ok").alias("body_ok"))


@query(
    "chain_verify", "M4,C9",
    f"""with {_CHAIN_SQL} select shard, count(*) as n, min(seq) filter (seq > 0 or tampered) as first_bad, 0 as intact from c group by 1""",
)
def chain_verify(spark, sf):
    return A.verify_chain(flat_chain(spark, sf))


@query("chain_round_trip", "M2,M4", """select concat_ws('/', 'all', cast(ts as date)) as day, count(*) as n, 1 as intact from events group by 1""")
def chain_round_trip(spark, sf):
    """Build real linked chains, verify them, and report one row per day."""
    v = A.verify_chain(chain(spark, sf), KEY)
    day = F.concat_ws("/", F.lit("all"), F.substring_index("shard", "/", 1))
    return v.groupBy(day.alias("day")).agg(F.sum("n").alias("n"), F.min("intact").alias("intact"))


@query(
    "head_checkpoint", "M5",
    f"""with {_CHAIN_SQL}, m as (select shard, count(*) as n, max_by(hash, seq) as head_hash from c group by 1)
    select shard, n, head_hash, n||'|'||head_hash||'|'||{sql_hmac("n||'|'||head_hash")} as checkpoint from m""",
)
def head_checkpoint(spark, sf):
    return A.head_checkpoint(flat_chain(spark, sf), KEY)


@query("audit_tail", "A12", "select * from (select event_id, event_type from events order by event_id desc limit 50) order by event_id")
def audit_tail(spark, sf):
    return TB.audit_tail(V.table(spark, sf, "events").select("event_id", "event_type"), 50, "event_id")


# ---- tables ---------------------------------------------------------------------
@query(
    "first_per_event", "A10",
    """with d as (select event_id % 3000 as event_id, ts, event_type as decision from events)
    select event_id, ts, decision from d qualify row_number() over (partition by event_id order by ts, decision) = 1""",
)
def first_per_event(spark, sf):
    d = V.table(spark, sf, "events").select((F.col("event_id") % 3000).alias("event_id"), "ts", F.col("event_type").alias("decision"))
    return TB.first_per_event(d)


@query("get_decision", "A11", "select event_id, event_type, value from events where event_id = 77")
def get_decision(spark, sf):
    return TB.get_decision(V.table(spark, sf, "events"), 77).select("event_id", "event_type", "value")


@query(
    "profile", "A13",
    f"""with {V.SQL_LOGINS} select count(*) as n_rows, 11 as n_columns, count(*) filter (takeover) as takeover_count, round(avg(cast(takeover as int)), 6) as takeover_rate,
      count(distinct "user") as user_distinct, count(distinct country) as country_distinct, min(ts) as first_ts, max(ts) as last_ts from logins""",
)
def profile(spark, sf):
    p = TB.profile(V.logins(spark, sf), ["takeover"], ["user", "country"], F.col("ts"))
    return p.withColumn("takeover_rate", F.round("takeover_rate", 6))


@query("type_counts", "A13", "select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def type_counts(spark, sf):
    return TB.type_counts(V.table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 6))


# ---- privacy --------------------------------------------------------------------
def means(spark, sf):
    f = H.replay_features(V.identity_events(spark, sf))
    return P.identity_means(f, X.country(F.col("geo")))


_MEANS_SQL = SQL_REPLAY + ", means as (select identity_id, max_by(split_part(geo, '-', 1), epoch_us(ts)) as cohort, " + \
    ", ".join(f"avg(least(greatest({c}, 0.0), 1.0)) as {c}" for c in C.FEATURES) + " from features group by 1)"


@query("identity_means", "D10", f"with {_MEANS_SQL} select identity_id, cohort, " + ", ".join(f"round({c}, 9) as {c}" for c in C.FEATURES) + " from means")
def identity_means(spark, sf):
    return means(spark, sf).select("identity_id", "cohort", *[_R(c, 9) for c in C.FEATURES])


@query("dp_cohort_raw", "D11", f"with {_MEANS_SQL} select cohort, count(*) as n, " + ", ".join(f"round(sum({c}), 6) as sum_{c}" for c in C.FEATURES) + " from means group by 1")
def dp_cohort_raw(spark, sf):
    return P.cohort_aggregates(means(spark, sf)).select("cohort", "n", *[_R(f"sum_{c}") for c in C.FEATURES])


def _u(*parts: str) -> str:
    """Keyed uniform draw in SQL."""
    text = "||'|'||".join(parts)
    return f"((cast('0x'||substr({sql_hmac(text)}, 1, 13) as bigint) + 0.5) / 4503599627370496.0)"


def _noise(c: str, *bound: str) -> str:
    u, v = _u(*bound, "cohort", f"'{c}'", "'u'"), _u(*bound, "cohort", f"'{c}'", "'v'")
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


def _dp_sql(*bound: str) -> str:
    return f"""with {_MEANS_SQL}, half as (select * replace (case when cohort in ('C0', 'C1') then 'north' else 'south' end as cohort) from means),
  a as (select cohort, count(*) as n, {", ".join(f"sum({c}) as {c}" for c in C.FEATURES)} from half group by 1),
  l as (select *, {_u(*bound, "cohort", "'size'")} - 0.5 as u from a),
  k as (select *, n - 10.0 * case when u >= 0 then 1 else -1 end * ln(1 - 2 * abs(u)) as noisy from l)
  select cohort, {", ".join(f"round(least(greatest(({c} + 4.0 * sqrt(11) * {_noise(c, *bound)}) / greatest(noisy, 1.0), 0.0), 1.0), 6) as {c}" for c in C.FEATURES)}
  from k where noisy >= 35"""


def _halves(spark, sf):
    f = H.replay_features(V.identity_events(spark, sf))
    return P.identity_means(f, F.when(X.country(F.col("geo")).isin("C0", "C1"), "north").otherwise("south"))


@query("dp_export", "M9,M10", _dp_sql())
def dp_export(spark, sf):
    return P.dp_cohort_means(_halves(spark, sf), 4.0, KEY).select("cohort", *[_R(c) for c in C.FEATURES])


@query("dp_second_release", "M9,M10", _dp_sql("'release 2024-06'"))
def dp_second_release(spark, sf):
    """The same table under another release name: other noise."""
    return P.dp_cohort_means(_halves(spark, sf), 4.0, KEY, release="2024-06").select("cohort", *[_R(c) for c in C.FEATURES])


_EPS_SQL = "list_min(list_transform([" + ", ".join(f"{o!r}e0" for o in P.ORDERS) + \
    "], lambda a: a / (2 * m * m) + ln((a - 1) / a) - (ln(d) + ln(a)) / (a - 1)))"


@query(
    "privacy_ledger", "M11",
    f"""with r as (select c_mktsegment as dataset, 2.0 + c_custkey % 7 as m, 0.00001 as d from customer), e as (select dataset, greatest({_EPS_SQL}, 0.0) as eps from r)
    select dataset, count(*) as releases, round(sum(eps), 6) as mean_epsilon, round(sum(eps + 0.1), 6) as total_epsilon from e group by 1""",
)
def privacy_ledger(spark, sf):
    r = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset"), (F.lit(2.0) + F.col("c_custkey") % 7).alias("noise_multiplier"), F.lit(1e-5).alias("delta"))
    return P.privacy_ledger(r).select("dataset", "releases", _R("mean_epsilon"), _R("total_epsilon"))


def _keys(spark, sf):
    """Keys derived from names so that the query is repeatable; real keys come from ``new_keys``."""
    c = V.table(spark, sf, "customer")
    return c.select(F.concat(F.lit("u"), "c_custkey").alias("identity_id"), F.unhex(F.sha2("c_name", 256)).alias("key"), "c_mktsegment",
                    F.expr("timestamp'2024-01-01' + make_dt_interval(cast(c_custkey % 900 as int))").alias("created_ts"))


@query("retention", "M12", "select 'u'||c_custkey as identity_id from customer where timestamp '2024-01-01' + to_days(cast(c_custkey % 900 as int)) < timestamp '2026-01-01' - interval 365 day")
def retention(spark, sf):
    return P.expire_keys(_keys(spark, sf), F.expr("timestamp'2026-01-01'"), 365).select("identity_id")


@query(
    "vault_round_trip", "M7,M8,C7",
    f"""with {V.SQL_EVENTS} select event_id, identity_id, case when c_mktsegment <> 'HOUSEHOLD' then '{{"device_id":"'||device_id||'","geo":"'||geo||'"}}' end as payload
    from identity_events join customer on 'u'||c_custkey = identity_id where c_mktsegment <> 'MACHINERY'""",
)
def vault_round_trip(spark, sf):
    """Encrypt, refuse identities erased before (one segment), shred others (another segment), decrypt what is left."""
    keys = _keys(spark, sf)
    rows = V.identity_events(spark, sf).select("event_id", "identity_id", X.canonical_json("device_id", "geo").alias("payload"))
    of = lambda segment: keys.filter(F.col("c_mktsegment") == segment).select("identity_id")
    vault = P.vault_put(rows, keys, of("MACHINERY"))
    left, _ = P.erase(keys, of("MACHINERY"), of("HOUSEHOLD"))
    return P.vault_get(vault, left).select("event_id", "identity_id", "payload")
