"""The trust fold as recursive SQL: an independent check of the sequential decisions."""

from __future__ import annotations

from wardline.plans.q_history import SQL_REPLAY


def trust_sql(drift: bool = True, cap: int = 120, prior: bool = True, travel: bool = True, degraded: bool = False,
              outcome: str = "null") -> str:
    """CTE text ending in ``d``: one row per event with the decision and the state after it.

    ``outcome`` is a boolean expression over the event: a step-up passed / failed right after it, null for none.
    """
    b = lambda x: "true" if x else "false"
    band = "case when trust2 >= 650 and risk < 0.45 then 'LOW' when trust2 >= 400 and risk < 0.65 then 'ELEVATED' when trust2 >= 150 then 'HIGH' else 'CRITICAL' end"
    kyc = "event_type in ('account_recovery', 'onboarding')"
    final = "decision1" if not degraded else f"case when {kyc} and decision1 = 'ALLOW' then 'STEP_UP' else decision1 end"
    final_band = "band1" if not degraded else f"case when {kyc} then 'DEGRADED_FAILCLOSED' else 'DEGRADED_FAILOPEN' end"
    final_method = "method1" if not degraded else f"case when {kyc} and decision1 = 'ALLOW' then 'video_kyc' else method1 end"
    return SQL_REPLAY + f""",
ev as (select event_id, identity_id, ts, event_type, device_id, geo, split_part(geo, '-', 1) as cty, cast(hour(ts) as int) as hod, amount, n,
    epoch_us(ts) / 1000000.0 as t,
    0.15 * behavior_anomaly + 0.07 * event_criticality + 0.04 * channel_risk + 0.08 * new_beneficiary + 0.12 * recovery_change + 0.10 * device_sharing as static,
    event_type in ('login', 'transaction') and channel in ('mobile_app', 'internet_banking', 'branch') and not is_new_beneficiary
      and not recovery_contact_changed and (amount is null or amount < 25000) as prior_ok from features),
fold as (
  select identity_id, cast(-1 as bigint) as n, cast(null as bigint) as event_id, cast(700 as bigint) as trust, cast([] as varchar[]) as devices, cast([] as varchar[]) as geos,
    cast([] as int[]) as hours, cast([] as double[]) as amounts, 0 as allowed, cast(0 as double) as burst, false as used, cast([] as double[]) as risks,
    cast(0 as double) as ewma, cast(0 as double) as cusum, false as review, cast(0 as double) as w0, cast(0 as bigint) as rec, '' as country, cast(0 as double) as cat,
    '' as band, '' as decision, '' as method, cast(0 as double) as risk, false as impossible, false as reviewed, cast(700 as bigint) as shown
  from (select distinct identity_id from ev)
  union all
  select identity_id, n, event_id, case when {outcome} then least(trust2 + 250, 1000) when not ({outcome}) then greatest(trust2 - 400, 0) else trust2 end, case when ok and not list_contains(devices, device_id) then list_append(devices, device_id) else devices end,
    case when ok and not list_contains(geos, geo) then list_append(geos, geo) else geos end,
    case when ok then list_append(hours, hod)[-200:] else hours end,
    case when ok and amount is not null then list_append(amounts, amount)[-200:] else amounts end,
    allowed + cast(ok as int), burst2, used or cold, case when {outcome} then cast([] as double[]) else risks2 end, ewma2,
    case when {outcome} then cast(0 as double) else cusum2 end, (review or reviewed2) and not coalesce({outcome}, false), w2, rec2,
    case when ok then cty else country end, case when ok then t else cat end, {final_band}, decision2, {final_method}, risk, imp, reviewed2, trust2
  from (select *, decision2 = 'ALLOW' as ok from (select *, {final} as decision2 from (
    select *, case when reviewed2 then 'STEP_UP' else decision0 end as decision1, case when reviewed2 then 'DRIFT_REVIEW' else band0 end as band1,
      case when reviewed2 then case when {kyc} then 'video_kyc' else 'otp_sms' end else method0 end as method1 from (
    select *, decision0 = 'ALLOW' and (review or ({b(drift)} and (cusum2 > 0.4 or (not cold and shifted)))) as reviewed2 from (
    select *, case band0 when 'LOW' then 'ALLOW' when 'CRITICAL' then 'BLOCK' else 'STEP_UP' end as decision0,
      case when band0 in ('LOW', 'CRITICAL') then null when {kyc} then 'video_kyc' when band0 = 'HIGH' then 'otp_sms' else 'device_biometric' end as method0 from (
    select *, {band} as band0 from (
    select *, case when risk > 0.45 then greatest(0, least(1000, trust - cast(trunc((risk - 0.45) * 900) as bigint))) else greatest(0, least(1000, trust + gain)) end as trust2,
      case when risk > 0.45 then rec else rec1 + gain end as rec2, case when risk > 0.45 then w0 else w1 end as w2 from (
    select *, least(cast(trunc((0.45 - risk) * 60) as bigint), greatest(0, {cap} - rec1)) as gain,
      coalesce(len(risks2) >= 8 and list_avg(recent[len(recent) // 2 + 1:]) - list_avg(recent[1:len(recent) // 2]) >= 0.08 and
        list_max(list_transform(recent, lambda v: abs(len(list_filter(recent[1:len(recent) // 2], lambda a: a <= v)) / (len(recent) // 2)
          - len(list_filter(recent[len(recent) // 2 + 1:], lambda a: a <= v)) / (len(recent) - len(recent) // 2))))
        >= case len(recent) when 11 then 0.8 when 12 then 5 / 6 else 1.0 end - 0.000000001, false) as shifted from (
    select *, risks2[-12:] as recent, greatest(0.0, cusum + risk - case when ewma > 0 then ewma else risk end - 0.015) as cusum2,
      case when ewma = 0 then risk else ewma + 0.03 * (risk - ewma) end as ewma2,
      case when t - w0 > 3600 then 0 else rec end as rec1, case when t - w0 > 3600 then t else w0 end as w1 from (
    select *, list_append(risks, round(risk, 4))[-16:] as risks2 from (
    select *, case when imp then least(det + 0.5, 1.0) else det end as risk from (
    select *, least(greatest(static + 0.14 * nd * half + 0.10 * ng * half + 0.05 * hd + 0.11 * az + 0.04 * least(burst2 / 15, 1.0), 0.0), 1.0) as det from (
    select f.trust, f.devices, f.geos, f.hours, f.amounts, f.allowed, f.used, f.risks, f.ewma, f.cusum, f.review, f.w0, f.rec, f.country, f.cat,
      e.*, allowed = 0 as cold, burst * 0.5 + 1.0 as burst2,
      case when allowed = 0 then 0.4 when list_contains(devices, device_id) then 0.0 else 1.0 end as nd,
      case when allowed = 0 then 0.5 when list_contains(geos, geo) then 0.0 else 1.0 end as ng,
      case when len(hours) = 0 then 0.5 else list_min(list_transform(hours, lambda h: least(abs(hod - h), 24 - abs(hod - h)))) / 12.0 end as hd,
      case when amount is null then 0.0 when len(amounts) < 5 then least(amount / 100000.0, 1.0)
        else least(abs(amount - list_avg(amounts)) / (3 * greatest(list_stddev_pop(amounts), 1.0)), 1.0) end as az,
      case when {b(prior)} and allowed = 0 and not used and prior_ok then 0.5 else 1.0 end as half,
      {b(travel)} and country <> '' and cty <> country and t - cat < 3600 as imp
    from fold f join ev e on e.identity_id = f.identity_id and e.n = f.n + 1)))))))))))))),
d as (select fold.*, ts, event_type, ev.geo from fold join ev using (event_id))"""
