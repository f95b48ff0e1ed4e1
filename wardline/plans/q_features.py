"""Feature, split, encoding, join, user-day and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import crypto as K, expr as X
from wardline.operators import encode as E, joins as J, metrics as M, splits as S, userday as U
from wardline.plans import fixtures as V
from wardline.plans.registry import query
from wardline.session import materialize

_R = lambda c, n=6: F.round(F.col(c), n).alias(c)


@query(
    "payment_features", "B1-B7",
    f"""with {V.SQL_PAYMENTS} select row_id, cast(step % 24 as int) as hour, round(ln(1 + amount), 6) as log_amount,
      cast(nameDest like 'M%' as int) as dest_is_merchant, round(oldbalanceOrg - amount - newbalanceOrig, 4) as err_orig,
      round(oldbalanceDest + amount - newbalanceDest, 4) as err_dest,
      cast(newbalanceOrig = 0 and oldbalanceOrg > 0 as int) as orig_emptied, cast(oldbalanceDest = 0 as int) as dest_zero_before,
      round(amount / (oldbalanceOrg + 1.0), 6) as amt_ratio,
      round(least(greatest(amount / (oldbalanceOrg + 1.0), 0.0), 5.0), 6) as frac_orig_moved,
      cast(abs(amount - oldbalanceOrg) <= 0.00000001 + 0.00001 * abs(oldbalanceOrg) as int) as amount_eq_oldorig from payments""",
)
def payment_features(spark, sf):
    p = X.balance_features(V.payments(spark, sf))
    return p.select(
        "row_id", X.hour_from_step(F.col("step")).alias("hour"), F.round(X.log_amount(F.col("amount")), 6).alias("log_amount"),
        X.is_merchant(F.col("nameDest")).alias("dest_is_merchant"), _R("err_orig", 4), _R("err_dest", 4), "orig_emptied",
        "dest_zero_before", _R("amt_ratio"), _R("frac_orig_moved"), "amount_eq_oldorig",
    )


@query(
    "login_features", "B8-B10,B13",
    f"""with {V.SQL_LOGINS}, r as (select *, ln(1 + try_cast(rtt_ms as double)) as raw from logins),
    m as (select quantile_cont(raw, 0.5) as med from r)
    select event_id, round(coalesce(raw, med), 6) as rtt, lower(split_part(browser_full, ' ', 1)) as browser_family,
      split_part(os_full, ' ', 1) as os_family,
      coalesce(device_type, 'unknown')||'|'||split_part(browser_full, ' ', 1)||'|'||split_part(os_full, ' ', 1) as device_key,
      cast(hour(ts) < 6 or hour(ts) >= 20 as int) as off_hours from r, m""",
)
def login_features(spark, sf):
    df = S.rtt_feature(V.logins(spark, sf), "rtt_ms", impute=True)
    return df.select(
        "event_id", _R("rtt"), X.family(F.col("browser_full"), lower=True).alias("browser_family"),
        X.family(F.col("os_full")).alias("os_family"),
        X.device_key(F.col("device_type"), F.col("browser_full"), F.col("os_full")).alias("device_key"),
        X.off_hours(F.col("ts")).alias("off_hours"),
    )


@query(
    "top_k_bucket", "B11",
    """with t as (select p_brand from part where p_brand is not null group by 1 order by count(*) desc, p_brand limit 10)
    select p_partkey, case when p_brand in (select p_brand from t) then p_brand when p_brand is not null then 'OTHER' end as brand_top from part""",
)
def top_k_bucket(spark, sf):
    return E.top_k_bucket(V.table(spark, sf, "part"), "p_brand", 10, "brand_top").select("p_partkey", "brand_top")


@query(
    "left_join_flag", "C1,B12,K17",
    """select doc_id, lang, quality, toxic, cast(l.doc_id is not null as int) as has_label from documents d
    left join labels l using (doc_id)""",
)
def left_join_flag(spark, sf):
    d, lab = V.table(spark, sf, "documents"), V.table(spark, sf, "labels")
    return J.left_join_flag(d, lab, "doc_id", "has_label").select("doc_id", "lang", "quality", "toxic", "has_label")


@query(
    "has_match", "B12",
    "select o_orderkey, cast(exists (select 1 from lineitem where l_orderkey = o_orderkey) as int) as has_lines from orders",
)
def has_match(spark, sf):
    keys = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.has_match(V.table(spark, sf, "orders"), keys, "o_orderkey", "has_lines").select("o_orderkey", "has_lines")


@query(
    "rate_by_match", "D9",
    """with m as (select o_totalprice > 250000 as y, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as f from orders)
    select round(avg(cast(y as int)) filter (f), 6) as rate_with, round(avg(cast(y as int)) filter (not f), 6) as rate_without,
      round(avg(cast(y as int)) filter (f) / avg(cast(y as int)) filter (not f), 6) as ratio from m""",
)
def rate_by_match(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("y", (F.col("o_totalprice") > 250000).cast("int"))
    keys = V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    out = M.rate_by_match(J.has_match(o, keys, "o_orderkey", "f"), "y", "f")
    return out.select(_R("rate_with"), _R("rate_without"), _R("ratio"))


@query(
    "login_population", "B14",
    f"""with {V.SQL_LOGINS}, ok as (select * from logins where success),
    c as (select max(ts) as last from ok where not takeover)
    select event_id, cast(not takeover as int) as genuine from ok, c where ts <= last""",
)
def login_population(spark, sf):
    c = S.login_population(V.logins(spark, sf), "clamped")
    return c.select("event_id", (~F.col("takeover")).cast("int").alias("genuine"))


def _sides(train, test, row_id, **cut):
    out = train.select(row_id, F.lit("train").alias("side")).unionByName(test.select(row_id, F.lit("test").alias("side")))
    return out.withColumns({k: F.lit(v) for k, v in cut.items()})


@query(
    "temporal_split_cut", "B15",
    f"with {V.SQL_PAYMENTS} select row_id, case when step <= 250000 then 'train' else 'test' end as side from payments",
)
def temporal_split_cut(spark, sf):
    return _sides(*S.split_at(V.payments(spark, sf), "step", 250000), "row_id")


@query(
    "temporal_split_quantile", "B16",
    f"""with {V.SQL_PAYMENTS}, c as (select quantile_cont(amount, 0.8) as cut from payments),
    v as (select quantile_cont(amount, 0.8) as inner_cut from payments, c where amount <= cut)
    select row_id, case when amount > cut then 'test' when amount > inner_cut then 'validation' else 'train' end as side,
      round(cut, 4) as cut from payments, c, v""",
)
def temporal_split_quantile(spark, sf):
    train, test, cut = S.split_quantile(V.payments(spark, sf), "amount", 0.8)
    inner, val, _ = S.split_quantile(train, "amount", 0.8)
    out = _sides(inner, test, "row_id").unionByName(val.select("row_id", F.lit("validation").alias("side")))
    return out.withColumn("cut", F.round(F.lit(cut), 4))


@query(
    "temporal_split_label", "B17",
    f"""with {V.SQL_LOGINS}, c as (select floor(quantile_cont(cast(epoch_us(ts) as double), 0.6)) as cut from logins where takeover)
    select event_id, case when epoch_us(ts) <= cut then 'train' else 'test' end as side from logins, c""",
)
def temporal_split_label(spark, sf):
    df = V.logins(spark, sf).withColumn("y", F.col("takeover").cast("int"))
    train, test, _ = S.split_label_quantile(df, "ts", "y", 0.6)
    return _sides(train, test, "event_id")


_DRAW = "cast('0x' || substr(sha256('42|' || row_id), 1, 13) as bigint) / 4503599627370496.0"


@query(
    "cap_negatives", "B18,G1",
    f"with {V.SQL_SCORES} select row_id, y from scores where y = 1 union all (select row_id, y from scores where y = 0 order by {_DRAW}, row_id limit 1000)",
)
def cap_negatives(spark, sf):
    return S.cap_negatives(V.scores(spark, sf), "y", 1000, 42, "row_id").select("row_id", "y")


@query(
    "cap_negatives_counts", "B18",
    f"with {V.SQL_SCORES} select y, case when y = 1 then count(*) else least(count(*), 1000) end as n, count(*) as of from scores group by 1",
)
def cap_negatives_counts(spark, sf):
    """Exactly the cap is drawn, and every drawn row is a distinct row of the table."""
    s = V.scores(spark, sf)
    capped = S.cap_negatives(s, "y", 1000, 42, "row_id").groupBy("y").agg(F.count_distinct("row_id").alias("n"))
    return capped.join(s.groupBy("y").agg(F.count(F.lit(1)).alias("of")), "y")


@query("stratified_sample", "A8", f"with {V.SQL_SCORES} select row_id, y from scores where y = 1 or {_DRAW} < 0.02")
def stratified_sample(spark, sf):
    return S.stratified_sample(V.scores(spark, sf), "y", 0.02, 42, "row_id").select("row_id", "y")


@query(
    "country_and_geo", "B19,B20",
    f"""with {V.SQL_EVENTS} select split_part(geo, '-', 1) as country, 'IN-'||split_part(geo, '-', 2) as bucket, count(*) as events
    from identity_events group by all""",
)
def country_and_geo(spark, sf):
    e = V.identity_events(spark, sf)
    region = F.substring_index("geo", "-", -1)
    return e.groupBy(X.country(F.col("geo")).alias("country"), X.coarsen_geo(region).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "risk_tables", "B22",
    f"""with {V.SQL_EVENTS} select event_type, channel,
      case event_type when 'login' then 0.2 when 'transaction' then 0.4 when 'profile_change' then 0.5 when 'onboarding' then 0.6 when 'account_recovery' then 0.8 end as criticality,
      case channel when 'branch' then 0.1 when 'mobile_app' then 0.3 when 'internet_banking' then 0.4 when 'api' then 0.5 when 'admin_console' then 0.7 end as risk,
      count(*) as events from identity_events group by all""",
)
def risk_tables(spark, sf):
    e = V.identity_events(spark, sf).groupBy("event_type", "channel").agg(F.count(F.lit(1)).alias("events"))
    return e.select("event_type", "channel", X.criticality(F.col("event_type")).alias("criticality"),
                    X.channel_risk(F.col("channel")).alias("risk"), "events")


# ---- encodings ------------------------------------------------------------------
@query(
    "frequency_encoding", "D7,C3",
    f"""with {V.SQL_LOGINS}, c as (select floor(quantile_cont(cast(epoch_us(ts) as double), 0.6)) as cut from logins where takeover),
    tr as (select asn from logins, c where epoch_us(ts) <= cut and not takeover),
    f as (select asn, count(*) / (select count(*) from tr) as freq from tr group by 1)
    select event_id, round(coalesce(ln(1 + freq * 1000000), 0.0), 6) as f_asn from logins left join f using (asn)""",
)
def frequency_encoding(spark, sf):
    df = V.logins(spark, sf).withColumn("y", F.col("takeover").cast("int"))
    train, _, _ = S.split_label_quantile(df, "ts", "y", 0.6)
    return E.frequency_encoding(train, df, "asn", "y").select("event_id", _R("f_asn"))


@query(
    "modal_lookup", "C3,D3",
    f"""with {V.SQL_ACTIVITY}, c as (select "user", pc, count(*) as n from activity group by all),
    m as (select "user", pc as modal_pc from c qualify row_number() over (partition by "user" order by n desc, pc) = 1)
    select "user", modal_pc from m""",
)
def modal_lookup(spark, sf):
    a = V.activity(spark, sf)
    users = a.select("user").distinct()
    return J.lookup(users, U.modal_value(a, "user", "pc"), "user", "modal_pc", "none")


# ---- user-day -------------------------------------------------------------------
_UD_SQL = V.SQL_ACTIVITY + """,
c as (select "user", pc, count(*) as n from activity group by all),
m as (select "user", pc as modal_pc from c qualify row_number() over (partition by "user" order by n desc, pc) = 1),
f1 as (select "user", day, count(*) as n_logon, cast(sum(off) as bigint) as n_off_logon, count(distinct pc) as n_pcs,
  cast(sum(cast(pc <> modal_pc as int)) as bigint) as n_other_pc from activity join m using ("user") group by all),
f2 as (select "user", day, count(*) as n_usb, cast(sum(off) as bigint) as n_off_usb from activity where activity = 'click' group by all),
f3 as (select "user", day, count(*) as n_file, cast(sum(off) as bigint) as n_off_file from activity where activity = 'purchase' group by all),
ud as (select "user", day, coalesce(n_logon, 0) as n_logon, coalesce(n_off_logon, 0) as n_off_logon, coalesce(n_pcs, 0) as n_pcs,
  coalesce(n_other_pc, 0) as n_other_pc, coalesce(n_usb, 0) as n_usb, coalesce(n_off_usb, 0) as n_off_usb,
  coalesce(n_file, 0) as n_file, coalesce(n_off_file, 0) as n_off_file
  from f1 full join f2 using ("user", day) full join f3 using ("user", day))"""
MEASURES = ["n_logon", "n_off_logon", "n_pcs", "n_other_pc", "n_usb", "n_off_usb", "n_file", "n_off_file"]
_DEV_SQL = _UD_SQL + ", med as (select \"user\", " + ", ".join(f"median({c}) as m_{c}" for c in MEASURES) + " from ud group by 1), " + \
    "mad as (select \"user\", " + ", ".join(f"median(abs({c} - m_{c})) as d_{c}" for c in MEASURES) + " from ud join med using (\"user\") group by 1), " + \
    "dev as (select ud.*, " + ", ".join(
        f"greatest(coalesce(({c} - m_{c}) / (1.4826 * nullif(d_{c}, 0)), 0.0), 0.0) as dev_{c}" for c in MEASURES
    ) + " from ud join med using (\"user\") join mad using (\"user\"))"
ZSUM = ["n_off_logon", "n_other_pc", "n_off_usb", "n_off_file", "n_usb", "n_file"]
_SCORED_SQL = _DEV_SQL + ", " + V.SQL_WINDOWS + ", scored as (select \"user\", day, round(" + " + ".join(f"dev_{c}" for c in ZSUM) + \
    ", 6) as score, cast(exists (select 1 from windows w where w.\"user\" = dev.\"user\" and day between start_day and end_day) as int) as y from dev)"


def userday(spark, sf):
    a = V.activity(spark, sf)
    return J.full_outer_userday(
        [U.userday_logons(a), U.userday_transfers(a, "click", "usb"), U.userday_transfers(a, "purchase", "file")], ["user", "day"]
    )


def deviations(spark, sf):
    return U.robust_deviation(userday(spark, sf), "user", MEASURES)


def scored_userdays(spark, sf):
    df = U.deviation_sum(deviations(spark, sf), [f"dev_{c}" for c in ZSUM], "score")
    df = df.select("user", "day", _R("score"))
    return J.interval_label(df, V.windows(spark, sf))


@query("userday_activity", "D1,D2,C2", f'with {_UD_SQL} select * from ud')
def userday_activity(spark, sf):
    return userday(spark, sf)


@query(
    "robust_deviation", "D4,D5",
    f'with {_DEV_SQL} select "user", day, ' + ", ".join(f"round(dev_{c}, 6) as dev_{c}" for c in MEASURES) + " from dev",
)
def robust_deviation(spark, sf):
    return deviations(spark, sf).select("user", "day", *[_R(f"dev_{c}") for c in MEASURES])


@query(
    "robust_deviation_causal", "D5",
    f"""with {_UD_SQL}, h as (select "user", day, n_logon, list(n_logon) over (partition by "user" order by day rows between unbounded preceding and 1 preceding) as h from ud),
    hm as (select *, list_median(h) as med from h), d as (select *, list_median(list_transform(h, lambda x: abs(x - med))) as mad from hm)
    select "user", day, round(greatest(coalesce((n_logon - med) / (1.4826 * nullif(mad, 0)), 0.0), 0.0), 6) as dev_n_logon from d""",
)
def robust_deviation_causal(spark, sf):
    d = U.robust_deviation(userday(spark, sf).select("user", "day", "n_logon"), "user", ["n_logon"], causal=True)
    return d.select("user", "day", _R("dev_n_logon"))


@query("deviation_sum", "D6", f'with {_SCORED_SQL} select "user", day, score from scored')
def deviation_sum(spark, sf):
    df = U.deviation_sum(deviations(spark, sf), [f"dev_{c}" for c in ZSUM], "score")
    return df.select("user", "day", _R("score"))


@query("interval_label", "C4", f'with {_SCORED_SQL} select "user", day, y from scored')
def interval_label(spark, sf):
    return J.interval_label(userday(spark, sf).select("user", "day"), V.windows(spark, sf))


@query(
    "top_k_per_day", "E6",
    f'with {_SCORED_SQL} select "user", day, y, row_number() over (partition by day order by score desc, "user") as rank from scored qualify rank <= 10',
)
def top_k_per_day(spark, sf):
    return J.top_k_per_day(scored_userdays(spark, sf), "score", 10).select("user", "day", "y", "rank")


@query(
    "budget_sweep", "D13,E6,C6",
    f"""with {_SCORED_SQL}, r as (select *, row_number() over (partition by day order by score desc, "user") as rank from scored),
    k as (select unnest([5, 10, 25, 50]) as budget),
    t as (select sum(y) as pos, count(distinct "user") filter (y = 1) as users from scored)
    select budget, round(sum(y) / greatest(max(pos), 1), 6) as userday_recall, count(distinct "user") filter (y = 1) as users_found,
      max(users) as users_total, round(count(distinct "user") filter (y = 1) / max(users), 6) as detection_rate
    from r join k on rank <= budget, t group by budget""",
)
def budget_sweep(spark, sf):
    out = budget_table(spark, sf)
    return out.select("budget", _R("userday_recall"), "users_found", "users_total", _R("detection_rate"))


def budget_table(spark, sf):
    from wardline.operators.fairness import budget_sweep as sweep

    return sweep(materialize(scored_userdays(spark, sf)), [5, 10, 25, 50])


@query(
    "budget_by_scenario", "D13,C6,G2,G3",
    f"""with {_SCORED_SQL}, r as (select *, row_number() over (partition by day order by score desc, "user") as rank from scored),
    k as (select unnest([5, 10, 25, 50]) as budget), s as (select distinct "user", scenario from windows),
    found as (select distinct budget, "user" from r join k on rank <= budget where y = 1)
    select budget, scenario, count(f."user") as found, count(*) as total from k cross join s left join found f using (budget, "user") group by all""",
)
def budget_by_scenario(spark, sf):
    from wardline.operators.fairness import budget_by_scenario as by_scenario

    return by_scenario(materialize(scored_userdays(spark, sf)), V.windows(spark, sf), [5, 10, 25, 50])


# ---- joins and sets -------------------------------------------------------------
@query(
    "erasure_anti", "C7,G4",
    f"""with {V.SQL_EVENTS}, t as (select 'u'||c_custkey as identity_id from customer where c_acctbal < 0)
    select event_id, identity_id from identity_events where identity_id not in (select identity_id from t)""",
)
def erasure_anti(spark, sf):
    t = V.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("u"), "c_custkey").alias("identity_id"))
    return J.exclude_erased(V.identity_events(spark, sf), t).select("event_id", "identity_id")


@query(
    "attach_amount", "C8",
    f"with {V.SQL_SCORES} select row_id, y, score, o_totalprice as amount from scores join orders on o_orderkey = row_id",
)
def attach_amount(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("amount"))
    return J.attach_amount(V.scores(spark, sf).select("row_id", "y", "score"), a)


@query("intersect_users", "C6,G3", 'select distinct o_custkey as "user" from orders intersect select c_custkey from customer where c_acctbal > 0')
def intersect_users(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("user"))
    b = V.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user"))
    return J.intersect_users(a, b)


@query(
    "set_operations", "G1-G4",
    """with a as (select user_id, event_type from events where value > 40), b as (select user_id, event_type from events where value <= 40)
    select 'union_all' as op, count(*) as n from (select * from a union all select * from b)
    union all select 'distinct', count(*) from (select distinct * from a)
    union all select 'intersect', count(*) from (select * from a intersect select * from b)
    union all select 'difference', count(*) from (select * from a except select * from b)""",
)
def set_operations(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "value")
    a, b = e.filter("value > 40").drop("value"), e.filter("value <= 40").drop("value")
    parts = {"union_all": J.union_all(a, b), "distinct": J.distinct_pairs(a, ["user_id", "event_type"]),
             "intersect": J.intersect(a, b), "difference": J.difference(a, b)}
    return J.union_all(*[d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()])


# ---- digests --------------------------------------------------------------------
KEY = b"wardline-demo-key"


def sql_hmac(message: str, key: bytes = KEY) -> str:
    """HMAC-SHA256 as DuckDB SQL over a text expression."""
    inner, outer = K._pads(key)
    lit = lambda b: "'" + "".join(f"\\x{x:02X}" for x in b) + "'::blob"
    return f"sha256({lit(outer)} || unhex(sha256({lit(inner)} || encode({message}))))"


@query("pseudonymize", "B21,M1", f"select c_custkey, substr({sql_hmac('c_name')}, 1, 24) as token, {sql_hmac('c_name')} as full_digest from customer")
def pseudonymize(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", K.pseudonymize(F.col("c_name"), KEY).alias("token"), K.hmac_sha256(F.col("c_name"), KEY).alias("full_digest"))
