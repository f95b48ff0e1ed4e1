"""Identity-risk views over the generic test tables, as DataFrames and as the equal SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.functions import expr as X
from wardline.operators import ordered as O


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def identity_events(spark: SparkSession, sf: str) -> DataFrame:
    e = base_events(spark, sf)
    e = O.flag_first(e, ["user_id", "k"], ["ts"], "event_id", "_payee", where=F.col("event_type") == "purchase")
    et, u = F.col("event_type"), F.col("user_id")
    mapped = (
        F.when(et == "view", "login").when(et == "click", "profile_change").when(et == "purchase", "transaction")
        .when(et == "signup", "onboarding").otherwise("account_recovery")
    )
    channel = (
        F.when(u % 5 == 0, "branch").when(u % 5 == 1, "mobile_app").when(u % 5 == 2, "internet_banking")
        .when(u % 5 == 3, "api").otherwise("admin_console")
    )
    return e.select(
        "event_id", "ts", F.concat(F.lit("u"), u).alias("identity_id"), mapped.alias("event_type"),
        channel.alias("channel"), F.concat(F.lit("d"), "k").alias("device_id"),
        F.concat(F.lit("C"), F.col("k") % 5, F.lit("-R"), F.col("k") % 20).alias("geo"),
        F.hour("ts").alias("hour_of_day"),
        F.when(et == "purchase", F.col("value") * 100).alias("amount"),
        (F.col("_payee") == 1).alias("is_new_beneficiary"),
        ((et == "error") & (F.col("k") % 10 == 0)).alias("recovery_contact_changed"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    y = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), y.alias("y"),
        (((F.col("o_orderkey") * 7919) % 700 + 300 * y) / 1000.0).alias("score"),
        F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("user_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("rule_flag"),
    )


def score_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors over the same rows in long format."""
    s = scores(spark, sf)
    alt = ((F.col("row_id") * 104729) % 800 + 150 * F.col("y")) / 1000.0
    pair = F.array(
        F.struct(F.lit("main").alias("variant"), F.col("score").alias("score")),
        F.struct(F.lit("alt").alias("variant"), alt.alias("score")),
    )
    return s.withColumn("_v", F.explode(pair)).select(
        "row_id", "y", "amount", "user_id", "rule_flag", "_v.variant", "_v.score"
    )


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return base_events(spark, sf).select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("user"), F.to_date("ts").alias("day"), "ts",
        F.concat(F.lit("d"), "k").alias("pc"), F.col("event_type").alias("activity"),
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr("date_add(date'2024-01-10', cast(c_custkey % 10 as int))")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("u"), "c_custkey").alias("user"), start.alias("start_day"),
        F.date_add(start, 3).alias("end_day"), (F.col("c_custkey") % 3 + 1).cast("int").alias("scenario"),
    )


def payments(spark: SparkSession, sf: str) -> DataFrame:
    """Payment log: orders with the customer's balance as the payer's and a supplier-like payee."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    step = (X.micros("o_orderdate") / 3_600_000_000).cast("long") + F.col("o_orderkey") % 24
    df = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    k = F.col("o_orderkey")
    return df.select(
        k.alias("row_id"), step.alias("step"), F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("C"), "o_custkey").alias("nameOrig"),
        F.concat(F.when(k % 3 == 0, "M").otherwise("C"), (k % 97).cast("string")).alias("nameDest"),
        F.when(k % 11 == 0, F.col("o_totalprice")).otherwise(F.abs("c_acctbal") * 40).alias("oldbalanceOrg"),
        F.when(k % 4 == 0, F.lit(0.0)).otherwise(F.abs("c_acctbal") * 30).alias("newbalanceOrig"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.abs("c_acctbal") * 7).alias("oldbalanceDest"),
        (F.abs("c_acctbal") * 9).alias("newbalanceDest"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("isFraud"),
        (F.col("o_orderstatus") == "F").cast("int").alias("isFlaggedFraud"),
    )


def logins(spark: SparkSession, sf: str) -> DataFrame:
    """Login log over the event table: success, takeover, raw round-trip text and version strings."""
    e = base_events(spark, sf)
    k = F.col("k")
    return e.select(
        "event_id", "ts", F.concat(F.lit("u"), "user_id").alias("user"),
        F.concat(F.lit("C"), k % 5).alias("country"), (k % 37).alias("asn"),
        F.concat(F.when(k % 2 == 0, "Chrome Mobile ").otherwise("Firefox "), (k % 13).cast("string")).alias("browser_full"),
        F.concat(F.when(k % 3 == 0, "Android ").otherwise("iOS "), (k % 7).cast("string")).alias("os_full"),
        F.when(k % 4 == 0, "mobile").when(k % 4 == 1, "desktop").alias("device_type"),
        F.when(k % 9 == 0, F.lit("n/a")).otherwise((F.col("value") * 10).cast("string")).alias("rtt_ms"),
        (F.col("event_type") != "error").alias("success"),
        ((F.col("event_type") == "purchase") & (k % 10 == 3)).alias("takeover"),
    )


# ---- the same views as SQL ------------------------------------------------------
SQL_EVENTS = """b as (
  select event_id, ts, user_id, event_type et, value, cast(props->>'$.k' as int) k from events),
identity_events as (
  select event_id, ts, 'u'||user_id as identity_id,
    case et when 'view' then 'login' when 'click' then 'profile_change' when 'purchase' then 'transaction'
            when 'signup' then 'onboarding' else 'account_recovery' end as event_type,
    case user_id%5 when 0 then 'branch' when 1 then 'mobile_app' when 2 then 'internet_banking'
                   when 3 then 'api' else 'admin_console' end as channel,
    'd'||k as device_id, 'C'||(k%5)||'-R'||(k%20) as geo, cast(hour(ts) as int) as hour_of_day,
    case when et='purchase' then value*100 end as amount,
    (et='purchase' and row_number() over (partition by user_id, k, et order by ts, event_id)=1) as is_new_beneficiary,
    (et='error' and k%10=0) as recovery_contact_changed
  from b)"""
SQL_SCORES = """scores as (
  select o_orderkey as row_id, cast(o_orderpriority='1-URGENT' as int) as y,
    (((o_orderkey*7919)%700) + 300*cast(o_orderpriority='1-URGENT' as int))/1000.0 as score,
    o_totalprice as amount, o_custkey as user_id, cast(o_orderstatus='F' as int) as rule_flag
  from orders)"""
SQL_VARIANTS = SQL_SCORES + """,
variants as (
  select row_id, y, amount, user_id, rule_flag, 'main' as variant, score from scores
  union all
  select row_id, y, amount, user_id, rule_flag, 'alt', ((row_id*104729)%800 + 150*y)/1000.0 from scores)"""
SQL_ACTIVITY = """activity as (
  select event_id, 'u'||user_id as "user", cast(ts as date) as day, ts, 'd'||(props->>'$.k') as pc,
    event_type as activity, cast(hour(ts) < 6 or hour(ts) >= 20 as int) as off from events)"""
SQL_WINDOWS = """windows as (
  select 'u'||c_custkey as "user", cast('2024-01-10' as date)+cast(c_custkey%10 as int) as start_day,
    cast('2024-01-10' as date)+cast(c_custkey%10+3 as int) as end_day, cast(c_custkey%3+1 as int) as scenario
  from customer)"""
SQL_PAYMENTS = """payments as (
  select o_orderkey as row_id, epoch_us(o_orderdate)//3600000000 + o_orderkey%24 as step, o_totalprice as amount,
    'C'||o_custkey as nameOrig, case when o_orderkey%3=0 then 'M' else 'C' end||(o_orderkey%97) as nameDest,
    case when o_orderkey%11=0 then o_totalprice else abs(c_acctbal)*40 end as oldbalanceOrg,
    case when o_orderkey%4=0 then 0.0 else abs(c_acctbal)*30 end as newbalanceOrig,
    case when o_orderkey%5=0 then 0.0 else abs(c_acctbal)*7 end as oldbalanceDest,
    abs(c_acctbal)*9 as newbalanceDest, cast(o_orderpriority='1-URGENT' as int) as isFraud,
    cast(o_orderstatus='F' as int) as isFlaggedFraud
  from orders join customer on c_custkey = o_custkey)"""
SQL_LOGINS = """logins as (
  select event_id, ts, 'u'||user_id as "user", 'C'||(k%5) as country, k%37 as asn,
    case when k%2=0 then 'Chrome Mobile ' else 'Firefox ' end||(k%13) as browser_full,
    case when k%3=0 then 'Android ' else 'iOS ' end||(k%7) as os_full,
    case k%4 when 0 then 'mobile' when 1 then 'desktop' end as device_type,
    case when k%9=0 then 'n/a' else cast(value*10 as varchar) end as rtt_ms,
    event_type <> 'error' as success, (event_type='purchase' and k%10=3) as takeover
  from (select *, cast(props->>'$.k' as int) k from events))"""
