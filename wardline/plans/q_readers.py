"""Tables written to a fresh folder with awkward values and read back through the readers and the decision sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.operators import splits as S
from wardline.plans import fixtures as V
from wardline.plans.registry import query
from wardline.session import checkpoint_dir
from wardline.sources import readers as R, tables as TB


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv(df, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.csv(path, header=True)
    return path


@query(
    "decision_sink", "A10",
    """with d as (select event_id, case when event_id % 7 <> 0 then ts end as ts, event_type as decision, event_id % 2 as batch from events
        union all select event_id, ts + interval 3 day, 'RESENT', 1 from events where event_id % 5 = 0
        union all select -event_id, ts, 'NEW', 2 from events where event_id % 499 = 0
        union all select event_id, null, 'AGAIN', 2 from events where event_id % 499 = 0),
    f as (select *, min(batch) over (partition by event_id) as lot from d)
    select event_id, ts, decision from f where batch = lot qualify row_number() over (partition by event_id order by ts nulls first, decision) = 1""",
)
def decision_sink(spark, sf):
    """Two overlapping batches of all events with resends on other days and without a time, a replay of the second, and a small third batch of new and
    stored ids, which looks its ids up through the key filters."""
    e = V.table(spark, sf, "events").select("event_id", "ts", "event_type")
    resent = e.filter(F.col("event_id") % 5 == 0).select("event_id", F.col("ts") + F.expr("interval 3 day"), F.lit("RESENT"))
    first = e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"), F.col("event_type").alias("decision"))
    few = e.filter(F.col("event_id") % 499 == 0)
    second = first.filter(F.col("event_id") % 2 == 1).union(resent)
    third = few.select((-F.col("event_id")).alias("event_id"), "ts", F.lit("NEW").alias("decision")).union(few.select("event_id", F.lit(None).cast(e.schema["ts"].dataType), F.lit("AGAIN")))
    path = _folder(spark, "decisions")
    for batch in (first.filter(F.col("event_id") % 2 == 0), second, second, third):
        TB.append_new_decisions(batch, path)
    return spark.read.parquet(path).select("event_id", "ts", "decision")


@query(
    "read_payments", "A1",
    f"with {V.SQL_PAYMENTS} select cast(step as int) as step, round(amount, 4) as amount, nameOrig, nameDest, isFraud, isFlaggedFraud from payments",
)
def read_payments(spark, sf):
    p = V.payments(spark, sf).withColumn("type", F.lit("TRANSFER"))
    back = R.read_payments(spark, _csv(p.select(*[F.col(f.name) for f in C.PAYMENTS]), "payments"))
    return back.select(F.col("step").cast("int").alias("step"), F.round("amount", 4).alias("amount"), "nameOrig", "nameDest", F.col("isFraud").cast("int").alias("isFraud"),
                       F.col("isFlaggedFraud").cast("int").alias("isFlaggedFraud"))


@query(
    "read_logins", "A3",
    f"""with {V.SQL_LOGINS} select event_id, ts, "user" as user_id, country, event_id % 3 = 0 as success, takeover, event_id % 5 = 0 as attack_ip from logins where event_id % 10 <> 0""",
)
def read_logins(spark, sf):
    """Padded headers, text booleans in several spellings, unreadable times."""
    e = V.logins(spark, sf)
    i = F.col("event_id")
    named = {v: k for k, v in C.LOGIN_COLUMNS.items()}
    ts = F.when(i % 10 == 0, F.lit("not a time")).otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" ")))
    cols = {"login_ts": ts, "user_id": F.col("user"), "country": F.col("country"), "asn": i.cast("string"),
            "success": F.when(i % 3 == 0, F.lit("True")).otherwise("false"), "attack_ip": F.when(i % 5 == 0, F.lit("TRUE")).otherwise("False"),
            "takeover": F.when(F.col("takeover"), F.lit("true")).otherwise("False")}
    path = _csv(e.select(*[c.alias(f" {named[k]} ") for k, c in cols.items()]), "logins")
    back = R.read_logins(spark, path)
    return back.select(F.col("asn").cast("long").alias("event_id"), "ts", "user_id", "country", "success", "takeover", "attack_ip")


@query(
    "read_activity", "A5",
    f"""with {V.SQL_ACTIVITY} select event_id, "user", pc, activity, case when event_id % 13 <> 0 then date_trunc('second', ts) end as ts,
      case when event_id % 13 <> 0 then day end as day from activity""",
)
def read_activity(spark, sf):
    a = V.activity(spark, sf)
    date = F.when(F.col("event_id") % 13 == 0, F.lit("31/31/2024")).otherwise(F.date_format("ts", R.ACTIVITY_FORMAT))
    path = _csv(a.select(F.col("event_id").alias("id"), date.alias("date"), "user", "pc", "activity"), "activity")
    return R.read_activity(spark, path, "logon").select(F.col("id").cast("long").alias("event_id"), "user", "pc", "activity", "ts", "day")


@query("read_windows", "A5", f"""with {V.SQL_WINDOWS} select "user", scenario, start_day, end_day from windows where scenario <> 2""")
def read_windows(spark, sf):
    w = V.windows(spark, sf)
    day = lambda c: F.when(F.col("scenario") == 1, F.date_format(c, "MM/dd/yyyy 00:00:00")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    path = _csv(w.select(F.when(F.col("scenario") == 2, F.lit("5.2")).otherwise("4.2").alias("dataset"), "user", "scenario", day("start_day").alias("start"),
                         day("end_day").alias("end")), "windows")
    return R.read_windows(spark, path, "4.2")


def _card_sql(i: int, c: str) -> str:
    return f"case when o_orderkey % {i + 11} <> 0 then cast((o_orderkey * {i + 3}) % 997 as double) / 4 end as \"{c}\""


@query(
    "read_card_txns", "A2",
    "select o_orderkey as \"TransactionID\", cast(o_custkey as double) as \"TransactionDT\", cast(o_orderstatus = 'F' as int) as \"isFraud\", "
    + ", ".join(_card_sql(i, c) for i, c in enumerate(C.CARD_NUM)) + ", "
    + ", ".join(f"case when o_orderkey % {i + 5} <> 0 then 'v' || (o_orderkey % {i + 2}) end as \"{c}\"" for i, c in enumerate(C.CARD_CAT)) + " from orders",
)
def read_card_txns(spark, sf):
    """All wanted columns of a wider file, with unreadable numbers and empty categories."""
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey")
    num = [F.when(k % (i + 11) != 0, ((k * (i + 3)) % 997 / 4).cast("string")).otherwise("n/a").alias(c) for i, c in enumerate(C.CARD_NUM)]
    cat = [F.when(k % (i + 5) != 0, F.concat(F.lit("v"), (k % (i + 2)).cast("string"))).alias(c) for i, c in enumerate(C.CARD_CAT)]
    wide = o.select(F.lit("unused").alias("V1"), *cat, k.alias("TransactionID"), F.col("o_custkey").alias("TransactionDT"), (F.col("o_orderstatus") == "F").cast("int").alias("isFraud"), *num)
    return R.read_card_txns(spark, _csv(wide, "card"))


@query(
    "read_keystrokes", "A4",
    """select 's' || (l_suppkey % 20) as subject, cast(l_linenumber as int) as "sessionIndex", cast(l_orderkey % 50 as int) as rep, case when l_orderkey % 9 <> 0 then l_quantity / 100 end as "H_period",
    cast(l_partkey as double) as "DD_period_t", cast(l_extendedprice as double) as "UD_t_i" from lineitem""",
)
def read_keystrokes(spark, sf):
    """Feature names with dots, and times that cannot be read."""
    li = V.table(spark, sf, "lineitem")
    raw = li.select(F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("subject"), F.col("l_linenumber").alias("sessionIndex"), (F.col("l_orderkey") % 50).alias("rep"),
                    F.when(F.col("l_orderkey") % 9 != 0, (F.col("l_quantity") / 100).cast("string")).otherwise("?").alias("H.period"),
                    F.col("l_partkey").alias("DD.period.t"), F.col("l_extendedprice").alias("UD.t.i"))
    df, names = R.read_keystrokes(spark, _csv(raw, "keystrokes"))
    return df.select("subject", "sessionIndex", "rep", *names)


@query(
    "saved_table", "A6,A7",
    "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'F' group by 1",
)
def saved_table(spark, sf):
    path = _folder(spark, "table")
    TB.save_table(V.table(spark, sf, "orders"), path, ["o_orderstatus"])
    return (TB.load_table(spark, path).filter("o_orderstatus = 'F'").groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query(
    "file_manifest", "A14",
    """select cast(c_custkey // 50 as bigint) as lot, count(*) as customers,
        case when (c_custkey // 50) % 7 = 1 then 'mismatch' when (c_custkey // 50) % 7 = 2 then 'missing' else 'ok' end as status from customer group by 1, 3""",
)
def file_manifest(spark, sf):
    """A file for every 50 customers with their names, some listed with a wrong digest and some not there."""
    folder = _folder(spark, "files")
    lots = (V.table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("lot"))
            .agg(F.count(F.lit(1)).alias("customers"), F.concat_ws(" ", F.sort_array(F.collect_list("c_name"))).alias("text")))
    lots.filter("lot % 7 <> 2").select("text", "lot").write.partitionBy("lot").text(folder)
    listed = lots.select(F.col("lot").cast("string").alias("file"), "lot", "customers",
                         F.when(F.col("lot") % 7 == 1, F.lit("0" * 64)).otherwise(F.sha2(F.concat("text", F.lit("\n")), 256)).alias("sha256"))
    return R.verify_manifest(spark, f"{folder}/*", listed, name=r"lot=([^/]+)/").select("lot", "customers", "status")


@query("stratified_all", "A8", "select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag = 'R'")
def stratified_all(spark, sf):
    """With a share of zero only the positives stay."""
    l = V.table(spark, sf, "lineitem").withColumn("pos", (F.col("l_returnflag") == "R").cast("int"))
    return S.stratified_sample(l, "pos", 0.0, 3, "l_orderkey").select("l_orderkey", "l_linenumber", "l_returnflag")
