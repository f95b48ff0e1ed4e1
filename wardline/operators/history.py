"""Causal per-entity history: indices, previous events, travel, novelty and the eleven-feature replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import ordered as O

MICROS = 1_000_000


def _pos(ts: str):
    return X.micros(ts)


def causal_index(df: DataFrame, entity: str, ts: str, row_id: str, out: str, hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """Number of strictly earlier rows of the entity."""
    s = O.probe(df, [entity], _pos(ts), hot_rows)
    return O.ordinal(df, [entity], [F.col(ts), F.col(row_id)], s, _pos(ts), out)


def first_n_split(df: DataFrame, entity: str, ts: str, row_id: str, n: int, out: str = "is_enrol") -> DataFrame:
    """1 for the first n rows of an entity, 0 for the rest. Only n ids per entity are ranked and joined back."""
    w = Window.partitionBy(entity).orderBy(ts, row_id)
    ids = df.select(entity, ts, row_id).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    ids = ids.select(row_id, F.lit(1).alias(out))
    return df.join(ids, row_id, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def previous_event(df: DataFrame, entity: str, ts: str, row_id: str, cols: list[str], hot_rows: int = O.HOT_ROWS,
                   block: int = 100_000) -> DataFrame:
    """Values of the entity's previous row as prev_<col>."""
    s = O.probe(df, [entity], _pos(ts), hot_rows)
    if s.split:
        df = O.ordinal(df, [entity], [F.col(ts), F.col(row_id)], s, _pos(ts), "_n")
        df, part = O.blocks(df, [entity], s, "_n", back=1, size=block)
    else:
        part = [entity]
    w = Window.partitionBy(*part).orderBy(ts, row_id)
    out = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})
    return O.done(out).drop("_n") if s.split else out


def impossible_travel(df: DataFrame, entity: str, ts: str, row_id: str, max_hours: float = 6.0, **kw) -> DataFrame:
    """prev_country, hours_since and the 0/1 flag: country changed in under ``max_hours``."""
    out = previous_event(df, entity, ts, row_id, ["country", ts], **kw)
    hours = (X.micros(ts) - X.micros(f"prev_{ts}")) / (3600.0 * MICROS)
    out = out.withColumn("hours_since", hours)
    flag = F.col("prev_country").isNotNull() & (F.col("country") != F.col("prev_country")) & (F.col("hours_since") < max_hours)
    return out.withColumn("impossible", F.coalesce(flag, F.lit(False)).cast("int")).drop(f"prev_{ts}")


def travel_lift(flagged: DataFrame, takeover: str = "takeover") -> DataFrame:
    """Coverage of takeovers by the travel flag and its rate among genuine logins."""
    t, prior, imp = F.col(takeover) == 1, F.col("prev_country").isNotNull(), F.col("impossible") == 1
    return flagged.agg(
        F.count_if(t).alias("takeovers"),
        F.count_if(t & prior).alias("takeovers_with_prior"),
        F.count_if(t & imp).alias("takeovers_flagged"),
        F.count_if(~t & prior).alias("genuine_with_prior"),
        F.count_if(~t & imp).alias("genuine_flagged"),
        (F.count_if(t & imp) / F.greatest(F.count_if(t & prior), F.lit(1))).alias("takeover_rate"),
        (F.count_if(~t & imp) / F.greatest(F.count_if(~t), F.lit(1))).alias("genuine_rate"),
    )


def trailing_count(df: DataFrame, entity: str, ts: str, seconds: int = 300, out: str = "n_recent",
                   hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """Rows of the entity in (ts - seconds, ts], ties included.

    A row adds 1 at its time and takes 1 away ``seconds`` later, so the count is one running sum; the cost per
    row does not depend on how many rows fall into the window.
    """
    cols = df.columns
    plus = df.withColumns({"_t": _pos(ts), "_d": F.lit(1).cast("long"), "_real": F.lit(True)})
    minus = plus.withColumns({"_t": F.col("_t") + seconds * MICROS, "_d": F.lit(-1).cast("long"), "_real": F.lit(False)})
    both = plus.unionByName(minus.select(entity, "_t", "_d", "_real"), allowMissingColumns=True)
    s = O.probe(df, [entity], _pos(ts), hot_rows)
    run = O.running(both, [entity], [F.col("_t")], {out: ("sum", F.col("_d"))}, s, F.col("_t"), peers=True)
    return run.filter("_real").select(*cols, out)


# ---- novelty, habits, sharing ---------------------------------------------------
def novelty(df: DataFrame, entity: str, value: str, cold: float, out: str, ts: str = "ts", row_id: str = "event_id") -> DataFrame:
    """``cold`` on the entity's first row, else 0 when the value was seen before, else 1."""
    df = O.flag_first(df, [entity], [ts], row_id, "_first")
    df = O.flag_first(df, [entity, value], [ts], row_id, "_new")
    return df.withColumn(out, F.when(F.col("_first") == 1, F.lit(cold)).otherwise(F.col("_new").cast("double"))).drop("_first", "_new")


def _hour_deviation(part: list[str], n: str, order: list[str]):
    """Smallest circular distance to the hours of the last 200 rows.

    There are 24 hours, so it is enough to know the last position of each: 24 running maxima instead of a
    200-element list per row.
    """
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = {f"_h{h}": F.max(F.when(F.col("hour_of_day") == h, F.col(n))).over(w) for h in range(24)}
    gap = []
    for h in range(24):
        d = F.abs(F.col("hour_of_day") - h)
        gap.append(F.when(F.col(f"_h{h}") >= F.col(n) - C.HISTORY, F.least(d, 24 - d)))
    return last, F.coalesce(F.least(*gap) / 12.0, F.lit(0.5))


def _amount_stats(part: list[str], order: list[str]):
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-C.HISTORY, -1)
    return {"_an": F.count("amount").over(w), "_am": F.avg("amount").over(w), "_as": F.stddev_pop("amount").over(w)}


def _amount_z():
    usual = F.least(F.abs(F.col("amount") - F.col("_am")) / (3 * F.greatest(F.col("_as"), F.lit(1.0))), F.lit(1.0))
    cold = F.least(F.col("amount") / C.ABSOLUTE_AMOUNT, F.lit(1.0))
    few = F.coalesce(F.col("_an"), F.lit(0)) < C.MIN_AMOUNTS
    return F.when(F.col("amount").isNull(), F.lit(0.0)).when(few, cold).otherwise(usual)


def sharing_thresholds(events: DataFrame, limit: int = 4) -> DataFrame:
    """Per device the times at which its 1st..4th distinct identity appeared (the feature saturates there)."""
    edges = events.groupBy("device_id", "identity_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    w = Window.partitionBy("device_id").orderBy("first")
    top = edges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return top.groupBy("device_id").agg(F.sort_array(F.collect_list("first")).alias("_firsts"))


def device_sharing(events: DataFrame) -> DataFrame:
    """Add ``device_sharing`` = min((c - 1) / 3, 1), c = identities seen on the device so far (this one too)."""
    out = events.join(sharing_thresholds(events), "device_id", "left")
    now = F.struct("ts", "event_id")
    # the first identity is always there; count how many of the 2nd, 3rd and 4th have appeared
    more = [F.coalesce(F.try_element_at("_firsts", F.lit(i)) <= now, F.lit(False)).cast("int") for i in (2, 3, 4)]
    return out.withColumn("device_sharing", (more[0] + more[1] + more[2]) / 3.0).drop("_firsts")


def device_identity_count(events: DataFrame, out: str = "identities_so_far", hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """Uncapped running count of distinct identities per device."""
    flagged = O.flag_first(events, ["device_id", "identity_id"], ["ts"], "event_id", "_new")
    s = O.probe(events, ["device_id"], _pos("ts"), hot_rows)
    order = [F.col("ts"), F.col("event_id")]
    return O.running(flagged, ["device_id"], order, {out: ("sum", F.col("_new").cast("long"))}, s, _pos("ts")).drop("_new")


def identities_per_device(events: DataFrame, approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return events.groupBy("device_id").agg(f("identity_id").alias("identities"))


def velocity(n):
    """Decaying burst counter burst <- burst/2 + 1 after n earlier events, over 15."""
    return F.least(F.lit(2.0) * (1 - F.pow(F.lit(0.5), n + 1)) / 15.0, F.lit(1.0))


def replay_features(events: DataFrame, behavior: str | None = None, hot_rows: int = O.HOT_ROWS, block: int = 100_000,
                    keep_amount_mean: bool = False) -> DataFrame:
    """All eleven features per event when every earlier event of the identity counts as history.

    Ordinary identities: one shuffle by identity serves every window. When some identity is hot, positions
    come from sliced running counts and look-backs from blocks, so no task holds a whole hot identity.
    """
    key, order = "identity_id", ["ts", "event_id"]
    s = O.probe(events, [key], _pos("ts"), hot_rows)
    df = O.ordinal(events, [key], [F.col(c) for c in order], s, _pos("ts"), "n")
    if not s.split:
        first = lambda v: F.row_number().over(Window.partitionBy(key, v).orderBy(*order)) == 1
        last, hour_dev = _hour_deviation([key], "n", order)
        df = df.withColumns(last).withColumn("hour_deviation", hour_dev).drop(*last)
        df = df.withColumns({"_fd": first("device_id").cast("int"), "_fg": first("geo").cast("int")})
        # rows without an amount stand alone, so they cost no 200-row frame
        df = df.withColumn("_paid", F.when(F.col("amount").isNull(), F.col("n")).otherwise(F.lit(-1)))
        df = df.withColumns(_amount_stats([key, "_paid"], order))
    else:
        df = O.flag_first(df, [key, "device_id"], ["ts"], "event_id", "_fd")
        df = O.flag_first(df, [key, "geo"], ["ts"], "event_id", "_fg")
        df, part = O.blocks(df, [key], s, "n", back=C.HISTORY, size=block)
        last, hour_dev = _hour_deviation(part, "n", order)
        df = O.done(df.withColumns(last).withColumn("hour_deviation", hour_dev).drop(*last))
        paid = df.filter(F.col("amount").isNotNull()).select(key, *order, "amount")
        paid = O.ordinal(paid, [key], [F.col(c) for c in order], s, _pos("ts"), "_m")
        paid, part = O.blocks(paid, [key], s, "_m", back=C.HISTORY, size=block)
        paid = O.done(paid.withColumns(_amount_stats(part, order))).select("event_id", "_an", "_am", "_as")
        df = df.join(paid, "event_id", "left")
    cold = F.col("n") == 0
    df = df.withColumns({
        "new_device": F.when(cold, 0.4).otherwise(F.col("_fd").cast("double")),
        "new_geo": F.when(cold, 0.5).otherwise(F.col("_fg").cast("double")),
        "amount_zscore": _amount_z(),
        "behavior_anomaly": F.coalesce(1 - F.col(behavior), F.lit(C.NEUTRAL_BEHAVIOR)) if behavior else F.lit(C.NEUTRAL_BEHAVIOR),
        "event_criticality": X.criticality(F.col("event_type")),
        "channel_risk": X.channel_risk(F.col("channel")),
        "new_beneficiary": F.col("is_new_beneficiary").cast("double"),
        "recovery_change": F.col("recovery_contact_changed").cast("double"),
        "velocity": velocity(F.col("n")),
    })
    if keep_amount_mean:
        df = df.withColumn("amount_mean", F.col("_am"))
    return device_sharing(df.drop("_fd", "_fg", "_paid", "_an", "_am", "_as"))


def cold_prior(df: DataFrame) -> DataFrame:
    """Halve both novelty features on an identity's first event when it has a benign shape."""
    ok = (F.col("n") == 0) & X.cold_prior_applies(
        F.col("event_type"), F.col("channel"), F.col("is_new_beneficiary"), F.col("recovery_contact_changed"), F.col("amount")
    )
    f = F.when(ok, C.COLD_FACTOR).otherwise(F.lit(1.0))
    return df.withColumns({"new_device": F.col("new_device") * f, "new_geo": F.col("new_geo") * f})


def replay_head(df: DataFrame, entity: str, ts: str, row_id: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of the replay order (a take-ordered, so each task sends at most ``limit``)."""
    return df.orderBy(entity, ts, row_id).limit(limit)
