"""Joins and set operations.

No broadcast hints on inputs that can grow: Spark measures both sides at run time, broadcasts what is small
and splits skewed partitions of what is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def left_join_flag(left: DataFrame, right: DataFrame, on: str, flag: str = "has_match") -> DataFrame:
    """Left join with a 0/1 column telling whether a partner exists."""
    marked = right.withColumn(flag, F.lit(1))
    return left.join(marked, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def has_match(df: DataFrame, keys: DataFrame, on: str, flag: str = "has_match") -> DataFrame:
    return left_join_flag(df, keys.select(on).distinct(), on, flag)


def full_outer_userday(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer combination of pre-aggregated tables as one union and one aggregate (one shuffle).

    Each measure appears in one input only and each input has one row per key.
    """
    measures = [c for f in frames for c in f.columns if c not in keys]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return wide.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Look a value up in a table with one row per key; unseen keys get the default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def interval_label(userday: DataFrame, windows: DataFrame, out: str = "y") -> DataFrame:
    """1 when the day lies inside any of the user's windows; overlapping windows never duplicate a row."""
    w = windows.select(F.col("user").alias("_u"), F.col("start_day").alias("_from"), F.col("end_day").alias("_to"))
    joined = userday.join(w, F.col("user") == F.col("_u"), "left")
    inside = F.coalesce(F.col("day").between(F.col("_from"), F.col("_to")), F.lit(False)).cast("int")
    # rows stay hashed by user after the join, so the collapse to one row per day needs no further shuffle
    return joined.groupBy(*userday.columns).agg(F.max(inside).alias(out))


def impostor_pairs(templates: DataFrame, attempts: DataFrame, subject: str, grid: int = 4) -> DataFrame:
    """Every template against the attempts of every other subject.

    The protocol needs subjects x attempts rows. Both sides are laid out on a grid of hash cells and joined on
    the cell, so the work is an equi join over grid*grid even cells instead of one nested loop.
    """
    cells = F.array(*[F.lit(i) for i in range(grid)])
    t = templates.withColumnRenamed(subject, "template_subject")
    t = t.withColumn("_i", F.pmod(F.xxhash64("template_subject"), F.lit(grid)).cast("int")).withColumn("_j", F.explode(cells))
    a = attempts.withColumn("_j", F.pmod(F.xxhash64(*attempts.columns), F.lit(grid)).cast("int")).withColumn("_i", F.explode(cells))
    return t.join(a, ["_i", "_j"]).filter(F.col("template_subject") != F.col(subject)).drop("_i", "_j")


def intersect_users(a: DataFrame, b: DataFrame, on: str = "user") -> DataFrame:
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_semi")


def exclude_erased(df: DataFrame, tombstones: DataFrame, on: str = "identity_id") -> DataFrame:
    return df.join(tombstones.select(on).distinct(), on, "left_anti")


def attach_amount(scores: DataFrame, amounts: DataFrame, on: str = "row_id") -> DataFrame:
    return scores.join(amounts.select(on, "amount"), on, "left")


def successor_join(chain: DataFrame, shard: str = "shard") -> DataFrame:
    """Each record beside its predecessor (seq - 1): an equi join that spreads over (shard, seq)."""
    prev = chain.select(
        F.col(shard).alias("_s"), (F.col("seq") + 1).alias("_q"), F.col("hash").alias("actual_prev_hash")
    )
    return chain.join(prev, (chain[shard] == F.col("_s")) & (chain["seq"] == F.col("_q")), "left").drop("_s", "_q")


def bind_tokens(events: DataFrame, attest: DataFrame, behavior: DataFrame) -> DataFrame:
    """Events whose attestation and behaviour tokens name the same device and identity."""
    a = attest.select("event_id", F.col("device_id").alias("_ad"))
    b = behavior.select("event_id", F.col("device_id").alias("_bd"), F.col("identity_id").alias("_bi"), "similarity")
    out = events.join(a, "event_id", "left").join(b, "event_id", "left")
    bound = (F.col("_ad") == F.col("device_id")) & (F.col("_bd") == F.col("device_id")) & (F.col("_bi") == F.col("identity_id"))
    return out.withColumn("bound_similarity", F.when(bound, F.col("similarity"))).drop("_ad", "_bd", "_bi", "similarity")


# ---- set operations -------------------------------------------------------------
def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


# ---- ranking --------------------------------------------------------------------
def first_event(df: DataFrame, entity: str, ts: str, row_id: str) -> DataFrame:
    """Earliest row per entity. The rank filter lets Spark keep one row per task before the shuffle."""
    w = Window.partitionBy(entity).orderBy(ts, row_id)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_k_per_day(df: DataFrame, score: str, k: int, day: str = "day", tie: str = "user") -> DataFrame:
    """The k best rows per day, rank included; each task pre-limits to k per day before the shuffle."""
    w = Window.partitionBy(day).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
