"""Per-identity drift monitors over a risk series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from wardline import schemas as C
from wardline.operators import ordered as O


def _positions(df, key, order, slicing, pos, risk):
    aggs = {"_n": ("sum", F.lit(1).cast("long")), "_p": ("sum", (F.col(risk) > 0).cast("long"))}
    out = O.running(df, key, [F.col(c) for c in order], aggs, slicing, pos)
    return out.withColumn("_n", F.col("_n") - 1)


def risk_ewma(df: DataFrame, key: list[str], order: list[str], position, risk: str = "risk",
              alpha: float = C.EWMA_ALPHA, hot_rows: int = O.HOT_ROWS, block: int = 8192, slicing: O.Slicing | None = None) -> DataFrame:
    """``ewma`` after and ``ewma_before`` ahead of each row; the first positive risk starts the average.

    Inside a block the average is q^j * running sum of (weight * risk * q^-j). Weights fade below 1e-18 after
    ``halo`` rows, so repeating that many rows in front of a block gives the full-history value to double
    precision and no state has to travel between blocks. ``slicing``: a probe of the same keys that was made already.
    """
    q = 1 - alpha
    halo = math.ceil(math.log(1e-18) / math.log(q)) + 1
    if (block + halo) * -math.log(q) > 650:
        raise ValueError("block too long for this alpha")
    s = slicing or O.probe(df, key, position, hot_rows)
    df = _positions(df, key, order, s, position, risk)
    always = O.Slicing(tuple(key), s.cuts if s.split else df.limit(0))
    size = max(block, halo + 1)
    df, part = O.blocks(df, key, always, "_n", back=halo, size=size)
    j = F.col("_n") - F.col("_block") * size + halo
    start = (F.col("_p") == 1) & (F.col(risk) > 0)
    scaled = F.when(start, F.col(risk)).otherwise(F.lit(alpha) * F.col(risk)) * F.pow(F.lit(q), -j)
    w = Window.partitionBy(*part).orderBy("_n")
    df = df.withColumn("_x", scaled).withColumn(
        "ewma", F.pow(F.lit(q), j) * F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    df = df.withColumn("ewma_before", F.coalesce(F.lag("ewma").over(w), F.lit(0.0)))
    return O.done(df).drop("_x", "_p", "_n")


def risk_cusum(df: DataFrame, key: list[str], order: list[str], position, risk: str = "risk", segment: str | None = None,
               slack: float = C.CUSUM_SLACK, limit: float = C.CUSUM_LIMIT, hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """``cusum`` of the excess over the slow average and ``cusum_fired``.

    max(0, c + d) steps equal S - min(0, min S) for the running sum S, so two running aggregates replace the
    recursion. ``segment`` (a column that changes at each reset) restarts the sum.
    """
    keys = key + ([segment] if segment else [])
    s = O.probe(df, keys, position, hot_rows)
    df = risk_ewma(df, key, order, position, risk, hot_rows=hot_rows, slicing=None if segment else s)
    base = F.when(F.col("ewma_before") > 0, F.col("ewma_before")).otherwise(F.col(risk))
    df = df.withColumn("_d", F.col(risk) - base - slack)
    cols = [F.col(c) for c in order]
    df = O.running(df, keys, cols, {"_s": ("sum", F.col("_d"))}, s, position)
    df = O.running(df, keys, cols, {"_m": ("min", F.col("_s"))}, s, position)
    df = df.withColumn("cusum", F.col("_s") - F.least(F.lit(0.0), F.col("_m")))
    return df.withColumn("cusum_fired", (F.col("cusum") > limit).cast("int")).drop("_d", "_s", "_m")


def shift_test(recent):
    """(shift, ks distance, fired) of an array of the last risks: late half against early half."""
    n = F.size(recent)
    half = F.floor(n / 2).cast("int")
    early, late = F.slice(recent, F.lit(1), F.greatest(half, F.lit(1))), F.slice(recent, half + 1, F.greatest(n - half, F.lit(1)))
    add = lambda a, x: a + x
    mean = lambda a: F.aggregate(a, F.lit(0.0), add) / F.size(a)
    share = lambda a, v: F.size(F.filter(a, lambda x: x <= v)) / F.size(a)
    ks = F.array_max(F.transform(recent, lambda v: F.abs(share(early, v) - share(late, v))))
    shift = mean(late) - mean(early)
    limit = F.lit(None).cast("double")
    for size, d in sorted(C.KS_LIMIT.items()):
        limit = F.when(n == size, F.lit(d)).otherwise(limit)
    fired = (n >= C.SHIFT_MIN) & (shift >= C.SHIFT_SIZE) & (ks >= limit - 1e-9)
    return shift, ks, F.coalesce(fired, F.lit(False)).cast("int")


def mean_shift(df: DataFrame, key: list[str], order: list[str], position, risk: str = "risk", hot_rows: int = O.HOT_ROWS,
               block: int = 100_000) -> DataFrame:
    """``shift`` / ``ks`` / ``shift_fired`` over the last 12 risks (null statistics below 8)."""
    s = O.probe(df, key, position, hot_rows)
    if s.split:
        df = O.ordinal(df, key, [F.col(c) for c in order], s, position, "_n")
    df, part = O.blocks(df, key, s, "_n", back=C.SHIFT_WINDOW - 1, size=block)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(C.SHIFT_WINDOW - 1), 0)
    df = O.done(df.withColumn("_recent", F.collect_list(risk).over(w))).drop("_n")
    shift, ks, fired = shift_test(F.col("_recent"))
    enough = F.size("_recent") >= C.SHIFT_MIN
    return df.withColumns({"shift": F.when(enough, shift), "ks": F.when(enough, ks), "shift_fired": fired}).drop("_recent")
