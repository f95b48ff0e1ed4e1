"""User-day activity tables and per-user robust deviations."""

from __future__ import annotations

import json
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window, functions as F, types as T

from wardline.functions import expr as X
from wardline.streaming.keyed import keyed_fold

MAD_SCALE = 1.4826


def pc_rollup(df: DataFrame, user: str = "user", pc: str = "pc") -> DataFrame:
    """(user, day, pc) counts: the pre-aggregate every logon measure is built from."""
    return df.groupBy(user, "day", pc).agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.off_hours(F.col("ts"))).alias("n_off")
    )


def modal_value(df: DataFrame, key: str, column: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per key, smallest value on ties."""
    counts = df.groupBy(key, column).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(f"modal_{column}"))


def userday_logons(df: DataFrame) -> DataFrame:
    """Per user-day: logons, off-hours logons, distinct machines, logons on another than the usual machine."""
    rollup = pc_rollup(df)
    modal = modal_value(rollup, "user", "pc", "n")
    other = F.when(F.col("pc") != F.col("modal_pc"), F.col("n")).otherwise(0)
    return rollup.join(modal, "user").groupBy("user", "day").agg(
        F.sum("n").alias("n_logon"), F.sum("n_off").alias("n_off_logon"),
        F.count(F.lit(1)).alias("n_pcs"), F.sum(other).alias("n_other_pc"),
    )


def userday_transfers(df: DataFrame, activity: str | None, name: str) -> DataFrame:
    """Per user-day count and off-hours count of one activity."""
    src = df.filter(F.col("activity") == activity) if activity else df
    return src.groupBy("user", "day").agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.sum(X.off_hours(F.col("ts"))).alias(f"n_off_{name}")
    )


def robust_deviation(df: DataFrame, key: str, cols: list[str], causal: bool = False, order: str = "day") -> DataFrame:
    """dev_<c> = max(0, (x - median) / (1.4826 * mad)); zero spread gives 0.

    ``causal`` uses only the key's earlier rows (their running median and the spread around it), so no future
    day leaks in. The rows of a key stream through a sorted list of its earlier values, which answers both in logarithmic time.
    """
    if not causal:
        # one shuffle by key serves both medians; a key has one row per day, so its group is bounded
        w = Window.partitionBy(key)
        out = df.withColumns({f"med_{c}": F.median(c).over(w) for c in cols})
        out = out.withColumns({f"mad_{c}": F.median(F.abs(F.col(c) - F.col(f"med_{c}"))).over(w) for c in cols})
        med = {c: F.col(f"med_{c}") for c in cols}
        mad = {c: F.col(f"mad_{c}") for c in cols}
    else:
        out = _earlier_medians(df, key, cols, order)
        med, mad = {c: F.col(f"med_{c}") for c in cols}, {c: F.col(f"mad_{c}") for c in cols}
    dev = {
        f"dev_{c}": F.greatest(
            F.coalesce((F.col(c) - med[c]) / (F.lit(MAD_SCALE) * F.nullif(mad[c], F.lit(0))), F.lit(0.0)), F.lit(0.0)
        )
        for c in cols
    }
    return out.withColumns(dev).drop(*[f"med_{c}" for c in cols], *[f"mad_{c}" for c in cols])


class Past:
    """Values in order, with their median and their median distance from a point."""

    def __init__(self, values=()):
        self.values = list(values)

    def add(self, x: float) -> None:
        insort(self.values, x)

    def _middle(self, at) -> float | None:
        n = len(self.values)
        return (at((n - 1) // 2) + at(n // 2)) / 2 if n else None

    def median(self) -> float | None:
        return self._middle(self.values.__getitem__)

    def spread(self, centre: float | None) -> float | None:
        return self._middle(lambda k: self._gap(k, centre))

    def _gap(self, k: int, centre: float) -> float:
        """The k-th smallest distance from ``centre``: distances grow to both sides of it, so the rank is found by halving how many lie on the left."""
        v, split = self.values, bisect_left(self.values, centre)
        lo, hi = max(0, k + 1 - (len(v) - split)), min(k + 1, split)
        while lo < hi:  # the least number of left values such that the next left one is no nearer than the last right one taken
            left = (lo + hi) // 2
            if v[split + k - left] - centre > centre - v[split - 1 - left]:
                lo = left + 1
            else:
                hi = left
        right = k + 1 - lo
        return max(centre - v[split - lo] if lo else 0.0, v[split + right - 1] - centre if right else 0.0)


def _earlier_medians(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """Add med_<c> and mad_<c> of the key's earlier rows (null before the first value); a key has one row per ``order``."""
    def step(past: dict, row):
        seen = tuple(x for c in cols for m in [past[c].median()] for x in (m, past[c].spread(m)))
        for c in cols:
            x = getattr(row, f"v_{c}")
            if x is not None and x == x:
                past[c].add(float(x))
        return *(getattr(row, f"k_{n}") for n in ids), *seen

    ids = [key, order]
    src = df.select(*[F.col(n).alias(f"k_{n}") for n in ids], *[F.col(c).cast("double").alias(f"v_{c}") for c in cols])
    at = F.col(f"k_{order}")
    position = at.cast("double") if isinstance(df.schema[order].dataType, T.NumericType) else X.micros(at).cast("double")
    schema = ", ".join([f"k_{n} {df.schema[n].dataType.simpleString()}" for n in ids] + [f"{m}_{c} double" for c in cols for m in ("med", "mad")])
    found = keyed_fold(src, f"k_{key}", [f"k_{order}"], lambda: {c: Past() for c in cols}, step, schema, position=position,
                       dump=lambda past: json.dumps({c: p.values for c, p in past.items()}), load=lambda text: {c: Past(v) for c, v in json.loads(text).items()})
    return df.join(found, F.col(key).eqNullSafe(F.col(f"k_{key}")) & F.col(order).eqNullSafe(F.col(f"k_{order}"))).drop(*[f"k_{n}" for n in ids])


def deviation_sum(df: DataFrame, cols: list[str], out: str = "score_zsum") -> DataFrame:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return df.withColumn(out, total)
