"""Standard scaling with population statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std per column, zero std counting as 1; the statistics are one scalar subquery."""
    src = fit_on if fit_on is not None else df
    parts = [x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    stats = src.agg(*parts).select(F.struct("*").alias("stats")).scalar()
    out = {}
    for c in cols:
        sd = stats[f"s_{c}"]
        out[c + suffix] = (F.col(c) - stats[f"m_{c}"]) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumns(out)
