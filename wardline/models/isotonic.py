"""Isotonic regression as blocks that merge: score ranges are pooled side by side, then neighbouring ranges together, level by level.

Pooling adjacent violators may be done in any grouping: the blocks of a range stand for all its rows when ranges are merged. A fit on
whole-number labels leaves at most about n ** (2 / 3) blocks of n rows (corners of a convex line on a grid), so even the last merge, which streams
through one task, is small; no list of rows or blocks passes through the driver unless its checked size allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import materialize

BLOCK = "part long, low double, high double, total double, weight double"
NAMES = ["part", "low", "high", "total", "weight"]


class Pool:
    """Adjacent blocks in order of score; one with a mean not above its predecessor's is pooled with it."""

    def __init__(self):
        self.blocks: list[list[float]] = []

    def add(self, low: float, high: float, total: float, weight: float) -> None:
        stack = self.blocks
        while stack and stack[-1][2] * weight >= total * stack[-1][3]:
            low, _, before, heavy = stack.pop()
            total, weight = total + before, weight + heavy
        stack.append([low, high, total, weight])

    def rows(self, part: int) -> pd.DataFrame:
        return pd.DataFrame([(part, *b) for b in self.blocks], columns=NAMES)


def _pooled(batches: Iterator[pd.DataFrame], number) -> Iterator[pd.DataFrame]:
    """Pool the rows of each part; rows come in order of (part, low)."""
    part, pool = None, Pool()
    for pdf in batches:
        for row in zip(pdf["part"].tolist(), *(pdf[c].tolist() for c in NAMES[1:])):
            if row[0] != part:
                if part is not None:
                    yield pool.rows(number(part))
                part, pool = row[0], Pool()
            pool.add(*row[1:])
    if part is not None:
        yield pool.rows(number(part))


def isotonic_blocks(rows: DataFrame, label: str = "y", score: str = "score", fan_in: int = 8, ranges: int | None = None) -> DataFrame:
    """Blocks (low, high, value, weight) of the least-squares non-decreasing fit of ``label`` on ``score``, in no order.

    Ties of the score are combined first. ``ranges`` score ranges (not given: as Spark deals them) are pooled in parallel; then ``fan_in`` neighbours
    at a time merge until one part is left. Rows without a score or a label are left out; without any rows there are no blocks.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    ties = rows.filter(s.isNotNull() & ~F.isnan(s) & y.isNotNull()).groupBy(s.alias("low")).agg(F.sum(y).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    dealt = (ties.repartitionByRange(ranges, "low") if ranges else ties.repartitionByRange("low")).sortWithinPartitions("low")
    first = dealt.select(F.lit(0).cast("long").alias("part"), "low", F.col("low").alias("high"), "total", "weight")
    # partitions of a range shuffle are numbered in order of their ranges
    blocks = materialize(first.mapInPandas(lambda b: _pooled(b, lambda _: TaskContext.get().partitionId()), BLOCK))
    while blocks.select("part").distinct().count() > 1:
        group = F.floor(F.col("part") / fan_in).cast("long").alias("part")
        near = blocks.select(group, *NAMES[1:]).repartition("part").sortWithinPartitions("part", "low")
        blocks = materialize(near.mapInPandas(lambda b: _pooled(b, lambda part: part), BLOCK))
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")


def _line(score: Column, xs: list[float], ys: list[float]) -> Column:
    @F.pandas_udf("double")
    def at(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, np.interp(x, xs, ys)), dtype="float64").where(x.notna(), None)

    return at(score.cast("double"))


def isotonic_map(blocks: DataFrame, most: int = 200_000):
    """A map (DataFrame, score column, name of the new column) -> DataFrame that applies a fit: constant within a block, straight lines between
    blocks, constant beyond the ends; null without a score. Up to ``most`` blocks travel with the plan; of more, each stretch of ``most``
    blocks serves the rows whose scores it covers."""
    n = blocks.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    stretches = -(-n // most)
    ordered = blocks.select("low", "high", "value")
    if stretches > 1:
        cuts = ordered.select(F.percentile_approx("low", [i / stretches for i in range(1, stretches)], 10 * max(1000, stretches)).alias("q")).first()["q"]
    else:
        cuts = []

    def line(lo: float | None, hi: float | None) -> tuple[list[float], list[float]]:
        """The fit between two cuts with the nearest block on either side."""
        inside = ordered if lo is None else ordered.filter(F.col("low") >= lo)
        inside = inside if hi is None else inside.filter(F.col("low") < hi)
        parts = [inside]
        if lo is not None:
            parts.append(ordered.filter(F.col("low") < lo).orderBy(F.desc("low")).limit(1))
        if hi is not None:
            parts.append(ordered.filter(F.col("low") >= hi).orderBy("low").limit(1))
        rows = sorted(tuple(r) for p in parts for r in p.collect())
        return [x for low, high, _ in rows for x in (low, high)], [v for _, _, v in rows for _ in "lh"]

    edges = [None, *cuts, None]
    lines = [(lo, hi, *line(lo, hi)) for lo, hi in zip(edges, edges[1:])]

    def apply(df: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
        s, out = F.col(score).cast("double"), None
        for lo, hi, xs, ys in lines:
            mine = F.lit(True) if lo is None else s >= lo
            mine = mine if hi is None else mine & (s < hi)
            part = df.filter(F.coalesce(mine, F.lit(lo is None))) if len(lines) > 1 else df
            part = part.withColumn(name, _line(F.col(score), xs, ys))
            out = part if out is None else out.unionByName(part)
        return out

    return apply
