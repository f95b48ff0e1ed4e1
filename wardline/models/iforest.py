"""Isolation forest: trees are grown in parallel from small hash samples and scored in Arrow batches.

Only the samples (trees x 256 rows) and the grown nodes ever leave the table: both have a size fixed by the
parameters, whatever the table holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wardline.operators.splits import exact_quantile

NODES = "tree int, node int, feature int, cut double, left int, right int, path double"
EULER = 0.5772156649015329


def mean_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def draw_cut(rng: np.random.Generator, lo: float, hi: float) -> float:
    """A cut in [lo, hi). A draw between neighbouring numbers can be rounded up to ``hi``, which would leave no row above it."""
    cut = float(rng.uniform(lo, hi))
    return cut if cut < hi else lo


def tree_samples(df: DataFrame, cols: list[str], row_id: str, trees: int, size: int, seed: int) -> DataFrame:
    """``size`` rows per tree (fewer if the table is smaller), drawn by hash and without replacement.

    Every tree draws for itself: a row enters a tree with a chance p that gives about 2 * size + 50 rows, of which the first ``size`` in hash
    order stay. One draw skips to the first tree that a row enters, which for most rows of a large table lies beyond the last; only rows
    that enter some tree draw for the trees behind it. One rule for tables of any size.
    """
    n = df.count()
    h = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(2**53)) / float(2**53)
    base = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols])
    p = min(1.0, (2.0 * size + 50) / max(n, 1))
    # trees before the first entered one: geometric, by the inverse of its distribution
    skip = F.lit(0) if p >= 1 else F.least(F.floor(F.log(1 - h(row_id, F.lit(-1))) / math.log(1 - p)), F.lit(trees)).cast("int")
    entering = base.withColumn("_first", skip).filter(F.col("_first") < trees)
    behind = F.when(F.col("_first") < trees - 1, F.sequence(F.col("_first") + 1, F.lit(trees - 1))).otherwise(F.array().cast("array<int>"))
    picks = F.concat(F.array("_first"), F.filter(behind, lambda t: h(row_id, t) < p))
    drawn = entering.withColumn("tree", F.explode(picks)).drop("_first")
    w = Window.partitionBy("tree").orderBy(F.xxhash64(row_id, "tree", F.lit(seed + 1)), row_id)
    return drawn.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).drop("_r")


def iforest_fit(df: DataFrame, cols: list[str], row_id: str, trees: int = 400, size: int = 256, seed: int = 42) -> DataFrame:
    """Node table of the forest, one task per tree."""
    samples = tree_samples(df, cols, row_id, trees, size, seed)

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        x = pdf.sort_values(row_id)[cols].to_numpy(float)
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes, todo = [], [(np.arange(len(x)), 0)]
        slots = 1
        while todo:
            idx, depth = todo.pop(0)
            lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
            live = np.flatnonzero(hi > lo)
            if depth >= limit or len(idx) <= 1 or len(live) == 0:
                nodes.append((-1, 0.0, -1, -1, depth + mean_path(len(idx))))
                continue
            f = int(rng.choice(live))
            cut = draw_cut(rng, float(lo[f]), float(hi[f]))
            below = x[idx, f] <= cut
            nodes.append((f, cut, slots, slots + 1, 0.0))
            slots += 2
            todo += [(idx[below], depth + 1), (idx[~below], depth + 1)]
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    return samples.groupBy("tree").applyInPandas(grow, NODES)


def iforest_score(df: DataFrame, nodes: DataFrame, cols: list[str], size: int = 256, out: str = "score") -> DataFrame:
    """Anomaly score 2^(-mean path / c(size)); higher is more anomalous.

    The collected node table has at most trees * 2 * size rows.
    """
    model = nodes.toPandas().sort_values(["tree", "node"])
    forest = [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")) for _, g in model.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = mean_path(size)

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in it:
            x = np.column_stack([p.to_numpy(float) for p in parts]) if len(parts) else np.empty((0, 0))
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                live = rows if feature[0] >= 0 else rows[:0]
                while len(live):
                    f = feature[at[live]]
                    go = x[live, f] <= cut[at[live]]
                    at[live] = np.where(go, left[at[live]], right[at[live]])
                    live = live[feature[at[live]] >= 0]
                total += path[at]
            yield pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / norm))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in cols]))


def serving_risk(df: DataFrame, score: str = "score", contamination: float = 0.02, offset: float | None = None, out: str = "ml_risk") -> DataFrame:
    """clip(0.5 - 2.5 * decision, 0, 1); the offset is the contamination quantile of the (negated) scores."""
    if offset is None:
        offset = exact_quantile(df, -F.col(score), contamination)
    value = F.lit(0.5) - 2.5 * (-F.col(score) - F.lit(offset))
    return df.withColumn(out, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
