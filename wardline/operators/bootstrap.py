"""Bootstrap intervals of ranking metrics, with all replicates computed in one pass.

Rows are first combined to cells of equal score. A cell of n equal rows drawn with Poisson(1) weights has
weight Poisson(n), so replicates work on cells. Cells are cut into score slices; each slice yields its
replicate sums, earlier slices give the carry, and a second visit adds the slice's share of every metric.
Weights come from a generator seeded by the cell's hash: the same on every visit, retry and machine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wardline.operators import ordered as O
from wardline.operators.metrics import missing_last

METRICS = ["roc_auc", "pr_auc", "recall_1pct", "recall_2pct", "recall_5pct"]


def poisson(cell: np.ndarray, lam: np.ndarray, reps: int, seed: int, salt: int) -> np.ndarray:
    """Poisson(lam) per row and replicate, drawn from a generator that the cell's hash seeds."""
    out = np.zeros((len(cell), reps))
    for i in np.flatnonzero(lam > 0):
        out[i] = np.random.default_rng([seed, salt, int(cell[i]) % 2**64]).poisson(lam[i], reps)
    return out


def _replicates(cells: DataFrame, reps: int, seed: int, neg_rate: float, slice_rows: int) -> DataFrame:
    """(variant, b, metrics) from cells (variant, score, cell, pos, neg)."""
    s = O.probe(cells, ["variant"], -F.col("score"), slice_rows)
    cells = O.with_slice(cells, s, -F.col("score")).select(
        "variant", F.col("_slice").alias("slice"), "score", "cell", F.col("pos").cast("double").alias("pos"),
        F.col("neg").cast("double").alias("neg"),
    )

    def weights(pdf: pd.DataFrame):
        c = pdf["cell"].to_numpy()
        pos = poisson(c, pdf["pos"].to_numpy(), reps, seed, 1)
        neg = poisson(c, pdf["neg"].to_numpy(), reps, seed, 2)
        return pos, neg

    def sums(key, batches):
        pos, neg = np.zeros(reps), np.zeros(reps)
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                p, n = weights(pdf.iloc[lo:lo + 2048])
                pos += p.sum(0)
                neg += n.sum(0)
        yield pd.DataFrame({"variant": key[0], "slice": key[1], "b": np.arange(reps), "pos": pos, "neg": neg})

    from collections.abc import Iterator

    sums.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    per_slice = cells.groupBy("variant", "slice").applyInPandas(sums, "variant string, slice int, b int, pos double, neg double")
    past = Window.partitionBy("variant", "b").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("variant", "b")
    carry = per_slice.select(
        "variant", "slice", "b", F.coalesce(F.sum("pos").over(past), F.lit(0.0)).alias("tp0"), F.coalesce(F.sum("neg").over(past), F.lit(0.0)).alias("fp0"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"),
    )

    def parts(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values("b")
        tp, fp = start["tp0"].to_numpy(), start["fp0"].to_numpy()
        P, N = np.maximum(start["p"].to_numpy(), 1e-300), np.maximum(start["n"].to_numpy(), 1e-300)
        rows = rows.sort_values("score", ascending=False, kind="mergesort").reset_index(drop=True)
        w_neg = 1.0 / neg_rate
        auc, ap = np.zeros(reps), np.zeros(reps)
        rec = {t: np.where(fp / N <= t, tp / P, 0.0) for t in (0.01, 0.02, 0.05)}
        score = rows["score"].to_numpy()
        edges = np.flatnonzero(np.r_[True, score[1:] != score[:-1]]) if len(rows) else np.array([], int)
        bounds = np.r_[edges, len(rows)]
        i = 0
        while i < len(edges):
            j = min(max(i + 1, int(np.searchsorted(bounds, bounds[i] + 1024))), len(edges))
            chunk = rows.iloc[bounds[i]:bounds[j]]
            pos, neg = weights(chunk)
            at = bounds[i:j] - bounds[i]
            pos, neg = np.add.reduceat(pos, at, axis=0), np.add.reduceat(neg, at, axis=0)
            ctp, cfp = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
            auc += (neg * (ctp - pos / 2)).sum(0) / (P * N)
            ap += (pos / P * (ctp / np.maximum(ctp + cfp * w_neg, 1e-300))).sum(0)
            for t in rec:
                rec[t] = np.maximum(rec[t], np.where(cfp / N <= t, ctp / P, 0.0).max(0))
            tp, fp = ctp[-1], cfp[-1]
            i = j
        return pd.DataFrame({"variant": key[0], "b": start["b"].to_numpy(), "auc": auc, "ap": ap, "r1": rec[0.01], "r2": rec[0.02], "r5": rec[0.05]})

    share = cells.groupBy("variant", "slice").cogroup(carry.groupBy("variant", "slice")).applyInPandas(
        parts, "variant string, b int, auc double, ap double, r1 double, r2 double, r5 double"
    )
    return share.groupBy("variant", "b").agg(
        F.sum("auc").alias("roc_auc"), F.sum("ap").alias("pr_auc"),
        F.max("r1").alias("recall_1pct"), F.max("r2").alias("recall_2pct"), F.max("r5").alias("recall_5pct"),
    )


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return df.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.metric", "_x.value")


def _interval(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, spread and 95 % interval over the replicates (as many rows per group as replicates)."""
    return df.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"),
    )


def bootstrap_ci(scores: DataFrame, reps: int = 1000, seed: int = 42, neg_rate: float = 1.0, slice_rows: int = 20_000) -> DataFrame:
    """Intervals of AUC, AP and recall at 1 / 2 / 5 % per variant (columns variant, y, score)."""
    scores = scores.withColumn("score", missing_last(F.col("score")))
    cells = scores.groupBy("variant", "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cells = cells.withColumn("cell", F.xxhash64("variant", "score"))
    return _interval(_long(_replicates(cells, reps, seed, neg_rate, slice_rows), ["variant", "b"]), ["variant", "metric"])


def paired_bootstrap(pairs: DataFrame, old: str, new: str, reps: int = 1000, seed: int = 42, neg_rate: float = 1.0,
                     slice_rows: int = 20_000) -> DataFrame:
    """Intervals of (new - old) on the same rows: both scores share the weight of their common cell."""
    pairs = pairs.withColumns({c: missing_last(F.col(c)) for c in (old, new)})
    cells = pairs.groupBy(old, new).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cells = cells.withColumn("cell", F.xxhash64(old, new))
    both = F.array(F.struct(F.lit("old").alias("variant"), F.col(old).alias("score")), F.struct(F.lit("new").alias("variant"), F.col(new).alias("score")))
    cells = cells.select(F.explode(both).alias("_v"), "cell", "pos", "neg").select("_v.variant", "_v.score", "cell", "pos", "neg")
    long = _long(_replicates(cells, reps, seed, neg_rate, slice_rows), ["variant", "b"])
    sign = F.when(F.col("variant") == "new", F.col("value")).otherwise(-F.col("value"))
    return _interval(long.groupBy("b", "metric").agg(F.sum(sign).alias("value")), ["metric"])


def bootstrap_users(eer: DataFrame, user: str, value: str = "eer", reps: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of the mean over users; tasks send one partial sum per replicate. A replicate that draws no user has no mean."""
    src = eer.select(F.xxhash64(user).alias("cell"), F.col(value).cast("double").alias("v"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                w = poisson(pdf["cell"].to_numpy(), np.ones(len(pdf)), reps, seed, 1)
                yield pd.DataFrame({"b": np.arange(reps), "s": w.T @ pdf["v"].to_numpy(), "w": w.sum(0)})

    sums = src.mapInPandas(run, "b int, s double, w double").groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("value"))
    return _interval(sums.withColumn("metric", F.lit("mean_eer")), ["metric"])
