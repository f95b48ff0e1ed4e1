"""Per-subject typing detectors over a feature array column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.operators import joins as J


def _vector(dims: int, f) -> Column:
    return F.array(*[f(i) for i in range(dims)])


def templates(enrolled: DataFrame, subject: str, vec: str, dims: int) -> DataFrame:
    """Mean vector and mean absolute deviation (zero becomes 1e-6) per subject, by two combined aggregates."""
    x = lambda i: F.col(vec)[i].cast("double")
    mean = enrolled.groupBy(subject).agg(_vector(dims, lambda i: F.avg(x(i))).alias("mu"))
    both = enrolled.join(mean, subject)
    mad = both.groupBy(subject).agg(_vector(dims, lambda i: F.avg(F.abs(x(i) - F.col("mu")[i]))).alias("mad"))
    mad = mad.withColumn("mad", F.transform("mad", lambda m: F.when(m == 0, F.lit(1e-6)).otherwise(m)))
    return mean.join(mad, subject)


def attempts(df: DataFrame, subject: str, row_id: str, enrol: int, impostor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(enrolment rows, genuine test rows, impostor rows): first ``enrol``, the rest, first ``impostor`` per subject."""
    # one pass numbers the first rows of every subject; the rest have no number
    w = Window.partitionBy(subject).orderBy(row_id)
    first = df.select(subject, row_id).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(enrol, impostor)).select(row_id, "_r")
    marked = df.join(first, row_id, "left").withColumn("_r", F.coalesce("_r", F.lit(max(enrol, impostor) + 1)))
    clean = lambda d: d.drop("_r")
    return clean(marked.filter(F.col("_r") <= enrol)), clean(marked.filter(F.col("_r") > enrol)), clean(marked.filter(F.col("_r") <= impostor))


def _trials(df, tpl, subject, row_id, vec, enrol, impostor):
    _, genuine, fake = attempts(df, subject, row_id, enrol, impostor)
    cols = [subject, row_id, vec]
    own = genuine.select(*cols).join(tpl, subject).withColumn("y", F.lit(0)).withColumn("user", F.col(subject))
    other = J.impostor_pairs(tpl, fake.select(*cols), subject).withColumn("y", F.lit(1)).withColumnRenamed("template_subject", "user")
    keep = ["user", row_id, "y", vec, *[c for c in tpl.columns if c != subject]]
    return own.select(*keep).unionByName(other.select(*keep))


def scaled_manhattan(df: DataFrame, subject: str, row_id: str, vec: str, dims: int, enrol: int = 200, impostor: int = 5) -> DataFrame:
    """(user, row_id, y, score): sum of |x - mean| / mad; y = 1 for impostor attempts."""
    enrolled, _, _ = attempts(df, subject, row_id, enrol, impostor)
    t = _trials(df, templates(enrolled, subject, vec, dims), subject, row_id, vec, enrol, impostor)
    gaps = F.zip_with(F.zip_with(F.col(vec), "mu", lambda x, m: F.abs(x.cast("double") - m)), "mad", lambda g, m: g / m)
    return t.select("user", row_id, "y", F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g).alias("score"))


def mahalanobis(df: DataFrame, subject: str, row_id: str, vec: str, dims: int, enrol: int = 200, impostor: int = 5) -> DataFrame:
    """Squared Mahalanobis distance to the subject's enrolment (covariance + 1e-3 I, pseudo-inverse)."""
    enrolled, _, _ = attempts(df, subject, row_id, enrol, impostor)

    kind = df.schema[subject].dataType.simpleString()

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Count, sum and sum of products of each subject's rows in a batch: they add up."""
        for pdf in batches:
            out = [(s, len(g), x.sum(0).tolist(), (x.T @ x).ravel().tolist()) for s, g in pdf.groupby(subject, dropna=False) for x in [np.stack(g[vec].to_numpy()).astype(float)]]
            yield pd.DataFrame(out, columns=[subject, "n", "s", "ss"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per task that met the subject
        n, s, ss = pdf["n"].sum(), np.sum(np.stack(pdf["s"].to_numpy()), axis=0), np.sum(np.stack(pdf["ss"].to_numpy()), axis=0).reshape(dims, dims)
        cov = (ss - np.outer(s, s) / n) / (n - 1) if n > 1 else np.zeros((dims, dims))
        full = cov + 1e-3 * np.eye(dims)
        inv = np.linalg.pinv(full)
        if not np.allclose(inv @ full, np.eye(dims), atol=1e-6):
            raise ValueError(f"the covariance of {pdf[subject].iloc[0]!r} cannot be inverted")
        return pd.DataFrame({subject: [pdf[subject].iloc[0]], "mu": [(s / n).tolist()], "inv": [inv.tolist()]})

    sums = enrolled.select(subject, vec).mapInPandas(moments, f"{subject} {kind}, n long, s array<double>, ss array<double>")
    tpl = sums.groupBy(subject).applyInPandas(fit, f"{subject} {kind}, mu array<double>, inv array<array<double>>")
    t = _trials(df, tpl, subject, row_id, vec, enrol, impostor)
    t = t.withColumn("_d", F.zip_with(F.col(vec), "mu", lambda x, m: x.cast("double") - m))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return t.select("user", row_id, "y", dot(F.transform("inv", lambda r: dot(r, F.col("_d"))), F.col("_d")).alias("score"))
