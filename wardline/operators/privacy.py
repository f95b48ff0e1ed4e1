"""Encrypted per-identity vault with erasure, retention, and differentially private exports."""

from __future__ import annotations

import math
import re
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline import schemas as C
from wardline.functions import crypto as K, expr as X

MIN_COHORT = 25
COUNT_BUFFER = 10
COUNT_EPSILON = 0.1
DELTA = 1e-5
# fixed values: orders at which the privacy loss is evaluated
ORDERS = [1 + x / 10.0 for x in range(1, 100)] + [float(x) for x in range(12, 64)]


# ---- vault ----------------------------------------------------------------------
def new_keys(identities: DataFrame, on: str = "identity_id") -> DataFrame:
    """A random 256-bit key per identity. Write the result before use: a random draw must happen once."""
    return identities.select(on).distinct().select(
        on, F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()).cast("binary"), 256)).alias("key"), F.current_timestamp().alias("created_ts")
    )


def vault_put(rows: DataFrame, keys: DataFrame, tombstones: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Encrypt (identity_id, payload) under the identity's key; erased identities are refused.

    The nonce is a digest of row id and payload, so a retried task writes the same ciphertext.
    """
    live = rows.join(tombstones.select("identity_id").distinct(), "identity_id", "left_anti")
    iv = F.unhex(F.substring(F.sha2(F.concat_ws("|", F.col(row_id).cast("string"), "payload"), 256), 1, 24))
    out = live.join(keys.select("identity_id", "key"), "identity_id").withColumn(
        "ciphertext", F.aes_encrypt(F.col("payload").cast("binary"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), iv)
    )
    return out.select(row_id, "identity_id", "ciphertext", F.substring(F.sha2("ciphertext", 256), 1, 16).alias("pii_ref"))


def vault_get(vault: DataFrame, keys: DataFrame) -> DataFrame:
    """Plain text where the key still exists, else null."""
    out = vault.join(keys.select("identity_id", "key"), "identity_id", "left")
    return out.withColumn("payload", F.try_aes_decrypt("ciphertext", "key", F.lit("GCM")).cast("string")).drop("key")


def erase(keys: DataFrame, tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key and tombstone tables after destroying the keys of ``ids``."""
    ids = ids.select("identity_id").distinct()
    left = keys.join(ids, "identity_id", "left_anti")
    return left, tombstones.select("identity_id").unionByName(ids).distinct()


def reconsent(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    """Lift tombstones; old ciphertext stays unreadable because its key is gone."""
    return tombstones.join(ids.select("identity_id").distinct(), "identity_id", "left_anti")


def expire_keys(keys: DataFrame, now: datetime | Column, days: int = 365) -> DataFrame:
    """Identities whose key is older than the retention time (feed them to ``erase``)."""
    now = now if isinstance(now, Column) else F.lit(now)
    return keys.filter(F.col("created_ts") < now - F.expr(f"interval {int(days)} days"))


# ---- differential privacy -------------------------------------------------------
def identity_means(features: DataFrame, country: Column, cols: list[str] = C.FEATURES) -> DataFrame:
    """One clipped mean vector per identity and the country of its last event."""
    return features.withColumn("_c", country).groupBy("identity_id").agg(
        *[F.avg(X.clip(F.col(c), 0.0, 1.0)).alias(c) for c in cols], F.max_by("_c", F.struct("ts", "event_id")).alias("cohort")
    )


def cohort_aggregates(means: DataFrame, cols: list[str] = C.FEATURES) -> DataFrame:
    return means.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in cols])


def _uniform(secret: bytes, *parts: Column) -> Column:
    """Uniform in (0, 1) from a keyed digest: secret, repeatable on retries, independent of partitioning."""
    digest = K.hmac_sha256(F.concat_ws("|", *parts), secret)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def _gauss(secret: bytes, *parts: Column) -> Column:
    u, v = _uniform(secret, *parts, F.lit("u")), _uniform(secret, *parts, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _bound(release: str | None) -> list[Column]:
    """What binds a draw to its release. Without a name there is one release per secret: a second would repeat its noise, and their difference
    would show exact changes."""
    return [] if release is None else [F.lit(f"release {release}")]


def dp_suppress(cohorts: DataFrame, secret: bytes, epsilon: float = COUNT_EPSILON, minimum: int = MIN_COHORT + COUNT_BUFFER, release: str | None = None) -> DataFrame:
    """Keep cohorts whose noisy size reaches the minimum; adds ``noisy_n``. The noise belongs to the ``release``."""
    noise = X.laplace(_uniform(secret, *_bound(release), F.col("cohort"), F.lit("size")) - 0.5, 1.0 / epsilon)
    return cohorts.withColumn("noisy_n", F.col("n") + noise).filter(F.col("noisy_n") >= minimum)


def dp_cohort_means(means: DataFrame, noise_multiplier: float, secret: bytes, exact_n: bool = False, cols: list[str] = C.FEATURES,
                    release: str | None = None) -> DataFrame:
    """Noised cohort means. Gaussian noise goes on the sums; the noisy size divides unless ``exact_n``.

    Noise is drawn from a digest of secret, release, cohort and column: a retried task repeats it, another release draws anew. Book a
    release with `open_release` before it is made, which refuses a name that was used.
    """
    if noise_multiplier <= 0:
        raise ValueError("export refused: the noise multiplier must be positive")
    sigma = noise_multiplier * math.sqrt(len(cols))
    kept = dp_suppress(cohort_aggregates(means, cols), secret, release=release)
    size = F.col("n") if exact_n else F.greatest(F.col("noisy_n"), F.lit(1.0))
    return kept.select("cohort", *[
        X.clip((F.col(f"sum_{c}") + sigma * _gauss(secret, *_bound(release), F.col("cohort"), F.lit(c))) / size, 0.0, 1.0).alias(c) for c in cols
    ])


def open_release(spark: SparkSession, path: str, dataset: str, release: str, noise_multiplier: float, delta: float = DELTA) -> DataFrame:
    """Enter a release in the ledger below ``path`` (one folder per dataset and release) and return the ledger. A release that is in it already is
    refused: publishing twice under one name would either repeat noise or hide a loss."""
    if noise_multiplier <= 0:
        raise ValueError("export refused: the noise multiplier must be positive")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", f"{dataset}{release}"):
        raise ValueError("dataset and release are names of letters, digits, '_', '.' and '-'")
    entry = spark.createDataFrame([(float(noise_multiplier), float(delta))], "noise_multiplier double, delta double")
    try:
        entry.coalesce(1).write.mode("errorifexists").parquet(f"{path}/dataset={dataset}/release={release}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError(f"release {release!r} of {dataset!r} is in the ledger already") from None
    return spark.read.schema("noise_multiplier double, delta double, dataset string, release string").parquet(path)


def gaussian_epsilon(multiplier: Column, delta: Column) -> Column:
    """Privacy loss of one Gaussian release, minimised over the orders."""
    def at(a: Column) -> Column:
        return a / (2 * multiplier * multiplier) + F.log((a - 1) / a) - (F.log(delta) + F.log(a)) / (a - 1)

    return F.greatest(F.array_min(F.transform(F.array(*[F.lit(o) for o in ORDERS]), at)), F.lit(0.0))


def privacy_ledger(releases: DataFrame, count_epsilon: float = COUNT_EPSILON) -> DataFrame:
    """Total loss per dataset over releases (dataset, noise_multiplier, delta); non-positive noise is an error."""
    ok = F.col("noise_multiplier") > 0
    checked = F.when(ok, F.col("noise_multiplier")).otherwise(F.raise_error(F.lit("noise multiplier must be positive")).cast("double"))
    df = releases.withColumn("mean_epsilon", gaussian_epsilon(checked, F.col("delta")))
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("releases"), F.sum("mean_epsilon").alias("mean_epsilon"),
        F.sum(F.col("mean_epsilon") + count_epsilon).alias("total_epsilon"),
    )
