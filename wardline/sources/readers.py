"""Readers for the five event datasets and for event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline import schemas as C
from wardline.functions import expr as X

ACTIVITY_FORMAT = "MM/dd/yyyy HH:mm:ss"


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    """Eleven-column payment log with a fixed schema; malformed rows fail nothing and become nulls."""
    return spark.read.schema(C.PAYMENTS).csv(path, header=True, enforceSchema=False)


def _project(spark: SparkSession, path: str, columns: list[str], text: list[str]) -> DataFrame:
    """Read only the wanted columns of a wide CSV; types are cast, not inferred (no extra pass)."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in columns])


def read_card_txns(spark: SparkSession, path: str) -> DataFrame:
    df = _project(spark, path, ["TransactionID", "TransactionDT", "isFraud", *C.CARD_NUM, *C.CARD_CAT], C.CARD_CAT)
    return df.withColumns({"TransactionID": F.col("TransactionID").cast("long"), "isFraud": F.col("isFraud").cast("int")})


def read_card_identity(spark: SparkSession, path: str) -> DataFrame:
    df = _project(spark, path, ["TransactionID", *C.IDENTITY_NUM, *C.IDENTITY_CAT], C.IDENTITY_CAT)
    return df.withColumn("TransactionID", F.col("TransactionID").cast("long"))


def read_logins(spark: SparkSession, path: str) -> DataFrame:
    """Login log: header names trimmed, text booleans parsed, rows without a readable time dropped."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    df = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in C.LOGIN_COLUMNS.items() if k in raw.columns])
    df = df.withColumn("ts", F.try_to_timestamp(F.trim("login_ts")))
    for c in ("success", "attack_ip", "takeover"):
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(X.text_bool(F.col(c)), F.lit(False)))
    return df.filter(F.col("ts").isNotNull()).drop("login_ts")


def read_keystrokes(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Keystroke timings and the names of the feature columns (all but the three keys)."""
    keys = ["subject", "sessionIndex", "rep"]
    raw = spark.read.csv(path, header=True)
    feats = [c for c in raw.columns if c not in keys]
    ref = lambda c: F.col(f"`{c}`")
    names = {c: c.replace(".", "_") for c in feats}
    df = raw.select("subject", F.col("sessionIndex").cast("int"), F.col("rep").cast("int"),
                    *[ref(c).try_cast("double").alias(names[c]) for c in feats])
    return df, list(names.values())


def read_activity(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Activity log of kind logon, device or file with parsed time, day and off-hours flag."""
    cols = {"logon": ["id", "date", "user", "pc", "activity"], "device": ["id", "date", "user", "pc", "activity"],
            "file": ["id", "date", "user", "pc"]}[kind]
    df = spark.read.csv(path, header=True).select(*cols)
    df = df.withColumn("ts", F.try_to_timestamp("date", F.lit(ACTIVITY_FORMAT))).drop("date")
    return df.withColumns({"day": F.to_date("ts"), "off": X.off_hours(F.col("ts"))})


def read_windows(spark: SparkSession, path: str, release: str) -> DataFrame:
    """Labelled user windows of one release."""
    raw = spark.read.csv(path, header=True).filter(F.col("dataset").cast("string") == release)
    day = lambda c: F.to_date(F.coalesce(F.try_to_timestamp(c, F.lit(ACTIVITY_FORMAT)), F.try_to_timestamp(c)))
    return raw.select("user", F.col("scenario").cast("int").alias("scenario"), day("start").alias("start_day"), day("end").alias("end_day"))


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame, name: str = r"([^/]+)$") -> DataFrame:
    """SHA-256 of every file against the manifest (file, sha256); files must be below 2 GB each. ``name`` takes a file's name from its path."""
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", name, 1).alias("file"), F.sha2("content", 256).alias("actual")
    )
    out = manifest.join(files, "file", "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.lower("sha256") == F.col("actual"), "ok").otherwise("mismatch")
    return out.withColumn("status", status)


# ---- event streams --------------------------------------------------------------
def read_event_stream(spark: SparkSession, fmt: str, options: dict[str, str]) -> DataFrame:
    """Raw event stream as (raw, arrived): JSON text from Kafka or from text files, or typed parquet files."""
    if fmt == "kafka":
        src = spark.readStream.format("kafka").options(**options).load()
        return src.select(F.col("value").cast("string").alias("raw"))
    if fmt == "json":
        opts = dict(options)
        path = opts.pop("path")
        return spark.readStream.options(**opts).text(path).select(F.col("value").alias("raw"))
    if fmt == "parquet":
        opts = dict(options)
        path = opts.pop("path")
        return spark.readStream.schema(C.EVENT).options(**opts).parquet(path)
    raise ValueError(f"unknown stream format {fmt!r}")


def validate_events(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Split raw JSON events into (good, quarantine); a bad event never stops the job.

    Rules: parseable object, required fields present, closed enumerations, hour 0..23, no unknown fields.
    """
    names = [f.name for f in C.EVENT]
    allowed = F.array(*[F.lit(n) for n in names])
    typed = [n.name for n in C.EVENT if not isinstance(n.dataType, T.StringType)]
    # generators, so that the filters below read their columns instead of parsing the text again for every field they look at
    parsed = F.struct(F.json_object_keys(text).alias("_keys"), F.from_json(text, C.EVENT, {"mode": "PERMISSIVE"}).alias("_e"))
    df = raw.select("*", F.inline(F.array(parsed))).select("*", F.json_tuple(text, *typed).alias(*[f"_text_{n}" for n in typed]))
    field = lambda n: F.col(f"_e.{n}")
    missing = F.lit(False)
    for n in C.REQUIRED:
        missing = missing | field(n).isNull()
    # a field that is present but has the wrong type parses to null
    mistyped = F.lit(False)
    for n in typed:
        mistyped = mistyped | (field(n).isNull() & F.col(f"_text_{n}").isNotNull())
    problem = (
        F.when(F.col("_keys").isNull(), "malformed")
        .when(F.size(F.array_except("_keys", allowed)) > 0, "unknown_field")
        .when(mistyped, "wrong_type")
        .when(missing, "missing_field")
        .when(~field("event_type").isin(*C.EVENT_TYPES), "event_type")
        .when(~field("channel").isin(*C.CHANNELS), "channel")
        .when(~field("hour_of_day").between(0, 23), "hour_of_day")
    )
    df = df.withColumn("problem", problem)
    good = df.filter(F.col("problem").isNull()).select("_e.*")
    good = good.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_new_beneficiary", "recovery_contact_changed")})
    return good, df.filter(F.col("problem").isNotNull()).select(F.col(text).alias("raw"), "problem")
