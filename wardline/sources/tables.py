"""Table sinks and lookups: feature and score tables, reports, decisions, audit tails, profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, by: list[str]) -> None:
    """Nested JSON, one document per key with its metric rows inside (a report has few rows per key)."""
    rest = [c for c in df.columns if c not in by]
    df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("metrics")).write.mode("overwrite").json(path)


def write_document(parts: dict[str, DataFrame], path: str, by: list[str], single: tuple[str, ...] = ()) -> None:
    """One nested JSON document per key: a section per table, its rows as a list, or the row itself for the tables of ``single``. A key that a
    table does not know has null there. The tables are reports, with few rows per key."""
    out = None
    for name, df in parts.items():
        row = F.struct(*[c for c in df.columns if c not in by])
        section = df.groupBy(*by).agg((F.first(row) if name in single else F.sort_array(F.collect_list(row))).alias(name))
        out = section if out is None else out.join(section, by, "full")
    out.write.mode("overwrite").json(path)


def write_leaderboard(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)  # one row per detector


# ---- decisions ------------------------------------------------------------------
LOOKUP = 1000
KEY_FILTER = {  # Parquet keeps a Bloom filter of the ids in every file; one wrong hit in 100,000
    "parquet.bloom.filter.enabled#event_id": "true", "parquet.bloom.filter.fpp#event_id": "0.00001",
}


def stored_ids(spark: SparkSession, path: str, kind: str, ids: list | None) -> DataFrame | None:
    """The event_ids stored at ``path``, or those among ``ids``; None before the first write. With ``ids`` the files' own key filters are
    asked first, and files (row groups) that hold none of them are not read."""
    try:
        stored = spark.read.schema(f"event_id {kind}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored if ids is None else stored.filter(F.col("event_id").isin(ids))


def append_new_decisions(batch: DataFrame, path: str, lookup: int = LOOKUP) -> None:
    """Insert rows whose event_id is not stored yet: insert-or-ignore on the key event_id, whatever the other columns say.

    Every file keeps a key filter of its ids. A batch of up to ``lookup`` ids looks them up through these filters and reads next to
    nothing of the store; a larger one is joined against all stored ids. Within a batch the earliest row per event_id wins. Rows without an event_id
    have no key and are refused.
    """
    spark = batch.sparkSession
    # several reads of a stateful micro-batch would run it several times
    rows = first_per_event(batch.filter(F.col("event_id").isNotNull())).persist()
    try:
        n = rows.count()
        ids = [r[0] for r in rows.select("event_id").collect()] if n <= lookup else None  # at most ``lookup`` ids
        stored = stored_ids(spark, path, batch.schema["event_id"].dataType.simpleString(), ids)
        new = rows if stored is None else rows.join(stored, "event_id", "left_anti")
        new.write.mode("append").options(**KEY_FILTER, **{"parquet.bloom.filter.expected.ndv#event_id": str(min(max(n, 1), 1_000_000))}).parquet(path)
    finally:
        rows.unpersist()


def write_decisions(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Start the idempotent decision sink; a replayed micro-batch adds nothing."""
    w = stream.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.foreachBatch(lambda batch, _: append_new_decisions(batch, path)).start()


def first_per_event(decisions: DataFrame) -> DataFrame:
    """Insert-or-ignore semantics on a batch table: the earliest row per event_id wins."""
    first = F.min_by(F.struct(*decisions.columns), F.struct("ts", *[c for c in decisions.columns if c not in ("ts",)]))
    return decisions.groupBy("event_id").agg(first.alias("_r")).select("_r.*")


def get_decision(df: DataFrame, event_id) -> DataFrame:
    return df.filter(F.col("event_id") == event_id).limit(1)


def audit_tail(df: DataFrame, n: int = 50, seq: str = "seq") -> DataFrame:
    """The last n records, oldest first: a take-ordered of n rows, then a sort of those n."""
    return df.orderBy(F.desc(seq)).limit(n).orderBy(seq)


# ---- profile --------------------------------------------------------------------
def profile(df: DataFrame, labels: list[str], entities: list[str], ts: Column | None = None) -> DataFrame:
    """Rows, columns, label counts and rates, distinct entities and the time span in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    for c in labels:
        aggs += [F.count_if(F.col(c).cast("int") == 1).alias(f"{c}_count"), F.avg(F.col(c).cast("int").cast("double")).alias(f"{c}_rate")]
    aggs += [F.count_distinct(c).alias(f"{c}_distinct") for c in entities]
    if ts is not None:
        aggs += [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    return df.agg(*aggs)


def type_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1)).alias("total")).scalar())
