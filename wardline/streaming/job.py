"""The trust job as one stateful streaming query: source, validation, requests, devices, profiles, decisions, audit chain.

    events -> validate -> (caller, key): first / replay / conflict -> device: sharing --.
    outcomes ---------------------------------------------------------------------------+-> identity: fold -> sink
                                                                                        (answers, decisions, audit chain)

The stages run in append mode and hand the event time and its watermark on. A micro-batch goes through all of them at once, so a replay gets its
answer in the batch it comes in. The sink is idempotent: a micro-batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.operators import audit as A
from wardline.sources import readers as R, tables as TB
from wardline.streaming import fold as T, stages as S, trust as TR

BODY = [f.name for f in C.EVENT if f.name not in ("event_id", "idempotency_key")]


def answers(events: DataFrame, outcomes: DataFrame | None = None, params: T.Params = T.Params(), caller: str = "channel", keep: float = 86_400.0,
            lateness: str = "1 day", similarity: str | None = None, ml_risk: str | None = None) -> DataFrame:
    """One answer per event of a stream: the columns of a decision, and ``request``: scored, replay or conflict.

    An event with an idempotency key is scored once per (caller, key) within ``keep`` seconds. The same body again gets the stored result, whatever
    the profile has become since; another body gets no decision. Events without a key are always scored. Step-up ``outcomes`` (identity_id,
    ts, passed) join in before the fold. Events later than ``lateness`` behind the newest are dropped by the watermark and counted in the
    query's progress; those within it that are older than their identity's last event come out as LATE.
    """
    at = X.micros("ts") / 1e6
    named = events.withWatermark("ts", lateness).withColumns({
        "request_key": F.concat_ws("|", F.col(caller), F.col("idempotency_key")), "fingerprint": A.event_fingerprint(*BODY),
        "at": at, "request_until": at + F.lit(float(keep)),
    })
    # events without a key share nothing, and would all meet in one group
    keyed = S.request_stage(named.filter(F.col("idempotency_key").isNotNull()), caller, "idempotency_key", "fingerprint", "ts", "at", "event_id", keep)
    free = named.filter(F.col("idempotency_key").isNull()).withColumn("request", F.lit(None).cast("string"))
    staged = S.device_stage(keyed.unionByName(free), "ts")
    rows = TR.prepare(staged, similarity, ml_risk, keep=("request", "request_key", "request_until"))
    if outcomes is not None:
        rows = rows.unionByName(TR.outcome_rows(outcomes.withWatermark("ts", lateness), rows))
    return S.trust_stream(rows, params, "ts")


def heads_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Length and head hash of every shard's chain before a micro-batch."""
    try:
        heads = spark.read.parquet(path).filter(F.col("batch") < number)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = heads.agg(F.max("batch")).first()[0]
    return None if last is None else heads.filter(F.col("batch") == last).drop("batch")


def sink(home: str, key: bytes | None = None, shards: int = 16):
    """What is done with a micro-batch of answers: write it, insert its new decisions, and continue the audit chains with its scored events.

    Everything is named by the batch number and starts from what lay there before it, so running a batch again gives the same files.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{home}/answers/batch={number}")
        scored = spark.read.schema(S.ANSWER).parquet(f"{home}/answers/batch={number}").filter("request = 'scored'").drop("request")
        TB.append_new_decisions(scored, f"{home}/decisions")
        payload = TR.to_audit_payload(TR.explain(scored.filter("decision <> 'LATE'")))
        rows = payload.select(A.shard_of(F.to_date("ts"), F.col("event_id"), shards).alias("shard"), "ts", F.col("event_id").alias("row_id"), "payload")
        heads = heads_before(spark, f"{home}/heads", number)
        A.append_chain(rows, key, heads).write.mode("overwrite").parquet(f"{home}/audit/batch={number}")
        ends = spark.read.schema(A.CHAIN).parquet(f"{home}/audit/batch={number}").groupBy("shard").agg(
            (F.max("seq") + 1).alias("n"), F.max_by("hash", "seq").alias("head_hash"))
        if heads is not None:
            ends = ends.unionByName(heads.join(ends, "shard", "left_anti").select("shard", "n", "head_hash"))
        ends.write.mode("overwrite").parquet(f"{home}/heads/batch={number}")

    return write


def start(spark: SparkSession, home: str, fmt: str, options: dict[str, str], outcomes: DataFrame | None = None, key: bytes | None = None, shards: int = 16,
          available_now: bool = False, **scoring) -> list[StreamingQuery]:
    """Start the job below ``home``: answers/, decisions/, audit/ and heads/ from one query, quarantine/ from a second over the same source.

    ``fmt`` and ``options`` as in `read_event_stream`; JSON and Kafka text is validated, Parquet is typed already. ``scoring`` goes to `answers`. Both
    queries go on from where they were.
    """
    raw = R.read_event_stream(spark, fmt, options)
    good, bad = R.validate_events(raw) if "raw" in raw.columns else (raw, None)

    def run(stream: DataFrame, name: str):
        w = stream.writeStream.option("checkpointLocation", f"{home}/progress/{name}")
        return w.trigger(availableNow=True) if available_now else w

    queries = [run(answers(good, outcomes, **scoring), "answers").foreachBatch(sink(home, key, shards)).start()]
    if bad is not None:
        queries.append(run(bad, "quarantine").format("parquet").option("path", f"{home}/quarantine").start())
    return queries


def chain(spark: SparkSession, home: str) -> DataFrame:
    """All audit records of the job so far."""
    return spark.read.schema(A.CHAIN).option("basePath", f"{home}/audit").parquet(f"{home}/audit/batch=*")
