"""Tamper-evident audit chains: one chain per shard, verified in parallel."""

from __future__ import annotations

import hashlib
import hmac as _hmac

from pyspark.sql import Column, DataFrame, functions as F

from wardline import schemas as C
from wardline.functions import crypto as K, expr as X
from wardline.operators import joins as J
from wardline.streaming.keyed import keyed_fold

CHAIN = "shard string, seq long, ts_us long, payload string, prev_hash string, hash string, hmac string"


def shard_of(day: Column, row_id: Column, buckets: int) -> Column:
    """Shard name: the day and a hash bucket of the unique row id, so no identity can fill one shard."""
    return F.concat_ws("/", day.cast("string"), F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("string"))


def sharded(rows: DataFrame, per_chain: int = 100_000, ts: str = "ts", row_id: str = "row_id") -> DataFrame:
    """Add ``shard``: every day is dealt to as many chains as its rows need, about ``per_chain`` rows each, so that a busy day has more serial
    chains and not longer ones."""
    day = F.to_date(ts)
    need = rows.groupBy(day.alias("_day")).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_chain)).cast("int").alias("_chains"))
    out = rows.withColumn("_day", day).join(F.broadcast(need), "_day")  # one row per day
    return out.withColumn("shard", F.concat_ws("/", F.col("_day").cast("string"), F.pmod(F.xxhash64(row_id), F.col("_chains")).cast("string"))).drop("_day", "_chains")


def chain_of_heads(chain: DataFrame, key: bytes | None = None, heads: DataFrame | None = None) -> DataFrame:
    """The second level: one chain, named heads, over the ends of all shards (their length and head hash) in order of their last record's
    time. Whoever keeps its last hash can tell a shard that was cut, emptied or left out. It has one record per shard."""
    ends = chain.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "seq").alias("head_hash"), F.max("ts_us").alias("t"))
    rows = ends.select(F.lit("heads").alias("shard"), F.timestamp_micros("t").alias("ts"), F.col("shard").alias("row_id"),
                       F.concat_ws("|", "shard", F.col("n").cast("string"), "head_hash").alias("payload"))
    return append_chain(rows, key, heads)


def event_fingerprint(*fields: str) -> Column:
    """Digest of the canonical JSON of the given fields (leave the idempotency key out)."""
    return K.sha256_hex(X.canonical_json(*fields))


def body_hash() -> Column:
    """Digest of the record body: sequence, time, payload and predecessor."""
    return K.sha256_hex(F.concat_ws("|", F.col("seq").cast("string"), F.col("ts_us").cast("string"), F.col("payload"), F.col("prev_hash")))


def append_chain(rows: DataFrame, key: bytes | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Chain records (shard, ts, row_id, payload) in time order inside each shard.

    A chain is serial by definition: shards are the unit of parallel work. ``heads`` (shard, next_seq, hash)
    continues existing chains.
    """
    src = rows.select("shard", X.micros("ts").alias("ts_us"), "row_id", "payload")
    if heads is not None:
        src = src.join(heads.select("shard", F.col("n").alias("_seq"), F.col("head_hash").alias("_prev")), "shard", "left")
    else:
        src = src.withColumns({"_seq": F.lit(0).cast("long"), "_prev": F.lit(C.GENESIS)})
    src = src.withColumns({"_seq": F.coalesce("_seq", F.lit(0).cast("long")), "_prev": F.coalesce("_prev", F.lit(C.GENESIS))})

    def step(state: dict, row):
        seq, prev = state.get("seq", row.start_seq), state.get("hash", row.start_hash)
        digest = hashlib.sha256(f"{seq}|{row.ts_us}|{row.payload}|{prev}".encode()).hexdigest()
        mac = _hmac.new(key, digest.encode(), hashlib.sha256).hexdigest() if key else None
        state["seq"], state["hash"] = seq + 1, digest
        return row.shard, seq, row.ts_us, row.payload, prev, digest, mac

    src = src.withColumnsRenamed({"_seq": "start_seq", "_prev": "start_hash"})
    return keyed_fold(src, "shard", ["ts_us", "row_id"], dict, step, CHAIN)


def check_records(chain: DataFrame, key: bytes | None = None) -> DataFrame:
    """Per record: link to the predecessor, recomputed body hash and keyed digest."""
    out = J.successor_join(chain)
    first = F.col("seq") == 0
    linked = F.when(first, F.col("prev_hash") == C.GENESIS).otherwise(F.col("prev_hash") == F.col("actual_prev_hash"))
    checks = {"linked": F.coalesce(linked, F.lit(False)), "body_ok": F.coalesce(body_hash() == F.col("hash"), F.lit(False))}
    mac = F.coalesce(K.hmac_sha256(F.col("hash"), key) == F.col("hmac"), F.lit(False)) if key else F.lit(True)
    return out.withColumns(checks).withColumn("mac_ok", mac)


def verify_chain(chain: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per shard: record count, first bad sequence number (null when intact) and the verdict.

    Gaps and repeats show as a count that differs from max(seq) + 1 or as a record without predecessor.
    """
    bad = ~(F.col("linked") & F.col("body_ok") & F.col("mac_ok"))
    out = check_records(chain, key).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("_last"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"),
        F.min("seq").alias("_first"),
    )
    contiguous = (F.col("n") == F.col("_last") + 1) & (F.col("_first") == 0)
    return out.select("shard", "n", "first_bad", (contiguous & F.col("first_bad").isNull()).cast("int").alias("intact"))


def head_checkpoint(chain: DataFrame, key: bytes | None = None) -> DataFrame:
    """Signed commitment to length and head hash of every shard."""
    out = chain.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "seq").alias("head_hash"))
    body = F.concat_ws("|", F.col("n").cast("string"), F.col("head_hash"))
    signed = F.concat_ws("|", body, K.hmac_sha256(body, key)) if key else body
    return out.withColumn("checkpoint", signed)


def verify_checkpoint(chain: DataFrame, stored: DataFrame, key: bytes | None = None) -> DataFrame:
    """Compare stored checkpoints with the chain; a truncated, emptied or extended shard does not match."""
    now = head_checkpoint(chain, key).select("shard", F.col("checkpoint").alias("_now"))
    verdict = verify_chain(chain, key).select("shard", "intact")
    out = stored.select("shard", "checkpoint").join(now, "shard", "left").join(verdict, "shard", "left")
    ok = (F.col("_now") == F.col("checkpoint")) & (F.col("intact") == 1)
    return out.select("shard", F.coalesce(ok, F.lit(False)).cast("int").alias("matches"))
