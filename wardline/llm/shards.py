"""Sharding by a two-pass external shuffle.

Pass 1 scatters records with a seeded hash of their id into buckets of bounded size. Pass 2 holds one bucket at a time, puts it in
Fisher-Yates order and writes it. The buckets end to end are one shuffled sequence of all rows, and shard s is its s-th stretch, so
shard counts are at most one apart (law `rows`) and each bucket meets few shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wardline.llm.common import scratch


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform order of n rows. Generator.permutation is a Fisher-Yates pass over an index array."""
    return np.random.default_rng(seed).permutation(n)


def shard_bounds(rows: int, shards: int) -> list[int]:
    """Where shards begin in the shuffled sequence; the last entry is the number of rows."""
    return [s * rows // shards for s in range(shards + 1)]


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 7, bucket_bytes: int = 16 << 20, path: str | None = None) -> tuple[str, DataFrame]:
    """Write all rows of `docs`, with every column, to `shards` shards: Parquet files below `path`, in folders shard=s, with a `slot`
    column (0, 1, ... in each shard). Returns the folder and the table read from it.

    Every bucket is expected to hold `bucket_bytes`; ids spread copies of a text over all buckets. Null ids scatter by the
    hash of the text instead. Rows with equal ids are ordered by text hash before the shuffle, so the same rows and seed give the
    same shards. An empty table gives an empty result. Input columns named shard or slot are renamed with the suffix _in.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    for c in ("shard", "slot"):
        if c in docs.columns:
            docs = docs.withColumnRenamed(c, f"{c}_in")
    total = docs.select(F.sum(record_size(F.col("text"))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    rows, buckets = total["n"], max(1, math.ceil((total["b"] or 0) / bucket_bytes))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    scattered = docs.withColumn("__bucket", F.pmod(key, F.lit(buckets)))
    # one short row per bucket: where each begins in the whole sequence
    begin = (scattered.groupBy("__bucket").count()
             .select("__bucket", F.coalesce(F.sum("count").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__begin")))
    bounds = np.array(shard_bounds(rows, shards), np.int64)
    out_schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])

    def pass_two(table: pa.Table) -> pa.Table:
        b = table.column("__bucket")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("__tie", "ascending")])
        at = table.column("__begin")[0].as_py() + np.arange(len(table))
        table = table.drop_columns(["__bucket", "__begin", "__tie"])
        table = table.take(pa.array(fisher_yates(len(table), [seed, b])))
        shard = np.searchsorted(bounds, at, "right") - 1
        return table.append_column("slot", pa.array(at - bounds[shard])).append_column("shard", pa.array(shard.astype(np.int32)))

    tied = scattered.withColumn("__tie", F.xxhash64("text")).join(begin, "__bucket")
    shuffled = tied.groupBy("__bucket").applyInArrow(pass_two, out_schema)
    shuffled.write.partitionBy("shard").parquet(path)
    back = T.StructType([f for f in out_schema.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
    return path, spark.read.schema(back).parquet(path)
