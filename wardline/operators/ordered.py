"""Ordered per-key computations that survive a hot key.

A plain window puts every row of a key in one task. ``probe`` looks for keys above ``hot_rows`` rows.
Without any, all helpers here are plain windows (one shuffle). With some, each hot key is cut into
contiguous slices of its order column; running values are then a local window per slice plus a carry from
earlier slices, and bounded look-backs run over fixed-size blocks that repeat the few rows before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

HOT_ROWS = 10_000_000
MAX_SLICES = 4096
PROBE_BUCKETS = 1 << 16
_GROUP = 64


@dataclass(frozen=True)
class Slicing:
    """Cut points of the hot keys, or ``None`` when no key is hot."""

    keys: tuple[str, ...]
    cuts: DataFrame | None

    @property
    def split(self) -> bool:
        return self.cuts is not None


def probe(df: DataFrame, keys: list[str], position: Column, hot_rows: int = HOT_ROWS) -> Slicing:
    """Find hot keys and cut points of ``position`` (numeric, ascending in the processing order).

    A first pass counts rows by hash bucket of the key, so tasks send one short row per bucket instead of one per key; a key can only be
    hot in a bucket that is. Keys are counted in those buckets alone. At most rows/hot_rows keys and as many cut points can exist, so the
    collected tables are bounded. Operators over the same keys can share one result.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(PROBE_BUCKETS))
    full = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > hot_rows).select("_b").collect()
    if not full:
        return Slicing(tuple(keys), None)
    df = df.join(F.broadcast(df.sparkSession.createDataFrame(full, "_b long")), bucket == F.col("_b"), "left_semi")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > hot_rows)
    hot = counts.collect()
    if not hot:
        return Slicing(tuple(keys), None)
    pieces = min(MAX_SLICES, max(2, -(-max(r["_c"] for r in hot) // hot_rows)))
    spark = df.sparkSession
    key_schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    names = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], key_schema)
    fractions = [i / pieces for i in range(1, pieces)]
    sketch = (
        df.select(*keys, position.cast("double").alias("_p"))
        .join(F.broadcast(_prefixed(names, keys)), _same(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_c"), F.percentile_approx("_p", fractions, 10 * max(1000, pieces)).alias("_q"))
        .withColumn("_step", F.greatest(F.lit(1), F.floor(F.lit(pieces) / F.ceil(F.col("_c") / F.lit(hot_rows)))))
        .select(*keys, F.expr("array_sort(array_distinct(filter(_q, (x, i) -> (i + 1) % _step = 0)))").alias("_q"))
    )
    rows = []
    for r in sketch.collect():
        q = [float(x) for x in r["_q"]]
        groups = [q[i:i + _GROUP] for i in range(0, len(q), _GROUP)]
        rows.append(tuple(r[k] for k in keys) + ([g[-1] for g in groups], groups))
    schema = T.StructType(
        key_schema.fields
        + [T.StructField("_heads", T.ArrayType(T.DoubleType())), T.StructField("_groups", T.ArrayType(T.ArrayType(T.DoubleType())))]
    )
    return Slicing(tuple(keys), spark.createDataFrame(rows, schema))


def _prefixed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rename key columns so a null-safe join condition is unambiguous."""
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def with_slice(df: DataFrame, slicing: Slicing, position: Column) -> DataFrame:
    """Add ``_slice``: 0 for ordinary keys, the rank of the cut interval for hot ones (null-free)."""
    if not slicing.split:
        return df.withColumn("_slice", F.lit(0))
    keys = list(slicing.keys)
    out = df.withColumn("_pos", position.cast("double"))
    out = out.join(F.broadcast(_prefixed(slicing.cuts, keys)), _same(keys), "left")
    coarse = F.expr("size(filter(_heads, h -> h < _pos))")
    out = out.withColumn("_coarse", F.when(F.col("_heads").isNull(), F.lit(-1)).otherwise(coarse))
    fine = F.expr(f"_coarse * {_GROUP} + coalesce(size(filter(try_element_at(_groups, _coarse + 1), c -> c < _pos)), 0)")
    out = out.withColumn("_slice", F.when(F.col("_coarse") < 0, F.lit(0)).otherwise(F.greatest(fine, F.lit(0))))
    return out.drop("_pos", "_coarse", "_heads", "_groups", *[f"_k_{k}" for k in keys])


_COMBINE = {
    "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    aggs: dict[str, tuple[str, Column]],
    slicing: Slicing,
    position: Column,
    before: bool = False,
    peers: bool = False,
) -> DataFrame:
    """Running sum / min / max per key. ``before`` leaves the current row out, ``peers`` includes ties."""
    end = -1 if before else Window.currentRow
    frame = (lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) if peers else (
        lambda w: w.rowsBetween(Window.unboundedPreceding, end)
    )
    if not slicing.split:
        w = frame(Window.partitionBy(*keys).orderBy(*order))
        cols = {}
        for name, (kind, c) in aggs.items():
            v = _AGG[kind](c).over(w)
            cols[name] = F.coalesce(v, F.lit(0)) if kind == "sum" else v
        return df.withColumns(cols)
    sliced = with_slice(df, slicing, position)
    hot = sliced.join(F.broadcast(_prefixed(slicing.cuts.select(*keys), keys)), _same(keys), "left_semi")
    sums = hot.groupBy(*keys, "_slice").agg(*[_AGG[k](c).alias(f"_s_{n}") for n, (k, c) in aggs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_slice", *[_AGG[k](f"_s_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in aggs.items()])
    # one carry row per slice: at most rows / hot_rows of them
    ids = [*keys, "_slice"]
    out = sliced.join(F.broadcast(_prefixed(carry, ids)), _same(ids), "left").drop(*[f"_k_{k}" for k in ids])
    w = frame(Window.partitionBy(*keys, "_slice").orderBy(*order))
    out = out.withColumns({f"_l_{n}": _AGG[k](c).over(w) for n, (k, c) in aggs.items()})
    out = out.withColumns({n: _COMBINE[k](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in aggs.items()})
    return out.drop("_slice", *[f"_c_{n}" for n in aggs], *[f"_l_{n}" for n in aggs])


def ordinal(df: DataFrame, keys: list[str], order: list[Column], slicing: Slicing, position: Column, name: str = "n") -> DataFrame:
    """0-based position of each row within its key (count of strictly earlier rows)."""
    if not slicing.split:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    out = running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, slicing, position)
    return out.withColumn(name, F.col(name) - 1)


def blocks(df: DataFrame, keys: list[str], slicing: Slicing, n: str, back: int, ahead: int = 0, size: int = 100_000):
    """Partition columns for a bounded look-back over ``n``; rows repeated into a neighbour carry ``_halo``.

    Returns (frame, partition columns). Apply the window, then ``filter(~_halo)``.
    """
    if not slicing.split:
        return df.withColumn("_halo", F.lit(False)), list(keys)
    if size <= back or size <= ahead:
        raise ValueError("block size must exceed the look-back")
    b, r = F.floor(F.col(n) / size), F.col(n) % size
    own = F.array(b)
    if back:
        own = F.concat(own, F.when(r >= size - back, F.array(b + 1)).otherwise(F.array().cast("array<bigint>")))
    if ahead:
        own = F.concat(own, F.when((r < ahead) & (b > 0), F.array(b - 1)).otherwise(F.array().cast("array<bigint>")))
    out = df.withColumn("_block", F.explode(own)).withColumn("_halo", F.col("_block") != b)
    return out, [*keys, "_block"]


def done(df: DataFrame) -> DataFrame:
    """Drop the repeated rows and helper columns left by ``blocks``."""
    return df.filter(~F.col("_halo")).drop("_halo", "_block")


def first_rows(df: DataFrame, keys: list[str], order: list[str], row_id: str) -> DataFrame:
    """Ids of the first row per key: a map-side-combined aggregate, so a hot key costs nothing extra."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, row_id)).alias("_m")).select(F.col(f"_m.{row_id}").alias(row_id))


def flag_first(df: DataFrame, keys: list[str], order: list[str], row_id: str, name: str, where: Column | None = None) -> DataFrame:
    """1 on the first row per key, else 0; joins on the unique row id, which never skews."""
    src = df.filter(where) if where is not None else df
    ids = first_rows(src, keys, order, row_id).withColumn(name, F.lit(1))
    return df.join(ids, row_id, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
