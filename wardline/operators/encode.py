"""Category encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def top_k_bucket(df: DataFrame, column: str, k: int = 100, out: str | None = None, other: str = "OTHER") -> DataFrame:
    """Keep the k most frequent values (ties by value), map the rest to ``OTHER``; null stays null."""
    out = out or f"{column}_top"
    top = df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k)
    top = top.select(F.col(column).alias("_v"), F.lit(True).alias("_hit"))
    # k rows at most, hence the broadcast
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_v"), "left")
    kept = F.when(F.col("_hit"), F.col(column)).when(F.col(column).isNotNull(), F.lit(other))
    return joined.withColumn(out, kept).drop("_v", "_hit")


def frequency_table(train: DataFrame, column: str, y: str | None = None) -> DataFrame:
    """Value shares among the training negatives."""
    base = train.filter(F.col(column).isNotNull())
    base = base.filter(F.col(y) == 0) if y else base
    total = base.agg(F.count(F.lit(1)).alias("total_rows")).scalar()
    return base.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).select(column, (F.col("_n") / total).alias("freq"))


def frequency_encoding(train: DataFrame, df: DataFrame, column: str, y: str | None = None, out: str | None = None,
                       head: int = 1000) -> DataFrame:
    """log1p(share * 1e6) with shares fitted on train negatives; unseen or null gives 0.

    The ``head`` most frequent values are broadcast and matched in place; in the join with the rest of the
    table those rows carry a spread-out key, so a value that fills a third of the table loads no single task.
    """
    out = out or f"f_{column}"
    table = frequency_table(train, column, y).withColumn("_e", F.log1p(F.col("freq") * 1e6)).select(F.col(column).alias("_v"), "_e")
    frequent = table.orderBy(F.desc("_e"), "_v").limit(head).withColumnsRenamed({"_v": "_hv", "_e": "_he"})
    near = df.join(F.broadcast(frequent), F.col(column) == F.col("_hv"), "left")
    # rows already matched get a spread-out key that no table row has
    key = F.when(F.col("_he").isNull() & F.col(column).isNotNull(), F.struct(F.col(column).cast("string").alias("v"), F.lit(0).alias("s")))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(1024)).cast("int") + 1
    spread = F.struct(F.lit(None).cast("string").alias("v"), salt.alias("s"))
    far = table.select(F.struct(F.col("_v").cast("string").alias("v"), F.lit(0).alias("s")).alias("_k"), F.col("_e"))
    joined = near.withColumn("_k", F.coalesce(key, spread)).join(far, "_k", "left")
    return joined.withColumn(out, F.coalesce("_he", "_e", F.lit(0.0))).drop("_hv", "_he", "_e", "_k")
