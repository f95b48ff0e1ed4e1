"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import checkpoint_dir


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most about `size` bytes from now on: rows hold whole texts, and a task has a batch several times in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns an operator reads, by name: doc_id, text (null becomes empty) and those of `keep`. Other columns are left behind,
    so that their names cannot clash with what an operator adds."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *keep)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds. A null id counts as the empty text (crc32 0, fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(folds))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table below the shared folder that the cluster names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it again: later plans start at the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(items: Iterable[str | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive texts in lists of about `chars` characters (one longer text alone makes a list); null counts as empty."""
    out, n = [], 0
    for t in items:
        t = t or ""
        if out and n + len(t) > chars:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t) + 1
    if out:
        yield out
