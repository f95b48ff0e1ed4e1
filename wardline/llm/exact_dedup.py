"""Exact deduplication as a stream with keyed state on disk.

Two streaming queries run one after the other over whatever files are new. The first writes a ledger: one short row per document, with the digest
of its normalised text and the locator of its content (file and row). The second keeps, for every digest ever seen, the row that stays and the number
of rows, in RocksDB and without expiry; rows of one digest are combined in each task first, so a text that a third of all rows hold is
no hot key. Digests that were met more than once are hits: their rows' contents are fetched by locator and compared byte by byte, and texts
that merely share a digest become groups of their own. Both queries go on from their checkpoints, so a folder can grow and be worked on again.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import scratch, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "struct<doc_id:bigint,file:string,row:bigint>"
LEDGER = "doc_id long, file string, row long, digest string"
STATE = f"digest string, n long, keep {ROW}"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


def located(docs: DataFrame) -> DataFrame:
    """Rows of a Parquet table with the place of their content: the file and the row in it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that starts inside keeps its state in RocksDB, without space set aside for its logs (that is megabytes for each of its partitions);
    the session's own settings come back after."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrive(spark: SparkSession, source: str, home: str, files_per_batch: int = 1000, digest=text_digest) -> None:
    """Take in all new files of `source` and put their rows' digests into the state below `home`."""
    schema = spark.read.parquet(source).schema
    last = source.rstrip("/")
    # a pattern that only the path itself meets: a stream takes a folder or a pattern, but not the name of one file
    rows = located(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{last[:-1]}[{last[-1]}]"))
    rows = rows.select("doc_id", "file", "row", digest(F.col("text")).alias("digest"))
    rows.writeStream.format("parquet").option("path", f"{home}/ledger").option("checkpointLocation", f"{home}/ledger-progress").trigger(availableNow=True).start().awaitTermination()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/state/batch={number}")  # a batch that is run again replaces itself

    seen = spark.readStream.schema(LEDGER).parquet(f"{home}/ledger")
    state = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    with _state_on_disk(spark):
        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state-progress").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()


def current(spark: SparkSession, home: str) -> DataFrame:
    """digest, n, keep: the state of every digest, which is its last change (each change has a larger n)."""
    changes = spark.read.schema(STATE).option("basePath", f"{home}/state").parquet(f"{home}/state/batch=*")
    return changes.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.*")


def compared(spark: SparkSession, source: str, hits: DataFrame) -> DataFrame:
    """digest, content, n: the distinct contents of the rows `hits` (file, row, digest), fetched by locator. Rows are grouped by
    their whole normalised text, and combined in each task before they move."""
    rows = located(spark.read.parquet(source)).select("doc_id", "file", "row", normalised(F.col("text")).alias("content"))
    return rows.join(hits, ["file", "row"]).groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"))


def stream_dedup(spark: SparkSession, source: str, home: str | None = None, files_per_batch: int = 1000, digest=text_digest) -> DataFrame:
    """One row per row of the Parquet table `source`, in all files so far: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest doc_id stays; of
    rows that repeat it, the last by file and row; null ids are smallest, and stay only where a group has no other. A repeated row is a row
    of its own. Other columns are not read. An empty table gives no rows. `home` holds ledger, state and progress (not given: a new folder below
    spark.checkpoint.dir); a second call with the same `home` digests only files that are new, and compares all hits again. `digest` may be any text digest: rows that share one
    without being equal are told apart by their contents.
    """
    home = home or scratch(spark, "stream-dedup")
    if not spark.read.parquet(source).columns or spark.read.parquet(source).isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    arrive(spark, source, home, files_per_batch, digest)
    ledger = spark.read.schema(LEDGER).parquet(f"{home}/ledger")
    state = stored(current(spark, home), "digest-state")  # written, so that its join with a digest that very many rows share can be split
    hits = ledger.join(state.where("n > 1").select("digest"), "digest").select("file", "row", "digest")
    clash = stored(compared(spark, source, hits).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "digest-clashes")
    if not clash.isEmpty():
        ledger, state = _apart(spark, source, ledger, state, clash)
    out = ledger.join(state, "digest").withColumn("kept", F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep")))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.substring_index("digest", "/", 1).alias("text_sha256"))


def _apart(spark: SparkSession, source: str, ledger: DataFrame, state: DataFrame, clash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger and state with the digests of `clash` split by content: "<digest>/<number of the text in it>"."""
    mine = ledger.join(clash, "digest", "left_semi").select("file", "row", "digest")
    texts = located(spark.read.parquet(source)).join(mine, ["file", "row"]).select("doc_id", "file", "row", "digest", normalised(F.col("text")).alias("content"))
    groups = texts.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    groups = stored(groups.withColumn("name", F.concat("digest", F.lit("/"), F.col("keep.file"), F.lit(":"), F.col("keep.row").cast("string"))), "digest-texts")
    rows = stored(texts.join(groups.select("digest", "content", "name"), ["digest", "content"]).select("doc_id", "file", "row", F.col("name").alias("digest")), "digest-rows")
    state = state.join(clash, "digest", "left_anti").unionByName(groups.select(F.col("name").alias("digest"), "n", "keep"))
    return ledger.join(clash, "digest", "left_anti").unionByName(rows), state
