"""The registered queries: each applies one operator with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import fold_of

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
#: DuckDB has none of the models, hashes or file formats of the other queries; the tests hold each of those against a brute-force version.
SQL: dict[str, str] = {}


def query(fn: Run) -> Run:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.langid import learn

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = fold_of("doc_id", 3) == 1
    model = learn(docs.where(~held))
    return (docs.select("doc_id", held.alias("held_out"), model.column(F.col("text")).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


@query
def op5_external_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.shards import external_shuffle, record_size

    _, out = external_shuffle(table(spark, sf, "documents").select("doc_id", "text"), shards=24)
    return out.select("doc_id", record_size(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_binary_records(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.records import read_records, write_records

    path, _ = write_records(table(spark, sf, "documents"))
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_lexical_packing(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.packing import pack

    return pack(table(spark, sf, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op7_ordinal_quality(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.quality import KEEP, learn

    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("grade")))
    return (docs.select("doc_id", model.column(F.col("text")).alias("p"))
            .select("doc_id", "p.expected", F.col("p.tail").alias("tail"), (F.col("p.tail") >= KEEP).alias("kept")))


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.toxicity import THRESHOLD, learn

    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = fold_of("doc_id", 4) == 2
    model = learn(docs, table(spark, sf, "labels").where(~held).select("doc_id", "toxic"))
    return (docs.select("doc_id", held.alias("held_out"), model.column(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


@query
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.simhash import hex16, near_duplicates

    return near_duplicates(table(spark, sf, "documents"), k=3, bits=3).select("doc_id", hex16(F.col("f")[0]).alias("fingerprint"), "component_id")


@query
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


@query
def op2_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.lm import score

    return score(table(spark, sf, "documents"))


@query
def op3_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.neardup_vectors import near_duplicates

    return near_duplicates(table(spark, sf, "embeddings"))


@query
def op11_wavelet_infill(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.infill import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf, "documents"), unit="line", rate=100, spm=50, seed=7)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL["op11_wavelet_infill"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS p, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM d),
u AS (SELECT doc_id, t, p, h, CASE WHEN t = '' THEN 0 WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS n FROM l),
k AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN t ELSE array_to_string(p[1:a], chr(10)) || chr(10) END AS pre,
        CASE WHEN b = 0 THEN '' WHEN b = n THEN t ELSE array_to_string(p[1:b], chr(10)) || chr(10) END AS upto FROM k),
s AS (SELECT *, length(pre)::BIGINT AS x, length(upto)::BIGINT AS y FROM c),
o AS (SELECT *, substr(t, x + 1, y - x) AS mid, substr(t, y + 1) AS suf FROM s)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM o"""


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.exact_dedup import stream_dedup

    return stream_dedup(spark, f"{sf}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op13_stream_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)"""
