"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A data file is a run of records in ascending doc_id order:

    uint64 LE  payload length
    uint32 LE  masked CRC-32 of those 8 bytes
    payload    int64 LE doc_id, uint32 LE number of ids, then the ids (uint16 or uint32 LE) in one zstd frame
    uint32 LE  masked CRC-32 of the payload

mask(c) = rotate right by 15 bits, plus 0xA282EAD8, modulo 2^32, so that checksums of data that hold checksums stay useful. Each data file
has an index file of its own: per record int64 doc_id, int64 byte offset, int64 ids before it in this file. With it a reader seeks
to any record, so records can be read in shuffled order without a pass over the data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import scratch, text_batches, texts
from wardline.llm.tokens import END_ID, shared_encoder

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qI")
_CRC = struct.Struct("<I")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("start", "<i8")])
#: doc_id stored for a null id; the flag is the top bit of the number of ids.
_NULL_ID = 1 << 31


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, _CRC.pack(masked_crc(head)), payload, _CRC.pack(masked_crc(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at a byte offset and the offset after it; ValueError if lengths or checksums do not hold."""
    if at + _HEAD.size > len(data):
        raise ValueError(f"record cut off at byte {at}")
    size, crc = _HEAD.unpack_from(data, at)
    if crc != masked_crc(data[at:at + 8]):
        raise ValueError(f"length checksum does not hold at byte {at}")
    begin, end = at + _HEAD.size, at + _HEAD.size + size
    if end + 4 > len(data):
        raise ValueError(f"record cut off at byte {at}")
    payload = data[begin:end]
    if _CRC.unpack_from(data, end)[0] != masked_crc(payload):
        raise ValueError(f"payload checksum does not hold at byte {at}")
    return payload, end + 4


def pack_ids(doc_id: int | None, ids: np.ndarray, zip_) -> bytes:
    n = len(ids) | (_NULL_ID if doc_id is None else 0)
    return _BODY.pack(doc_id or 0, n) + zip_.compress(ids.tobytes())


def unpack_ids(payload: bytes, unzip) -> tuple[int | None, np.ndarray]:
    doc_id, n = _BODY.unpack_from(payload)
    count = n & ~_NULL_ID
    raw = unzip.decompress(payload[_BODY.size:])
    return None if n & _NULL_ID else doc_id, np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write under a name of this attempt and rename: a lost or doubled task never leaves half a file under the final name."""
    store, root = _open(folder)
    tmp = f"{root}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as out:
        for c in chunks:
            out.write(c)
    store.move(tmp, f"{root}/{name}")


def write_records(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encode whole texts and write them as records, in ascending doc_id order over all files. Returns the folder and its manifest:
    part, first_doc_id, records, tokens, bytes (one row per file).

    Null text: the end id alone. Null ids come first. Repeated ids lie side by side, ordered by text hash. An empty table writes
    no file. Other columns are not read. Equal input gives equal files; a task run again replaces its own files as a whole.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "records")
    store, root = _open(path)
    store.create_dir(root, recursive=True)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, zip_ = shared_encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=1)
        index: list[tuple[int, int, int]] = []
        at = {"byte": 0, "ids": 0}
        first: list[int | None] = []

        def chunks():
            for b in batches:
                ids_col, text_col = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                k = 0
                for group in text_batches(text_col):
                    for ids in enc.encode(group):
                        doc_id = ids_col[k]
                        k += 1
                        rec = frame(pack_ids(doc_id, ids, zip_))
                        if not first:
                            first.append(doc_id)
                        index.append((doc_id or 0, at["byte"], at["ids"]))
                        at["byte"] += len(rec)
                        at["ids"] += len(ids)
                        yield rec

        import itertools

        stream = chunks()
        head = next(stream, None)
        if head is not None:
            _put(path, f"part-{part:06d}.rec", itertools.chain([head], stream))
            _put(path, f"part-{part:06d}.idx", iter([np.array(index, INDEX).tobytes()]))
            yield pa.RecordBatch.from_pydict({"part": [part], "first_doc_id": pa.array([first[0]], pa.int64()), "records": [len(index)],
                                              "tokens": [at["ids"]], "bytes": [at["byte"]]})

    keyed = texts(docs).withColumn("tie", F.xxhash64("text"))
    manifest = (keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
                .mapInArrow(run, "part long, first_doc_id long, records long, tokens long, bytes long"))
    manifest.write.parquet(f"{path}/manifest")
    return path, spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read record files back, one task per file, and check every length and checksum: doc_id, start (ids in all files before it),
    n_tokens, ids (binary, uint32 LE)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    # one row per file, so the running sum over files is short
    before = F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", before.alias("base")).repartition(spark.sparkContext.defaultParallelism * 4, "part")

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        store, root = _open(path)
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_file(f"{root}/part-{part:06d}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with store.open_input_file(f"{root}/part-{part:06d}.rec") as f:
                    size = f.size()
                    ends = np.append(index["offset"][1:], size)
                    lo = 0
                    while lo < len(index):  # a few MB of records at a time
                        hi = max(lo + 1, int(np.searchsorted(ends, index["offset"][lo] + (8 << 20), "right")))
                        begin = int(index["offset"][lo])
                        data = f.read_at(int(ends[hi - 1]) - begin, begin)
                        rows, at = [], 0
                        for i in range(lo, hi):
                            payload, after = unframe(data, at)
                            if after + begin != ends[i]:
                                raise ValueError(f"index and records differ in part {part}, record {i}")
                            doc_id, ids = unpack_ids(payload, unzip)
                            rows.append((doc_id, base + int(index["start"][i]), len(ids), ids.astype("<u4").tobytes()))
                            at = after
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                                          pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                                                         names=["doc_id", "start", "n_tokens", "ids"])
                        lo = hi

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_at(path: str, part: int, rows: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their place in it, in the order asked for: the random access that the index is for."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    store, root = _open(path)
    with store.open_input_file(f"{root}/part-{part:06d}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    out = []
    with store.open_input_file(f"{root}/part-{part:06d}.rec") as f:
        ends = np.append(index["offset"][1:], f.size())
        for r in rows:
            begin = int(index["offset"][r])
            out.append(unpack_ids(unframe(f.read_at(int(ends[r]) - begin, begin))[0], unzip))
    return out
