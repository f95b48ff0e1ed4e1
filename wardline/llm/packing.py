"""Packing by lexical retrieval.

Documents are dealt to index shards of bounded size. Each shard is a BM25 inverted index of its own (terms are token ids). Whole windows
of a long document are sequences by themselves; what is left of every document is packed: a seed opens a window, the index returns
the unused documents that match it best, and they fill the window greedily. A document that does not fit is cut, and its rest stays
in the index, so at most one window of a shard is not full.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import text_batches, texts
from wardline.llm.tokens import END_ID, shared_encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"


class Bm25:
    """An inverted index over documents given as arrays of term numbers."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        self.n = len(docs)
        lens = np.array([len(d) for d in docs], np.float64)
        found = np.concatenate([np.sort(d) for d in docs]) if docs else np.zeros(0, np.uint16)
        begin = np.append(0, np.cumsum(lens.astype(np.int64)))
        fresh = np.append(True, found[1:] != found[:-1])[:len(found)]
        fresh[begin[:-1][lens > 0]] = True
        at = np.flatnonzero(fresh)  # the first of each term of each document
        of, count = found[at], np.diff(np.append(at, len(found)))
        self._at = np.searchsorted(at, begin)
        doc = np.repeat(np.arange(self.n), np.diff(self._at))
        order = np.argsort(of, kind="stable")
        self.doc, tf, of = doc[order], count[order], of[order]
        self.begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])[:len(of)])
        self.end = np.append(self.begin[1:], len(of)) if len(of) else self.begin
        self.terms, df = of[self.begin], self.end - self.begin
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lens / max(lens.mean() if self.n else 1.0, 1e-9))
        self.weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[self.doc])
        self._of = np.empty(len(order), np.int64)
        self._of[order] = np.repeat(np.arange(len(df)), df)
        # lists of terms that over an eighth of the documents hold, as whole rows: at most eight times the postings
        often = df * 8 > self.n
        self._row = np.where(often, np.cumsum(often) - 1, -1)
        self._rows = np.zeros((int(often.sum()), self.n), np.float32)
        mine = np.repeat(often, df)
        self._rows[np.repeat(self._row, df)[mine], self.doc[mine]] = self.weight[mine]

    def _match(self, terms: np.ndarray) -> np.ndarray:
        """Scores for terms given by their place in the index."""
        row = self._row[terms]
        whole = np.zeros(len(self._rows), np.float32)
        whole[row[row >= 0]] = 1
        terms = terms[row < 0]
        size = self.end[terms] - self.begin[terms]
        rows = np.arange(size.sum()) + np.repeat(self.begin[terms] - np.append(0, np.cumsum(size)[:-1]), size)
        return np.bincount(self.doc[rows], self.weight[rows], self.n) + whole @ self._rows

    def like(self, d: int) -> np.ndarray:
        """The score of every document for all terms of document d."""
        return self._match(self._of[self._at[d]:self._at[d + 1]])

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The BM25 score of every document for the distinct terms of a query."""
        return self._match(np.flatnonzero(np.isin(self.terms, query)))


def fill(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). Every token is in one piece; only the last sequence can be short."""
    out, left = [], []
    for d, ids in enumerate(docs):
        whole = len(ids) // window * window
        out += [[(d, s, window)] for s in range(0, whole, window)]
        left.append(whole)
    start = np.array(left, np.int64)
    size = np.array([len(x) for x in docs], np.int64) - start
    index = Bm25(docs)
    for seed in np.argsort(-size, kind="stable"):  # the longest rests first: they need the least to be filled
        while size[seed] > 0:
            seq, room = [], window
            score = None
            nxt = seed
            while True:
                n = int(min(room, size[nxt]))
                seq.append((int(nxt), int(start[nxt]), n))
                start[nxt] += n
                size[nxt] -= n
                room -= n
                if not room:
                    break
                if score is None:
                    score = np.where(size > 0, index.like(seed), -1.0)
                score[nxt] = -1.0
                nxt = int(score.argmax())  # ties: the earlier document
                if score[nxt] < 0:
                    break
            out.append(seq)
    return out


def pack(docs: DataFrame, window: int = 1024, shard_bytes: int = 4 << 20, shard_docs: int = 2000, seed: int = 3, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack all documents; one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and ids (uint32 LE).

    A document is its token ids and the end id. sequence_id is unique over all shards (index shard x 2^32 + number). Sequences hold
    `window` ids but for the last of an index shard, which its writer pads unless its length is a power of two. Ids and texts spread documents over
    index shards, so copies, one source or one repeated id do not gather in one. Null text: the end id alone. Repeated ids and rows are documents of
    their own. An index shard holds about `shard_bytes` of text and
    `shard_docs` documents. An empty table gives no rows. Other columns are not read.
    """
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    total = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), F.count(F.lit(1))).first()
    shards = max(1, math.ceil((total[0] or 0) / shard_bytes), math.ceil(total[1] / shard_docs))
    # xxhash64 skips nulls, so rows without an id are dealt by text and place instead: many of one text do not meet in one shard
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("tie", F.monotonically_increasing_id(), F.lit(seed))).otherwise(F.xxhash64("doc_id", "tie", F.lit(seed)))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        enc, tokens = shared_encoder(tokenizer, end_id), []
        for group in text_batches(table.column("text").to_pylist()):
            tokens += enc.encode(group)
        names = table.column("doc_id").to_pylist()
        cols: list[list] = [[] for _ in range(8)]
        for s, seq in enumerate(fill(tokens, window)):
            at = 0
            for d, start, n in seq:
                ids = tokens[d][start:start + n].astype("<u4").tobytes()
                for c, v in zip(cols, (names[d], start, n, len(tokens[d]), (shard << 32) + s, at, zlib.crc32(ids), ids)):
                    c.append(v)
                at += n
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.withColumn("shard", F.pmod(key, F.lit(shards))).groupBy("shard").applyInArrow(run, PIECES)

