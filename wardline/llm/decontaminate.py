"""Benchmark decontamination by the q-gram lemma.

If a stretch of a document is within k edits of a benchmark item of m characters, the two share at least m + 1 - q - k*q character q-grams, and
those lie on diagonals (place in the document minus place in the item) within k of the true one. Shared q-grams are therefore counted
in overlapping bands of diagonals, bands that reach the bound are kept, and a banded alignment decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bound_batches, text_batches, texts

#: Characters searched at a time; their hashes fit a processor's cache.
GROUP = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Code points, one per character: letters lower, white space as a blank, so offsets are those of the text."""
    if not _LOWER:
        t = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                t[i] = 32
            elif c.isupper() and len(c.lower()) == 1:
                t[i] = ord(c.lower())
        t[0] = 1  # 0 stands between documents
        _LOWER.append(t)
    return _LOWER[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return c.astype(np.uint64) + np.uint64(7)
    left = _grams(c, n // 2)
    right = left if n % 2 == 0 else _grams(c, n - n // 2)
    power = np.uint64(pow(int(_BASE), n - n // 2, 1 << 64))
    return left[:len(c) - n + 1] * power + right[n // 2:n // 2 + len(c) - n + 1]


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, put together from those of its halves."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h = _grams(c, q)
    return h ^ (h >> np.uint64(29))


class Index:
    """Postings of the items' q-grams. Items under `least` characters are too short to tell anything and are not searched."""

    def __init__(self, items: list[tuple[int, str]], rate: float = 0.1, q: int = 8, least: int = 20):
        self.ids, self.text, self.k, self.q = [], [], [], []
        by_q = defaultdict(list)
        for item_id, t in items:
            c = codes(t)
            if len(c) < least:
                continue
            k = int(rate * len(c))
            own = min(q, len(c) // (k + 1), len(c))  # the bound stays at 1 or more
            by_q[own].append((len(self.ids), gram_hashes(c, own)))
            self.ids.append(item_id)
            self.text.append(c)
            self.k.append(k)
            self.q.append(own)
        self.m = np.array([len(c) for c in self.text], np.int64)
        self.k, self.q = np.array(self.k, np.int64), np.array(self.q, np.int64)
        self.need = self.m + 1 - self.q - self.k * self.q
        self.lists = {}
        for own, rows in by_q.items():
            h = np.concatenate([g for _, g in rows])
            item = np.concatenate([np.full(len(g), i) for i, g in rows])
            pos = np.concatenate([np.arange(len(g)) for _, g in rows])
            order = np.argsort(h, kind="stable")
            grams, begin = np.unique(h[order], return_index=True)
            bits = int(min(26, max(16, np.ceil(np.log2(len(grams) + 1)) + 5)))
            table = np.zeros(1 << bits, bool)
            shift = np.uint64(64 - bits)
            table[grams >> shift] = True
            self.lists[own] = (grams, begin, np.append(begin[1:], len(h)), item[order], pos[order], table, shift)

    def candidates(self, c: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first diagonal of a band two steps wide, from the document's start) where the bound is met."""
        found = []
        for own, (grams, begin, end, item, pos, table, shift) in self.lists.items():
            h = gram_hashes(c, own)
            at = np.flatnonzero(table[h >> shift])
            g = np.minimum(np.searchsorted(grams, h[at]), len(grams) - 1)
            hit = grams[g] == h[at]
            at, g = at[hit], g[hit]
            n = end[g] - begin[g]
            rows = np.arange(n.sum()) + np.repeat(begin[g] - np.append(0, np.cumsum(n)[:-1]), n)
            at, it = np.repeat(at, n), item[rows]
            d = doc[at]
            step = 2 * self.k[it] + 1
            bucket = (at - starts[d] - pos[rows] + self.m[it]) // step
            wide = int(bucket.max(initial=0)) + 2
            key, count = np.unique((d * len(self.ids) + it) * wide + bucket, return_counts=True)
            nxt = np.searchsorted(key, key + 1)
            nxt = np.where((nxt < len(key)) & (key[np.minimum(nxt, len(key) - 1)] == key + 1), nxt, -1)
            both = count + np.where(nxt >= 0, count[nxt], 0)
            # a band that begins one step earlier: only the second half has hits
            owner, bucket = np.divmod(key, wide)
            d, it = np.divmod(owner, len(self.ids))
            ok = both >= self.need[it]
            found.append((d[ok], it[ok], bucket[ok] * (2 * self.k[it[ok]] + 1) - self.m[it[ok]]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start, end, edits) of every stretch of a text within the item's edit budget; of overlapping
        stretches of one item the one with the fewest edits, then the first."""
        if not self.ids:
            return []
        each = [codes(t) for t in texts]
        lens = np.array([len(x) + 1 for x in each])
        starts = np.cumsum(lens) - lens
        c = np.concatenate([np.append(x, np.uint32(0)) for x in each])
        d, it, first = self.candidates(c, np.repeat(np.arange(len(each)), lens), starts)
        best: dict[tuple[int, int], set] = defaultdict(set)
        for doc, i, (edits, a, b) in zip(d.tolist(), it.tolist(), align([self.text[i] for i in it], [each[x] for x in d], first, 2 * (2 * self.k[it] + 1), self.k[it])):
            if edits <= self.k[i]:
                best[doc, i].add((edits, a, b))
        out = []
        for (doc, i), hits in best.items():
            kept: list[tuple[int, int, int]] = []
            for edits, a, b in sorted(hits):
                if all(b <= x or y <= a for _, x, y in kept):
                    kept.append((edits, a, b))
            out += [(doc, self.ids[i], a, b, e) for e, a, b in kept]
        return out


def _rows(p: np.ndarray, m: np.ndarray, text: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Banded edit distances, many alignments at a time: text[r, j + i] faces p[r, i] on diagonal j, d holds the distances before the first
    character of each p. Rows are ordered by falling length m, so those whose p has ended are the last."""
    span = d.shape[1]
    idx = np.arange(span, dtype=np.int32)
    for i in range(p.shape[1]):
        n = int(np.searchsorted(-m, -i))  # rows with m > i
        old = d[:n]
        new = old + (text[:n, i:i + span] != p[:n, i, None])
        np.minimum(new[:, :-1], old[:, 1:] + 1, out=new[:, :-1])  # a character of p is left out
        new -= idx
        d[:n] = np.minimum.accumulate(new, axis=1) + idx  # characters of the text are left out
    return d


def align(items: list[np.ndarray], docs: list[np.ndarray], first: np.ndarray, wide: np.ndarray, k: np.ndarray, block: int = 256) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best stretch of each document whose alignment with its item stays in diagonals first - k ..
    first + wide + k at least."""
    out: list = [None] * len(docs)
    size = np.array([len(p) for p in items], np.int64)
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(docs), block):
        own = order[lo:lo + block]
        m, n, top = size[own], len(own), int(k[own].max())
        longest, span = int(m[0]), int((wide[own] + 2 * k[own]).max()) + 1
        base = first[own] - k[own]
        p = np.zeros((n, longest), np.uint32)
        text = np.zeros((n, span + longest), np.uint32)
        for r, (j, b) in enumerate(zip(own.tolist(), base.tolist())):
            p[r, :m[r]] = items[j]
            a, z = max(b, 0), min(len(docs[j]), b + span + int(m[r]))
            if a < z:
                text[r, a - b:z - b] = docs[j][a:z]
        d = _rows(p, m, text, np.zeros((n, span), np.int32))
        edits, end = d.min(1), d.argmin(1) + m
        # the same backwards from the end, anchored there: the best start
        back, turned = np.zeros((n, 2 * top + 1 + longest), np.uint32), np.zeros_like(p)
        for r, e in enumerate(end.tolist()):
            x = text[r, max(0, e - int(m[r]) - top):e][::-1]
            back[r, top:top + len(x)] = x
            turned[r, :m[r]] = p[r, :m[r]][::-1]
        idx = np.arange(2 * top + 1)
        d = _rows(turned, m, back, np.where(idx >= top, idx - top, 1 << 20).astype(np.int32)[None, :].repeat(n, 0))
        length = m + d.argmin(1) - top
        for j, e, b, z, w in zip(own.tolist(), edits.tolist(), base.tolist(), end.tolist(), length.tolist()):
            out[j] = (e, max(0, b + z - w), min(len(docs[j]), b + z))
    return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most `block_chars` characters (a longer item is a list of its own); one empty list if there are none."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield block


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, q: int = 8, least: int = 20, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no stretch of a benchmark item (see `contaminated`). A filter on the text alone:
    nothing is shuffled. Rows with a null text stay."""
    bound_batches(docs.sparkSession)
    for block in item_blocks(benchmark, block_chars):
        hit = _hit(docs.sparkSession.sparkContext.broadcast(block), rate, q, least)
        docs = docs.where(~hit(docs["text"]))
    return docs


def _hit(items, rate: float, q: int, least: int):
    """A boolean function of a text column: it holds a stretch of one of the broadcast items."""

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items.value, rate, q, least)
        for s in batches:
            found, at = np.zeros(len(s), bool), 0
            for group in text_batches(s, GROUP):
                for d, *_ in index.search(group):
                    found[at + d] = True
                at += len(group)
            yield pd.Series(found)

    return hit


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, q: int = 8, least: int = 20, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, start, end, edits: stretches text[start:end] of a document within rate * length edits of a benchmark item, in
    characters, letter case and kind of white space aside.

    Items are broadcast in blocks of at most `block_chars` characters (a longer item is a block of its own), one pass over the documents per
    block. Null texts have no stretches; null items and items under `least` characters are not searched. Repeated documents and
    items give rows of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    whole = texts(docs)
    out = None
    for block in item_blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            index = Index(sent.value, rate, q, least)
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    part = b.slice(lo, 500)
                    ids, at = part.column("doc_id").to_pylist(), 0
                    for group in text_batches(part.column("text").to_pylist(), GROUP):
                        cols = list(zip(*((ids[at + d], *rest) for d, *rest in index.search(group)))) or [()] * 5
                        at += len(group)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end", "edits"])

        found = whole.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.union(found)
    return out
