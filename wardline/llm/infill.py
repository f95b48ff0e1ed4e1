"""Fill-in-the-middle documents, cut by rank queries on a wavelet matrix of character classes.

The UTF-8 bytes of a batch of texts become one sequence of classes (inner byte of a code point, newline, other white space, first letter of
a word, any other character). A wavelet matrix over it counts any class before any position in a few array steps. Ranks combine into the number
of units that end at or before a position, and bisection on that count finds the place of a cut, for all documents of a batch at once.
Only numbers come back from Python; texts are cut, joined and hashed by column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import texts

INNER, OTHER, NEWLINE, SPACE, BEGIN = range(5)
LEVELS = 3
SENTINELS = ("<P>", "<S>", "<M>")


class WaveletMatrix:
    """rank(c, i): how often class c stands before position i. Each level holds one bit of the classes, with the ones counted before
    every 64-bit word; going down a level, zeros keep their order in front and ones behind them."""

    def __init__(self, classes: np.ndarray, levels: int = LEVELS):
        self.levels = []
        seq = classes.astype(np.uint8, copy=False)
        for level in reversed(range(levels)):
            bit = (seq >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, "<u8")  # one word more than needed where 64 divides the length: i may be the end
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            ones = bit.view(bool)
            zeros = len(seq) - int(np.count_nonzero(ones))
            self.levels.append((level, words, before, zeros))
            if level:
                seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, c: int, i: np.ndarray) -> np.ndarray:
        hi = np.asarray(i, np.int64)
        lo = np.zeros(1, np.int64)
        for level, words, before, zeros in self.levels:
            lo1, hi1 = (before[x >> 6] + np.bitwise_count(words[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))) for x in (lo, hi))
            lo, hi = (zeros + lo1, zeros + hi1) if c >> level & 1 else (lo - lo1, hi - hi1)
        return hi - lo


def classes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The class of each UTF-8 byte; `begin` holds where texts start (a word starts there, whatever stands before)."""
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = INNER
    kind[[9, 11, 12, 13, 32]] = SPACE
    kind[10] = NEWLINE
    out = kind[data]
    blank = (out == SPACE) | (out == NEWLINE)
    first = np.zeros(len(data), bool)
    first[1:] = blank[:-1]
    first[begin[begin < len(data)]] = True
    out[first & ~blank] = BEGIN
    return out


class Units:
    """Counts and cuts in units of a batch of texts, given as their bytes end to end and where each begins and ends.

    line: up to and with a newline, or the rest; word: from a word's first letter to the next word's (white space before the first
    belongs to it; a text of white space is one unit); char: a code point.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, unit: str = "line"):
        if unit not in ("line", "word", "char"):
            raise ValueError(f"no such unit: {unit}")
        self.begin, self.end, self.unit = begin, end, unit
        self.data, self.matrix = data, WaveletMatrix(classes(data, begin))
        self.base = {c: self.matrix.rank(c, begin) for c in (NEWLINE, BEGIN, INNER)}
        self.n = self.ended(end)

    def _since(self, c: int, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(c, at) - self.base[c]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points between a text's begin and a position."""
        return at - self.begin - self._since(INNER, at)

    def ended(self, at: np.ndarray) -> np.ndarray:
        """Units that end at or before a position of each text."""
        whole = (at == self.end) & (self.end > self.begin)
        if self.unit == "char":
            return self.chars(at)
        if self.unit == "line":
            last = self.data[np.maximum(self.end, 1) - 1] if len(self.data) else np.zeros(len(at), np.uint8)
            return self._since(NEWLINE, at) + (whole & (last != 10))
        seen = self._since(BEGIN, np.minimum(at + 1, self.end))
        return np.where(whole, np.maximum(seen, 1), np.maximum(seen - 1, 0))

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The first position where k units have ended, by bisection on the counts; always the start of a code point."""
        lo, hi = self.begin.copy(), self.end.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) // 2
            done = self.ended(mid) >= k
            lo, hi = np.where(done | (lo == hi), lo, mid + 1), np.where(done, mid, hi)
        while self.unit == "char" and np.any(inner := (hi < self.end) & (self.data[np.minimum(hi, len(self.data) - 1)] & 0xC0 == 0x80)):
            hi = hi + inner  # the count is complete with a code point's first byte; its other bytes follow
        return hi


def cuts(text: Column, first: Column, second: Column, unit: str = "line") -> Column:
    """Struct of n (units of the text), prefix (code points before the first of both cuts) and middle (code points between them); the cuts
    lie after first mod (n + 1) and second mod (n + 1) units, the smaller first. Null text counts as empty."""

    @F.arrow_udf("n long, prefix long, middle long")
    def run(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        h = [np.asarray(x) for x in (first, second)]
        bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        body = text.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        out, at = [np.zeros((3, 0), np.int64)], 0
        while at < len(text):  # lots of texts of about 4 MB: the matrix needs some 10 bytes for each
            upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (4 << 20), "right")) - 1)
            u = Units(data[bounds[at]:bounds[upto]], bounds[at:upto] - bounds[at], bounds[at + 1:upto + 1] - bounds[at], unit)
            k = np.sort(np.stack([x[at:upto] % (u.n + 1) for x in h]), axis=0)
            one, two = (u.chars(u.cut(x)) for x in k)
            out.append(np.stack([u.n, one, two - one]))
            at = upto
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=["n", "prefix", "middle"])

    return run(F.coalesce(text, F.lit("")).cast("binary"), first, second)


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The output text of psm and spm."""
    p, s, m = (F.lit(x) for x in SENTINELS)
    return F.when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Texts with a sentinel stay plain, so a cut output holds each of them once."""
    parts = F.split(output, "|".join(SENTINELS), -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """One row per row of `docs`: doc_id, n, form, prefix_chars, middle_chars, output.

    Two cuts fall after units drawn from a digest of seed and doc_id. `rate` of 100 documents are cut, `spm` of 100 of those with the suffix
    first; the others, empty or null texts and texts that hold a sentinel stay plain (output: the text, null counts as empty; no cuts).
    Null ids draw like the empty id; equal ids draw alike, so repeated rows give repeated rows. An empty table gives no rows. Other columns are
    not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = texts(docs).withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")))
    rows = rows.select("doc_id", "text", "h", cuts(F.col("text"), F.col("h")[0], F.col("h")[1], unit).alias("c"))
    text = F.col("text")
    plain = (text == "") | (F.col("h")[2] % 100 >= rate)
    for s in SENTINELS:
        plain = plain | text.contains(s)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "c.*", form.alias("form"))
    one, two = F.col("prefix").cast("int"), F.col("middle").cast("int")
    output = arranged(F.col("form"), F.substr(text, F.lit(1), one), F.substr(text, one + 1, two), F.substr(text, one + two + 1))
    is_cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(is_cut, F.col("prefix")).alias("prefix_chars"), F.when(is_cut, F.col("middle")).alias("middle_chars"),
                       F.when(is_cut, output).otherwise(text).alias("output"))
