"""Spelling variants: words at edit distance one, found by bit-sliced position indexes over blocks of the vocabulary.

Two words at one edit share the first or the second half of the shorter one, untouched. Words are therefore dealt by (shorter length, half) to
blocks of bounded size. A block is indexed by bitsets: for a position and a letter, which of its words have that letter there. All words that look
for neighbours walk the positions together; four bitsets each follow the words that agree so far, and those with one letter replaced,
missing or added, whose next letters are looked up at the same, the previous or the next position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import stored

LETTERS = "a-z\\u00C0-\\u00FF"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, shortest: int = 6, fewest: int = 5, drop_one_in: int | None = 199) -> DataFrame:
    """word, n: how often each word occurs in all texts; words of at least `shortest` code points and `fewest` occurrences.

    Words are runs of letters, A-Z lower-cased. Where `drop_one_in` divides the crc32 of "<doc_id>:<run>", the run loses one letter there: a
    seeded sprinkle of misspellings. Null texts have no words, a null id counts as empty text in the crc32; repeated rows count again.
    """
    # a run of at least `shortest` letters is maximal: a shorter one cannot give a word
    runs = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("word"))
    if drop_one_in:
        w = F.col("word")
        h = F.crc32(F.concat("id", w))
        at = (h % F.length(w)).cast("int")
        shorter = F.concat(F.substr(w, F.lit(1), at), F.substr(w, at + 2))
        rows = rows.where((F.length(w) > shortest) | (h % drop_one_in != 0)).select(F.when(h % drop_one_in == 0, shorter).otherwise(w).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)]).view("<u8")


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of letter codes (0 behind the end) and their lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return out, size


class PositionIndex:
    """Bitsets over a block of words: at(p)[c] says which words have letter number c at position p. Letters are numbered over the block;
    number 0 stands for letters that no word has, and its bitset is empty."""

    def __init__(self, codes: np.ndarray, size: np.ndarray):
        self.size, self.alphabet = size, np.unique(codes[codes > 0])
        self.codes = np.where(codes > 0, np.searchsorted(self.alphabet, codes) + 1, 0).astype(np.uint8 if len(self.alphabet) < 255 else np.uint32)

    def number(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == codes, at + 1, 0) if len(self.alphabet) else np.zeros(codes.shape, np.int64)

    def at(self, p: int) -> np.ndarray:
        if not 0 <= p < self.codes.shape[1]:
            return _bits(np.zeros((len(self.alphabet) + 1, len(self.size)), bool))
        flags = self.codes[:, p] == np.arange(len(self.alphabet) + 1, dtype=np.uint32)[:, None]
        flags[0] = False
        return _bits(flags)

    def of_length(self, n: int) -> np.ndarray:
        return _bits(self.size == n)

    def near(self, codes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs at exactly one edit; `codes` holds queries of m letters each."""
        c = self.number(codes[:, :m])
        zero = np.broadcast_to(_bits(np.ones(len(self.size), bool)), (len(c), -(-len(self.size) // 64))).copy()
        swapped, missing, added = (np.zeros_like(zero) for _ in range(3))  # a letter replaced; a letter of the query skipped; a letter of the word skipped
        before, here, after = self.at(-1), self.at(0), self.at(1)
        for i in range(m):
            there = here[c[:, i]]
            any_letter = _bits(self.size > i)
            missing = (missing & before[c[:, i]]) | zero
            added = (added | zero) & after[c[:, i]]
            swapped = (swapped & there) | (zero & ~there & any_letter)
            zero &= there
            before, here, after = here, after, self.at(i + 2)
        found = (swapped & self.of_length(m)) | (missing & self.of_length(m - 1)) | ((added | zero) & self.of_length(m + 1))
        row, word = np.nonzero(found)
        bit = np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, place = np.nonzero(bit)
        return row[which], word[which] * 64 + place


def near_in_block(left: list[str], right: list[str], shorter: int, queries: int = 2048) -> list[tuple[int, int]]:
    """(left, right) numbers of the words at exactly one edit. All words have `shorter` letters or one more, one of each pair `shorter`."""
    index = PositionIndex(*letters_of(right))
    codes, size = letters_of(left)
    out = []
    for m in (shorter, shorter + 1):
        own = np.flatnonzero(size == m)
        for lo in range(0, len(own), queries):
            q, w = index.near(codes[own[lo:lo + queries]], m)
            out += zip(own[lo + q].tolist(), w.tolist())
    return [(q, w) for q, w in out if min(size[q], index.size[w]) == shorter]


def near_words(words: DataFrame, block: int = 2048) -> DataFrame:
    """word, near, near_n: all ordered pairs of `words` (word, n; distinct) at exactly one inserted, deleted or replaced code point, each once.

    A word of length L is listed by the two halves of length L and by those of length L - 1, as the longer partner. Lists are dealt by hash to
    buckets of about `block` entries; a bucket that holds more (a half that very many words share) is cut into blocks, and every two of them
    meet in a task of their own. A pair is kept where it shares its first half, or its second and not the first, so none comes twice.
    """
    size = F.length("word")
    side = F.explode(F.array(*[F.struct(s.alias("a"), F.lit(k).alias("tail")) for s in (size, size - 1) for k in (False, True)]))
    half = F.floor(F.col("a") / 2).cast("int")
    text = F.when(F.col("tail"), F.substr("word", size - (F.col("a") - half) + 1)).otherwise(F.substr("word", F.lit(1), half))
    listed = (words.select("word", "n", side.alias("s")).select("word", "n", "s.*").where("a >= 1")
              .withColumn("half", F.xxhash64("a", "tail", text)))
    held = F.greatest(F.lit(1), F.least(F.lit(block), F.lit(4 << 20) / F.first("a")))  # of very long words fewer, so that a block stays small
    wide = listed.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("buckets"))
    dealt = stored(listed.join(wide, "a").select("a", "tail", "word", "n", F.pmod("half", "buckets").cast("int").alias("bucket")), "variant-lists")
    count = dealt.groupBy("a", "tail", "bucket").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("word", F.lit(5)), "blocks").cast("int")
    met = (dealt.join(count, ["a", "tail", "bucket"]).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("a", "tail", "bucket", "word", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    schema = "word string, near string, near_n long"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, tail, _, i, j = (k.as_py() for k in key)
        own = np.asarray(table.column("own"))
        word, n = np.array(table.column("word").to_pylist(), object), np.asarray(table.column("n"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        cols: tuple[list, list, list] = ([], [], [])
        h = a // 2

        def keep(q: int, w: int) -> None:
            for c, v in zip(cols, (word[q], word[w], n[w])):
                c.append(v)

        for q, w in near_in_block(word[left].tolist(), word[right].tolist(), a):
            u, v = word[left[q]], word[right[w]]
            head = u[:h] == v[:h]
            if (u[len(u) - (a - h):] == v[len(v) - (a - h):] and not head) if tail else head:
                keep(left[q], right[w])
                if i != j:
                    keep(right[w], left[q])
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["word", "near", "near_n"])

    return met.groupBy("a", "tail", "bucket", "i", "j").applyInArrow(run, schema)


def roots(forms: DataFrame, rounds: int = 60) -> DataFrame:
    """word, root for every word of `forms` (word, form): the last word of its chain. Each round doubles the steps that a word has gone;
    a form occurs several times as often as its word, so chains are short and have no cycles."""
    at = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(rounds):
        on = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = stored(at.join(on, at["root"] == on["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")
    raise ValueError("forms have a cycle")


def variants(words: DataFrame, factor: int = 5, block: int = 2048) -> DataFrame:
    """One row per word of `words` (word, n; distinct): word, n, n_near (words at one edit), form (the most frequent of them, ties: the first in
    code-point order, if it is at least `factor` times as frequent; else null), form_n (its n), root (the end of the chain of forms; the
    word itself if it has none). No words: no rows."""
    if factor < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(words, "variant-words")
    best = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    good = -F.col("best.less") >= F.col("n") * factor
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"),
                                F.when(good, -F.col("best.less")).alias("form_n")), "variant-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, shortest: int = 6, fewest: int = 5, factor: int = 5, drop_one_in: int | None = 199) -> DataFrame:
    """The words of all whole texts of `docs` with their variants: `variants` of `word_counts`. Only doc_id and text are read."""
    return variants(word_counts(docs.select("doc_id", "text"), shortest, fewest, drop_one_in), factor)
