"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model over words. Its automaton has a root and one state per training word (with `min_share`, only per
word with at least that share of all training tokens). An arc of state v for word w carries log10 P(w | v); where v has no such
arc, its failure arc, weighted with v's backoff, leads to the root, whose arcs carry the unigram probabilities. After reading w the
automaton stands in w's state, or in the root if w has none. A text is read once from left to right.

    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))                      every word, and one place for all unknown ones
    P(w | v) = max(c(vw) - d, 0) / c(v) + b(v) P(w)                 c(vw) > 0
             = b(v) P(w)                                            otherwise, b(v) such that all P(. | v) add up to 1

No task holds the whole model. Texts are cut into blocks of bounded size. The distinct words and bigrams of a block go, as sorted arrays of
64-bit names, to ranges of names; a range holds a bounded number of entries, adds up what all blocks sent, and sends each block its sums
in the block's own order. The arcs that leave a state are added up in the same way. Then a block's texts are read with the part of the
automaton that they can reach.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bound_batches, fold_of, stored

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Stands for the end of a text; no word holds it. It is number 0 in every block.
_END = b"\n"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def squeeze(a: np.ndarray, zip_, kind: str = "<u4") -> bytes:
    """Whole numbers, byte planes apart, compressed."""
    return zip_.compress(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, int(kind[-1])).T).tobytes())


def unsqueeze(data: bytes, unzip, kind: str = "<u4") -> np.ndarray:
    raw = np.frombuffer(unzip.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(int(kind[-1]), -1).T).view(kind).ravel().astype(np.int64)


class Block:
    """Texts as numbers of their words in this block; each ends with number 0."""

    def __init__(self):
        self.number = _Numbers()
        self.number[_END] = 0
        self.ids, self.held, self.lens, self.parts, self.chars = [], [], [], [], 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        row = np.empty(len(data) + 1, np.int32)
        row[:-1] = np.fromiter(map(self.number.__getitem__, data), np.int32, len(data))
        row[-1] = 0
        self.ids.append(doc_id)
        self.held.append(held)
        self.lens.append(len(row))
        self.parts.append(row)
        self.chars += len(text or "") + 20

    def batch(self, block: int, zip_) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        train = np.repeat(~np.array(self.held), self.lens)
        counts = np.bincount(tokens[train], minlength=len(self.number))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.number], np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({
            "block": [block], "ids": pa.array([self.ids], pa.list_(pa.int64())), "held": pa.array([self.held], pa.list_(pa.bool_())),
            "lens": pa.array([self.lens], pa.list_(pa.int32())), "tokens": pa.array([squeeze(tokens, zip_)], pa.binary()),
            "h": pa.array([hashes], pa.list_(pa.int64())), "n": pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))})


def blocks(docs: DataFrame, held, block_chars: int) -> DataFrame:
    """One row per block of texts (a longer text is a block of its own): ids, held, lens, tokens, and per word its hash and training count."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        zip_ = zstandard.ZstdCompressor(level=1)
        block, at = Block(), TaskContext.get().partitionId() << 24
        for b in batches:
            for doc_id, held_out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                block.add(doc_id, held_out, text.as_py())
                if block.chars >= block_chars:
                    yield block.batch(at, zip_)
                    block, at = Block(), at + 1
        if block.ids:
            yield block.batch(at, zip_)

    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(
        run, "block long, ids array<long>, held array<boolean>, lens array<int>, tokens binary, h array<long>, n array<int>")


SENT = "part int, block long, names binary, values array<binary>"
SUMS = "part int, block long, sums array<binary>, once binary, total long, kinds long, ones long, twos long"


def send(block: int, names: np.ndarray, values: list[np.ndarray], parts: int, zip_) -> pa.RecordBatch:
    """One row per range of names that a block has entries in; `names` are ascending, unsigned."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cut = [0, *np.searchsorted(names, edges).tolist(), len(names)]
    at = [i for i in range(parts) if cut[i] < cut[i + 1]]
    pack = lambda x, i: squeeze(x[cut[i]:cut[i + 1]], zip_, "<u8")
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([block] * len(at), pa.int64()), pa.array([pack(names, i) for i in at], pa.binary()),
                                       pa.array([[pack(v, i) for v in values] for i in at], pa.list_(pa.binary()))], names=["part", "block", "names", "values"])


def add_up(sent: pa.Table) -> pa.Table:
    """The sums of a range of names over all blocks, back to each block in its order of names; once marks the first block that has a name.
    Of the first values: their total and how many names have more than none, one and two, on one row of the range."""
    import zstandard

    zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    names = [unsqueeze(x.as_py(), unzip, "<u8") for x in sent.column("names")]
    values = [[unsqueeze(x, unzip, "<u8") for x in row.as_py()] for row in sent.column("values")]
    _, first, which = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    sums = []
    for v in zip(*values):
        of = np.zeros(len(first), np.int64)
        np.add.at(of, which, np.concatenate(v))
        sums.append(of)
    once = np.zeros(len(which), bool)
    once[first] = True
    ends = np.cumsum([len(x) for x in names])
    rows = [slice(e - len(x), e) for x, e in zip(names, ends.tolist())]
    stats = [int(sums[0].sum()), int((sums[0] > 0).sum()), int((sums[0] == 1).sum()), int((sums[0] == 2).sum())]
    only = [pa.array([x] + [0] * (len(rows) - 1), pa.int64()) for x in stats]
    return pa.table([sent.column("part"), sent.column("block"), pa.array([[squeeze(x[which[r]], zip_, "<u8") for x in sums] for r in rows], pa.list_(pa.binary())),
                     pa.array([np.packbits(once[r]).tobytes() for r in rows], pa.binary()), *only], names=[x.split()[0] for x in SUMS.split(", ")])


def gather(sums: pa.Table, kind: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What the ranges of one kind sent to a block, joined in the order of its names: the sums and the marks of first blocks."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    at = np.flatnonzero(sums.column("kind").to_numpy() == kind)
    at = at[np.argsort(sums.column("part").to_numpy()[at])].tolist()
    parts = [[unsqueeze(x, unzip, "<u8") for x in sums.column("sums")[i].as_py()] for i in at]
    marks = [np.unpackbits(np.frombuffer(sums.column("once")[i].as_py(), np.uint8), count=len(p[0])).astype(bool) for i, p in zip(at, parts)]
    return [np.concatenate(x) for x in zip(*parts)], np.concatenate(marks) if marks else np.zeros(0, bool)


class Reach:
    """The words and bigrams of one block: tokens and the word before each (a text begins after an end), names of words in their order, counts
    per word number, and the bigrams of two words with a state: their names, the places where they end, and which name stands there. Where one
    occurrence makes a state, all bigrams are named, so that no counts of words are needed (`sums` may be left out)."""

    def __init__(self, block: pa.Table, sums: pa.Table | None, least: int):
        import zstandard

        self.tokens = unsqueeze(block.column("tokens")[0].as_py(), zstandard.ZstdDecompressor())
        self.lens = block.column("lens")[0].values.to_numpy()
        self.train = np.repeat(~block.column("held")[0].values.to_numpy(zero_copy_only=False), self.lens)
        self.words = block.column("h")[0].values.to_numpy().view(np.uint64)
        self.order = np.argsort(self.words)
        self.before = np.append(0, self.tokens[:-1])
        if sums is not None:
            self.count = self.by_word(gather(sums, 0)[0][0])
            self.state = self.count >= least
        self.at = np.arange(len(self.tokens)) if least <= 1 else np.flatnonzero(self.state[self.tokens] & self.state[self.before])
        x = self.words[self.before[self.at]] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.tokens[self.at]]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        self.pairs, self.which = np.unique(x ^ (x >> np.uint64(29)), return_inverse=True)

    def by_word(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words), np.int64)
        out[self.order] = sums
        return out

    def per_pair(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.pairs), np.int64)
        out[self.which] = x[self.at]
        return out


class Automaton:
    """The part of the automaton that one block can reach. root: log10 P(w) per word number; fail: log10 backoff per word number (0: no state); arcs:
    log10 P(w | v) per distinct bigram of the block, nan where there is no arc."""

    def __init__(self, root: np.ndarray, fail: np.ndarray, arcs: np.ndarray):
        self.root, self.fail, self.arcs = root, fail, arcs

    def walk(self, reach: Reach) -> np.ndarray:
        """log10 probability of each token. The state before a token follows from the token before it alone, so all steps of the walk are
        taken at once."""
        out = self.root[reach.tokens] + self.fail[reach.before]  # along the failure arc to the root
        arc = self.arcs[reach.which]
        out[reach.at] = np.where(np.isnan(arc), out[reach.at], arc)
        return out


def score(docs: DataFrame, held=None, min_share: float = 0.0, block_chars: int = 14_000_000, part_entries: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`; texts with `held` true are not learnt from.

    Letters A-Z count as lower case; words are split at ASCII white space, and a text ends with one end token. Null texts are
    empty: the end token alone. Words and bigrams are counted by 64-bit hashes. Repeated ids are texts of their own. Without training texts N and V
    are 0 and all words are unknown. Every word of the training texts has a state, unless `min_share` asks for more of it; a range of names
    holds about `part_entries` entries. Other columns are not read.
    """
    held = fold_of("doc_id", 10) == 0 if held is None else held
    bound_batches(docs.sparkSession)
    cut = stored(blocks(docs, held, block_chars), "lm-blocks")
    size = cut.agg(F.sum(F.size("h")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    word_parts, pair_parts = (max(1, -(-(x or 0) // part_entries)) for x in size)

    def words_of(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for block, h, n in zip(b.column("block").to_pylist(), b.column("h"), b.column("n")):
                names = h.values.to_numpy().view(np.uint64)
                order = np.argsort(names)
                yield send(block, names[order], [n.values.to_numpy()[order]], word_parts, zip_)

    def summed(sent: DataFrame, name: str) -> DataFrame:
        return stored(sent.groupBy("part").applyInArrow(add_up, SUMS), name)

    def with_sums(fn, schema: str, *sums: DataFrame) -> DataFrame:
        back = reduce(DataFrame.union, [x.select("block", F.lit(i).alias("kind"), "part", "sums", "once") for i, x in enumerate(sums)])
        return cut.drop("n").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(fn, schema)

    words = summed(cut.select("block", "h", "n").mapInArrow(words_of, SENT), "lm-words")
    total = words.agg(F.sum("total"), F.sum("kinds")).first()
    n, v = total[0] or 0, total[1] or 0
    least = max(1, int(np.ceil(min_share * n)))

    def pairs_of(block: pa.Table, sums: pa.Table | None) -> pa.Table:
        import zstandard

        r = Reach(block, sums, least)
        count = np.bincount(r.which[r.train[r.at]], minlength=len(r.pairs))
        return pa.Table.from_batches([send(block.column("block")[0].as_py(), r.pairs, [count], pair_parts, zstandard.ZstdCompressor(level=1))])

    def all_pairs(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from pairs_of(pa.Table.from_batches([b.slice(i, 1)]), None).to_batches()

    told = cut.select("block", "held", "lens", "tokens", "h").mapInArrow(all_pairs, SENT) if least <= 1 else with_sums(pairs_of, SENT, words)
    pairs = summed(told, "lm-pairs")
    seen = pairs.agg(F.sum("ones"), F.sum("twos")).first()
    d = min(0.9, max(0.1, seen[0] / (seen[0] + 2 * seen[1]))) if seen[0] else 0.5

    def arcs_of(block: pa.Table, sums: pa.Table) -> pa.Table:
        """Per word how many arcs leave its state and the sum of their counts; an arc is told by the first block that has it."""
        import zstandard

        r = Reach(block, sums, least)
        (c2,), once = gather(sums, 1) if len(r.pairs) else ([np.zeros(0, np.int64)], np.zeros(0, bool))
        mine = once & (c2 > 0)
        first = r.per_pair(r.before)[mine]
        arcs = np.bincount(first, minlength=len(r.words))[r.order]
        counts = np.bincount(first, c2[mine], len(r.words)).astype(np.int64)[r.order]
        return pa.Table.from_batches([send(block.column("block")[0].as_py(), r.words[r.order], [counts, arcs], word_parts, zstandard.ZstdCompressor(level=1))])

    arcs = summed(with_sums(arcs_of, SENT, words, pairs), "lm-arcs")
    below = n + 0.1 * (v + 1)

    def read(block: pa.Table, sums: pa.Table) -> pa.Table:
        r = Reach(block, sums, least)
        c2 = gather(sums, 1)[0][0] if len(r.pairs) else np.zeros(0, np.int64)
        leaving = [r.by_word(x) for x in gather(sums, 2)[0]]
        of = np.maximum(r.count, 1).astype(np.float64)
        fail = np.where(r.state, np.log10(np.maximum(1 - (leaving[0] - d * leaving[1]) / of, 1e-12)), 0.0)
        root = np.log10((r.count + 0.1) / below)
        first, second = r.per_pair(r.before), r.per_pair(r.tokens)
        found = np.log10(np.maximum(c2 - d, 0) / of[first] + 10 ** (fail[first] + root[second]))
        auto = Automaton(root, fail, np.where(c2 > 0, found, np.nan))
        begin = np.cumsum(r.lens) - r.lens
        add = lambda x: np.add.reduceat(x, begin)
        return pa.table({"doc_id": block.column("ids")[0].values, "held_out": block.column("held")[0].values, "n_tokens": r.lens.astype(np.int64),
                         "n_known": add((r.count[r.tokens] > 0).astype(np.int64)), "train_tokens": np.full(len(r.lens), n),
                         "base_score": add(root[r.tokens]), "score": add(auto.walk(r))})

    return with_sums(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", words, pairs, arcs)
