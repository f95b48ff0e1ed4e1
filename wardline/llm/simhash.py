"""SimHash near-duplicates through an inverted index of byte positions.

A 64-bit fingerprint is eight (position, byte) pairs. Fingerprints that differ in at most d bits share at least 8 - d of them, so a
pair's shared bytes are counted and pairs below that minimum dropped before the bits are compared. One positional byte has
only 256 values, and its posting list would grow with the table; the lists are therefore keyed by several positions at once, chosen so that
any 8 - d shared positions contain one of the keys (for d = 3: the triples within each half, eight lists per fingerprint).
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import stored, text_batches, texts
from wardline.llm.components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle of a text, repeats included; fewer words: of the whole sequence; none: no hashes."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_UPPER))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(begins[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, part: int = 200_000) -> int:
    """Bit i is set if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), part):
        counts += np.unpackbits(hashes[lo:lo + part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def remixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th family of hashes: the given ones for 0, for others a bijective mix of them."""
    if i == 0:
        return hashes
    h = hashes ^ np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(text: Column, k: int = 5, words: int = 1) -> Column:
    """`words` signed 64-bit fingerprints of a text column, as an array (null and wordless texts: 0)."""

    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for group in text_batches(s):
            for t in group:
                h = shingle_hashes(t, k)
                out.append(np.array([fingerprint(remixed(h, i)) for i in range(words)], np.uint64).astype(np.int64))
        return pd.Series(out, dtype=object)

    return run(text)


def describe(text: Column, k: int, words: int, bands: int, rows: int) -> Column:
    """Of each text's set of k-word shingles, repeats left out: n, their number; node, a 64-bit hash of the set (a name for texts of equal sets);
    f, `words` fingerprints; more, a key for each of `bands` bands of `rows` smallest hashes. Sets of overlap J share a band with probability
    1 - (1 - J ** rows) ** bands."""
    odd = np.random.default_rng(11).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("n int, node long, f array<long>, more array<long>")
    def run(s: pd.Series) -> pd.DataFrame:
        n, node, f, more = [], [], [], []
        for group in text_batches(s):
            sets = [np.unique(shingle_hashes(t, k)) for t in group]
            n += map(len, sets)
            node += [xxhash.xxh64_intdigest(h.tobytes()) for h in sets]
            f += [np.array([fingerprint(remixed(h, i)) for i in range(words)], np.uint64).astype(np.int64) for h in sets]
            padded = [h if len(h) else np.zeros(1, np.uint64) for h in sets]
            flat, at = np.concatenate(padded), np.cumsum([0, *map(len, padded[:-1])])
            keys = np.zeros((len(sets), bands), np.uint64)
            for i, a in enumerate(odd):
                keys[:, i // rows] = keys[:, i // rows] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * a, at)
            more += list((keys ^ odd[:bands]).view(np.int64))
        return pd.DataFrame({"n": np.array(n, np.int32), "node": np.array(node, np.uint64).view(np.int64), "f": f, "more": more})

    return run(text)


def position_keys(least: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` of the eight byte positions of a word such that any `least` positions hold one of them whole."""
    groups = max(g for g in range(1, 9) if -(-least // g) >= size)
    cut = [range(8 * i // groups, 8 * (i + 1) // groups) for i in range(groups)]
    return [c for g in cut for c in itertools.combinations(g, size)]


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def _shared(x: Column) -> Column:
    """How many of the eight positional bytes agree, given the two words' exclusive or."""
    return sum((F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(1, 8)), F.when(_byte(x, 0) == 0, 1).otherwise(0))


def links(nodes: DataFrame, words: int = 1, bits: int = 3, least: int = 5, size: int = 3, block: int = 1024, short: int = 16,
          indexed: int | None = None) -> DataFrame:
    """Edges a, b between nodes (columns node, f: array of `words` fingerprints) that span every group linked at `bits` or fewer
    differing bits in all and at least `least` shared positional bytes. The bytes of the first `indexed` words (if not given, of all) are
    keys of the index, and so are those of an array column `more`, if `nodes` has one.

    Posting lists up to `short` long are joined with themselves; each true pair is an edge. A longer list is cut into blocks, and every two
    blocks meet in a task of their own. A block alone gives an edge from each node to the smallest one of its group; two blocks give edges between
    the smallest nodes of groups that hang together across them. So no pair is left out of the comparison, no list meets in one task, a list
    of n nodes gives about n edges instead of n * n, and lists of the same nodes give the same edges.
    """
    keys = [(w, ps) for w in range(words if indexed is None else indexed) for ps in position_keys(min(max(least, size), 8), size)]
    entry = F.array(*[F.concat_ws(".", F.lit(w), F.lit("-".join(map(str, ps))), *[_byte(F.col("f")[w], p) for p in ps]) for w, ps in keys])
    lists = ([F.transform(entry, lambda e: F.xxhash64(e))] if keys else []) + (["more"] if "more" in nodes.columns else [])
    posted = nodes.select("node", "f", F.explode(F.concat(*lists)).alias("key"))
    count = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = stored(posted.join(count, "key"), "postings")
    small = listed.where(F.col("n") <= short)
    a, b = (small.select("key", F.col("node").alias(c), *[F.col("f")[w].alias(f"{c}{w}") for w in range(words)]) for c in "ab")
    x = [F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")) for w in range(words)]
    differ = sum((F.bit_count(c) for c in x[1:]), F.bit_count(x[0]))
    agree = sum((_shared(c) for c in x[1:]), _shared(x[0]))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (differ <= bits) & (agree >= least)).select("a", "b")
    long = listed.where(F.col("n") > short)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    met = (long.select("key", "node", "f", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
           .select("key", "node", "f", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["own"] == pdf[c]] for c in ("ij" if pdf["i"].iat[0] != pdf["j"].iat[0] else "i")]
        return pd.DataFrame(spanning(*[(x["node"].to_numpy(), _matrix(x["f"], words)) for x in sides], bits=bits, least=least), columns=["a", "b"])

    return pairs.union(met.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long"))


def _matrix(f: pd.Series, words: int) -> np.ndarray:
    return np.array(f.tolist(), np.int64).reshape(len(f), words).view(np.uint64)


class Groups:
    """Groups of nodes (each named by the place of its smallest one) that merge."""

    def __init__(self, *blocks: np.ndarray):
        self.nodes = np.unique(np.concatenate(blocks))
        self.label = np.arange(len(self.nodes))

    def at(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, nodes)

    def merge(self, i: int, others: np.ndarray) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """Put node i and the nodes `others` (by place) into one group. For each two groups that met: their smallest nodes, and the linked nodes."""
        own, met = self.label[i], []
        groups, first = np.unique(self.label[others], return_index=True)
        for g, j in zip(groups.tolist(), others[first].tolist()):
            if g != own:
                low, high = min(g, own), max(g, own)
                self.label[self.label == high] = low
                met.append(((self.nodes[high], self.nodes[low]), (self.nodes[i], self.nodes[j])))
                own = low
        return met

    def stars(self) -> list[tuple[int, int]]:
        """An edge from each node to the smallest of its group."""
        return [(self.nodes[i], self.nodes[g]) for i, g in enumerate(self.label.tolist()) if i != g]


def _edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


def spanning(*blocks: tuple[np.ndarray, np.ndarray], bits: int, least: int) -> np.ndarray:
    """Edges for one block of nodes and fingerprints (a star per group) or across two (between the smallest nodes of groups that hang together):
    links of `bits` or fewer differing bits and `least` or more shared bytes."""
    groups = Groups(*[nodes for nodes, _ in blocks])

    def meet(groups: Groups, one: int, other: int) -> list:
        at, f = groups.at(blocks[other][0]), blocks[other][1]
        out = []
        for i, own in zip(groups.at(blocks[one][0]).tolist(), blocks[one][1]):
            x = f ^ own
            near = np.flatnonzero(np.bitwise_count(x).sum(1) <= bits)
            near = near[(x[near].view(np.uint8).reshape(len(near), 8 * x.shape[1]) == 0).sum(1) >= least]
            out += groups.merge(i, at[near])
        return out

    if len(blocks) == 1:
        meet(groups, 0, 0)
        return _edges(groups.stars())
    meet(groups, 0, 0), meet(groups, 1, 1)  # what hangs together within a block is for the block's own task to report
    return _edges([roots for roots, _ in meet(groups, 0, 1)])


def lowest(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """node, component_id: the smallest `low` of a node's component. The smallest ids are written first, so that their join with a component
    that very many nodes share can be split."""
    joined = groups.select("node", "low").join(comp, "node", "left").select("node", "low", F.coalesce("component", "node").alias("c"))
    least = stored(joined.groupBy("c").agg(F.min("low").alias("component_id")), "lowest")
    return joined.select("node", "c").join(least, "c").select("node", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, words: int = 1, bits: int = 3, least: int | None = None, size: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, f (array of `words` signed fingerprints of k-word shingles), component_id: the smallest doc_id
    reachable through links of `bits` or fewer differing bits, the document itself included.

    `least` is the number of positional bytes that linked fingerprints share; if not given, the number that is certain, 8 * words - bits.
    Posting lists are keyed by `size` positions at once (if not given, 3 for least >= 5, else 2).
    Documents with equal fingerprints are one node, however many they are; with several words a node's name is a 64-bit hash of them. Null and
    wordless texts have fingerprint 0 and link like any other. Null ids are never smallest; a group of null ids only has a null
    component. Repeated ids stay rows of their own. Other columns are not read.
    """
    least = max(1, 8 * words - bits) if least is None else least
    size = size or (3 if least >= 5 else min(2, least))
    node = F.col("f")[0] if words == 1 else F.xxhash64("f")
    own = stored(texts(docs).select("doc_id", fingerprints(F.col("text"), k, words).alias("f")).withColumn("node", node), "fingerprints")
    groups = own.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("f").alias("f"))
    comp = components(links(groups.select("node", "f"), words, bits, least, size))
    return own.join(lowest(groups, comp), "node").select("doc_id", "f", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def overlapping(*blocks: tuple[np.ndarray, list[np.ndarray]], least: float) -> np.ndarray:
    """Pairs that span the groups of one block of nodes and their sets, or join the groups of two: sets that overlap by `least` (Jaccard) or more."""
    groups = Groups(*[nodes for nodes, _ in blocks])
    known, which = np.unique(np.concatenate([x for _, sets in blocks for x in sets]), return_inverse=True)
    parts = iter(np.split(which, np.cumsum([len(x) for _, sets in blocks for x in sets])[:-1]))
    mine = [[next(parts) for _ in sets] for _, sets in blocks]
    mark = np.zeros(len(known), np.int32)

    def meet(groups: Groups, one: int, other: int) -> list:
        at, sets = groups.at(blocks[other][0]), mine[other]
        size = np.array([len(x) for x in sets])
        out = []
        for i, own in zip(groups.at(blocks[one][0]).tolist(), mine[one]):
            small, large = np.minimum(size, len(own)), np.maximum(size, len(own))
            todo = np.flatnonzero((groups.label[at] != groups.label[i]) & (small >= np.maximum(large * least - 1e-6, 1)))
            if len(todo):
                mark[own] = 1
                both = np.add.reduceat(mark[np.concatenate([sets[j] for j in todo])], np.cumsum(size[todo]) - size[todo])
                mark[own] = 0
                out += groups.merge(i, at[todo[both / (size[todo] + len(own) - both) >= least]])
        return out

    within = [meet(groups, i, i) for i in range(len(blocks))]
    return _edges([pair for _, pair in (within[0] if len(blocks) == 1 else meet(groups, 0, 1))])


def verified(docs: DataFrame, members: DataFrame, k: int, least: float, block: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """Edges a, b that span every group of `members` (node, component, n, text_hash) whose sets of k-word shingles overlap by `least` or more.

    The members' sets are made anew from the texts of `docs`. All members of a component meet, in pairs of blocks that are bounded in members
    and bytes; a block gives a spanning forest, two blocks one pair for each two of their groups that hang together.
    """

    @F.pandas_udf("binary")
    def shingles(s: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, k)).tobytes() for t in s], dtype=object)

    held = docs.select("text", F.xxhash64("text").alias("text_hash")).join(members.select("text_hash"), "text_hash", "left_semi")
    held = held.select("text_hash", shingles("text").alias("s")).groupBy("text_hash").agg(F.first("s").alias("s"))
    count = members.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 8 / block_bytes)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    met = (members.join(count, "component").withColumn("own", own).join(held, "text_hash")
           .select("component", "node", "s", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
           .select("component", "node", "s", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["own"] == pdf[c]] for c in ("ij" if pdf["i"].iat[0] != pdf["j"].iat[0] else "i")]
        if not all(map(len, sides)):
            return pd.DataFrame(_edges([]), columns=["a", "b"])
        return pd.DataFrame(overlapping(*[(x["node"].to_numpy(), [np.frombuffer(b, np.uint64) for b in x["s"]]) for x in sides], least=least), columns=["a", "b"])

    return met.groupBy("component", "i", "j").applyInPandas(forest, "a long, b long")


def overlap_groups(docs: DataFrame, k: int = 5, least: float = 0.8, words: int = 3, bits: int = 60, bands: int = 24, rows: int = 4, shared: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, component_id: the smallest doc_id reachable through texts whose sets of k-word shingles overlap
    by `least` (Jaccard) or more, the document itself included.

    The fingerprints and their index of byte positions choose candidates: documents that share `shared` positional bytes, those of a key in
    the first word among them, and differ in at most `bits` of 64 * words bits hang together. (Two texts at 0.8 agree in two of eight fingerprint
    bytes only, and lists by so few bytes would grow with the square of the corpus; so documents that share a band of smallest hashes are held to
    the same `bits` as well.) Within each group of such candidates all sets are compared exactly. Documents of equal sets are one node. Null and wordless texts have
    the empty set and link with each other. Null ids are never smallest; a group of null ids only has a null component.
    """
    docs = texts(docs)
    own = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), describe(F.col("text"), k, words, bands, rows).alias("x")).select("doc_id", "text_hash", "x.*"), "sets")
    groups = stored(own.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("f").alias("f"), F.first("more").alias("more")), "set-nodes")
    by_bytes = links(groups.select("node", "f"), words, bits, shared, shared, indexed=1)
    near = stored(components(by_bytes.union(links(groups.select("node", "f", "more"), words, bits, 0, indexed=0))), "candidates")
    members = stored(near.join(groups.select("node", "n", "text_hash"), "node"), "members")
    comp = components(verified(docs, members, k, least))
    return own.select("doc_id", "node").join(lowest(groups, comp), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group of texts whose sets of k-word shingles overlap by `least` (Jaccard) or more the
    document with the smallest id stays, with all its columns.

    Rows of equal id and text count once. Rows with a null id stay only in groups without any id.
    """
    kept = overlap_groups(docs, k, least).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    left = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return left.dropDuplicates(["doc_id", "text"])
