"""Boosted trees of several fits over one encoded table: MLlib's GBT classifier step by step, a level of all fits' trees in one pass.

MLlib fits one model at a time and keeps an object per row and fit. Here rows lie in blocks: a byte or two per feature, and eight bytes of
margin per fit. A pass adds up counts and residuals by (fit, feature, node, bin) in each task; the best cuts are found where these sums meet, so
only cuts reach the driver. Cut points, drawn rows, residuals and leaf values are those of MLlib for the same table and seed.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

BINS = 256
MAX_DEPTH = 6  # a bit of a word for every leaf
BLOCK_ROWS = 1 << 16
EPSILON = np.finfo(float).eps
TASK_BLOCKS = 16
LINEAGE = 10  # rounds after which the margins are written to the checkpoint folder
_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1


@dataclass
class Fit:
    """One model: the inputs in MLlib's order of features, its seed, and what is known of its cuts and trees."""

    cols: list[str]
    seed: int
    cuts: dict[str, np.ndarray | int] = field(default_factory=dict)  # thresholds of a number, count of a text's categories
    trees: list[Tree] = field(default_factory=list)

    def used(self) -> list[int]:
        """Features with something to cut; the first one stands for the sums where no feature has."""
        return [i for i, c in enumerate(self.cols) if bins(self.cuts[c]) > 1] or [0]

    def width(self) -> int:
        """The most bins of a feature: a sample that came out larger than expected leaves a few above BINS."""
        return max(bins(self.cuts[self.cols[i]]) for i in self.used())


class Tree:
    """A tree of full depth in heap order. A node that is not cut sends its rows to the left, with its value."""

    def __init__(self, depth: int, width: int):
        n = 2 ** (depth + 1) - 1
        self.depth, self.feature, self.value, self.open = depth, np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        self.right = np.zeros((2**depth - 1, width), bool)
        self.impurity = np.full(n, np.nan)  # of a node's rows, as its parent's cut gave it
        self.open[0] = True

    def tables(self, levels: int) -> list[tuple[int, np.ndarray]]:
        """Per feature that is cut, and bin of it: a bit for every node of that level which a row with the bin may reach.

        Where a row goes right the nodes under the left side drop out, so that its node is the lowest bit that all features leave.
        """
        found: dict[int, np.ndarray] = {}
        for i in range(2**levels - 1):
            if self.right[i].any():
                level = (i + 1).bit_length() - 1
                half = 2 ** (levels - level - 1)
                left = ((1 << half) - 1) << (2 * half * (i + 1 - 2**level))
                table = found.setdefault(int(self.feature[i]), np.full(self.right.shape[1], _M64, np.uint64))
                table[self.right[i]] &= np.uint64(_M64 ^ left)
        return list(found.items())


_BRUIJN = 0x03F79D71B4CB0A89
_PLACE = np.zeros(64, np.intp)
_PLACE[[(_BRUIJN << i & _M64) >> 58 for i in range(64)]] = np.arange(64)


def reached(binned: np.ndarray, tables: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Every row's node on the level the tables are for, counted from the left; ``binned`` holds a row of bins per feature."""
    if not tables:
        return np.zeros(binned.shape[1], np.intp)
    word = tables[0][1].take(binned[tables[0][0]])
    for j, t in tables[1:]:
        word &= t.take(binned[j])
    word &= ~word + np.uint64(1)
    word *= np.uint64(_BRUIJN)
    word >>= np.uint64(58)
    return _PLACE.take(word.view(np.int64))


def bins(cut: np.ndarray | int) -> int:
    return cut if isinstance(cut, int) else len(cut) + 1


# ---- Spark's generator, for the same rows as MLlib draws -----------------------------
def hashed_seed(seed: int) -> int:
    """The state XORShiftRandom starts from: MurmurHash3 of the seed's bytes, twice."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & _M32
    data = (seed & _M64).to_bytes(8, "big")

    def murmur(h: int) -> int:
        for i in (0, 4):
            k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & _M32
            h = (rot(h ^ (rot(k, 15) * 0x1B873593 & _M32), 13) * 5 + 0xE6546B64) & _M32
        h ^= 8
        h = (h ^ (h >> 16)) * 0x85EBCA6B & _M32
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M32
        return h ^ (h >> 16)

    low = murmur(0x3C074A61)
    return (murmur(low) << 32) | low


def _step(s):
    s = s ^ (s << np.uint64(21))
    s = s ^ (s >> np.uint64(35))
    return s ^ (s << np.uint64(4))


def first_int(seed: int) -> int:
    x = int(_step(np.array([hashed_seed(seed)], np.uint64))[0]) & _M32
    return x - (1 << 32) if x >> 31 else x


def _apply(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for i in range(8):
        out ^= tables[i].take(((states >> np.uint64(8 * i)) & np.uint64(255)).view(np.int64))
    return out


@lru_cache(1)
def _powers() -> list[np.ndarray]:
    """The step is linear in the bits of the state: what 2**i steps make of every byte of it, for every i."""
    made, bits = [], _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    for _ in range(48):
        t = np.zeros((8, 256), np.uint64)
        for b in range(8):
            t[:, 1 << b:2 << b] = t[:, :1 << b] ^ bits[b::8, None]
        made.append(t)
        bits = _apply(t, bits)
    return made


def drawn(seed: int, partition: int, start: int, n: int, rate: float) -> np.ndarray:
    """Which rows of ``start`` .. ``start + n`` of a partition a draw without replacement takes."""
    power = _powers()
    s = np.array([hashed_seed(seed + partition + 1)], np.uint64)
    for i, bit in enumerate(reversed(bin(2 * start)[2:])):
        s = _apply(power[i], s) if bit == "1" else s
    k = max(0, (2 * n - 1).bit_length() - 10)  # runs of 2**k states side by side
    while len(s) << k < 2 * n:
        s = np.concatenate([s, _apply(power[k + len(s).bit_length() - 1], s)])
    runs = np.empty((1 << k, len(s)), np.uint64)
    for i in range(1 << k):
        s = runs[i] = _step(s)
    x = runs.T.reshape(-1)[: 2 * n]
    high, low = x[0::2] & np.uint64((1 << 26) - 1), x[1::2] & np.uint64((1 << 27) - 1)
    return (high << np.uint64(27)) + low < np.uint64(math.ceil(rate * 2.0**53))


# ---- cut points ---------------------------------------------------------------------
def thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` cut points between the values of a sample; zeros are counted as what ``expected`` leaves."""
    values = values[values != 0]
    if not len(values):
        return np.empty(0)
    v, c = np.unique(values, return_counts=True)
    c = c.astype(float)
    if expected - len(values) > EPSILON * len(values) * 100:
        i = np.searchsorted(v, 0.0)
        v, c = np.insert(v, i, 0.0), np.insert(c, i, expected - len(values))
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) <= most:
        return middle
    stride = target = expected / (most + 1)
    found, total = [], c[0]
    for i in range(1, len(v)):
        before, total = total, total + c[i]
        if abs(before - target) < abs(total - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def arity(df: DataFrame, col: str) -> int:
    """Number of categories of an indexed text, 0 for a number."""
    attr = df.schema[col].metadata.get("ml_attr", {})
    return len(attr["vals"]) if "vals" in attr else attr.get("num_vals", 0)


def find_cuts(train: DataFrame, fit: Fit, n: int) -> None:
    most = min(BINS, n)
    share = min(1.0, max(most * most, 10_000) / n)
    numbers = [c for c in fit.cols if not arity(train, c)]
    fit.cuts.update({c: arity(train, c) for c in fit.cols if c not in numbers})
    if not numbers:
        return
    rows = train.select(*numbers)
    if share < 1:  # the rows an RDD's sample takes, as MLlib asks for it
        session = train.sparkSession
        java = rows._jdf.javaRDD().sample(False, share, first_int(fit.seed))
        rows = DataFrame(session._jsparkSession.createDataFrame(java, rows._jdf.schema()), session)
    table = rows.toArrow()
    fit.cuts.update({c: thresholds(table[c].to_numpy(), share * n, most - 1) for c in numbers})


# ---- passes -------------------------------------------------------------------------
def binned(batch: pa.Table | pa.RecordBatch, fit: Fit) -> np.ndarray:
    """A row of bins per used feature, a byte each if that holds them."""
    out, kind = [], np.uint8 if fit.width() <= 256 else np.uint16
    for i in fit.used():
        x, cut = batch.column(fit.cols[i]).to_numpy(zero_copy_only=False), fit.cuts[fit.cols[i]]
        out.append((x if isinstance(cut, int) else np.searchsorted(cut, x)).astype(kind))
    return np.ascontiguousarray(np.stack(out))


def sharing(fits: list[Fit]) -> list[int]:
    """For each fit the first one with the same seed and inputs, so that equal bytes are kept once."""
    keys = [(f.seed, tuple(f.cols[i] for i in f.used())) for f in fits]
    return [keys.index(k) for k in keys]


def make_blocks(batches: Iterator[pa.RecordBatch], y: str, fits: list[Fit], same: list[int], rate: float, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks: partition and first row, labels -1 / 1, bytes of the fits, margins, rows drawn for the first tree."""
    part, start, held = TaskContext.get().partitionId(), 0, []

    def block(rows: pa.Table) -> pa.RecordBatch:
        sign = (2 * rows.column(y).to_numpy() - 1).astype(np.int8)
        made = [binned(rows, f) if same[i] == i else None for i, f in enumerate(fits)]
        state = part, start, sign, made, [np.zeros(0) for _ in fits], draws(fits, 0, part, start, len(sign), rate)
        return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(state, 5)], pa.binary())})

    for b in batches:
        held.append(b)
        while (rows := sum(x.num_rows for x in held)) >= most:
            table = pa.Table.from_batches(held)
            yield block(table.slice(0, most))
            start += most
            held = table.slice(most).to_batches() if rows > most else []
    if sum(x.num_rows for x in held):
        yield block(pa.Table.from_batches(held))


def draws(fits: list[Fit], turn: int, part: int, start: int, n: int, rate: float) -> list:
    return [None if rate >= 1 else np.packbits(drawn(f.seed + turn, part, start, n, rate)) for f in fits]


def residuals(sign: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """What the next tree is fitted to: the label, later the loss's slope at the margin."""
    if not len(margin):
        return sign.astype(float)
    with np.errstate(over="ignore"):
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def sums(blocks: Iterator[tuple], fits: list[Fit], trees: list[Tree], same: list[int], level: int) -> Iterator[tuple]:
    """Rows drawn, their residuals and squared residuals added up by node and bin, for every (fit, feature) that has an open node on this level."""
    out: dict = {}
    first, width = 2**level - 1, 2**level
    plans = []
    for fit, tree in zip(fits, trees):
        live = np.flatnonzero(tree.open[first:first + width])
        slot = np.full(width, len(live) * fit.width(), np.intp)
        slot[live] = np.arange(len(live)) * fit.width()
        plans.append((slot, len(live), fit.width(), tree.tables(level), [(j, i, bins(fit.cuts[fit.cols[i]])) for j, i in enumerate(fit.used())]))
    for _, _, sign, made, margins, masks in blocks:
        wide = [m if m is None else m.astype(np.intp) for m in made]
        for k, (slots, live, bound, tables, used) in enumerate(plans):
            if not live:
                continue
            b = wide[same[k]]
            slot = slots.take(reached(b, tables))
            if masks[k] is not None:
                slot[np.unpackbits(masks[k], count=len(slot)) == 0] = live * bound
            r = residuals(sign, margins[k])
            square, size = r * r, (live + 1) * bound
            for j, i, nb in used:
                key = slot + b[j]
                h = out.setdefault((k, i), np.zeros((3, live, nb)))
                for at, x in enumerate((None, r, square)):
                    h[at] += np.bincount(key, x, size).reshape(live + 1, bound)[:live, :nb]
    yield from out.items()


def variance(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(x[0] == 0, 0.0, (x[2] - x[1] * x[1] / x[0]) / x[0])


def best_cuts(h: np.ndarray, categories: bool, impurity: np.ndarray, least: int) -> list[tuple]:
    """Per node: gain in variance, the bins that go left, rows and sums of both sides and of the node. The first of equal gains wins.

    Sums and gains are made in MLlib's order of steps, because rounding decides between cuts that part the rows alike.
    """
    found = []
    for x, known in zip(np.moveaxis(h, 1, 0), impurity):
        order = np.arange(x.shape[1])
        if categories:
            with np.errstate(invalid="ignore", divide="ignore"):
                order = np.argsort(np.where(x[0] > 0, x[1] / x[0], np.inf), kind="stable")
        left = np.cumsum(x[:, order], axis=1)
        whole, left = left[:, -1], left[:, :-1]
        if not left.shape[1]:
            found.append((-1.0, None, None, None, whole))
            continue
        right = whole[:, None] - left
        if np.isnan(known):
            known = variance(left[:, 0] + right[:, 0])
        n = left[0] + right[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = known - left[0] / n * variance(left) - right[0] / n * variance(right)
        gain = np.where((left[0] >= least) & (right[0] >= least), gain, -1.0)
        i = int(np.argmax(gain))
        found.append((float(gain[i]), order[: i + 1], left[:, i], right[:, i], whole))
    return found


def cuts_of(x: tuple, fits: list[Fit], trees: list[Tree], level: int, least: int) -> list[tuple]:
    (k, i), h = x
    first = 2**level - 1
    nodes = first + np.flatnonzero(trees[k].open[first:2 * first + 1])
    return best_cuts(h, isinstance(fits[k].cuts[fits[k].cols[i]], int), trees[k].impurity[nodes], least)


def grow(tree: Tree, fit: Fit, found: dict[int, list[tuple]], level: int, gain_least: float) -> None:
    """Cut the open nodes of a level where that gains something."""
    mean = lambda x: x[1] / x[0] if x[0] else 0.0
    first, used = 2**level - 1, fit.used()
    live = [i for i in range(first, 2 * first + 1) if tree.open[i]]
    for i in range(first, 2 * first + 1):
        left = 2 * i + 1
        tree.value[left] = tree.value[i]
        if not tree.open[i]:
            continue
        j, best = max(((j, found[f][live.index(i)]) for j, f in enumerate(used)), key=lambda x: x[1][0])
        if level == 0:
            tree.value[i] = tree.value[left] = mean(best[4])
        if best[0] > 0 and best[0] >= gain_least:
            tree.feature[i] = j
            tree.right[i] = True
            tree.right[i, best[1]] = False
            for child, x in ((left, best[2]), (left + 1, best[3])):
                tree.value[child], tree.impurity[child] = mean(x), float(variance(x))
                tree.open[child] = level + 1 < tree.depth and abs(tree.impurity[child]) >= EPSILON


def moved(blocks: Iterator[tuple], fits: list[Fit], trees: list[Tree], same: list[int], turn: int, weight: float, rate: float) -> Iterator[tuple]:
    """The blocks with the margins after a finished tree and the rows drawn for the next."""
    plans = [(tree.tables(tree.depth), weight * tree.value[2**tree.depth - 1:]) for tree in trees]
    for part, start, sign, made, margins, _ in blocks:
        wide = [m if m is None else m.astype(np.intp) for m in made]
        after = []
        for k, (tables, value) in enumerate(plans):
            v = value.take(reached(wide[same[k]], tables))
            after.append(margins[k] + v if len(margins[k]) else v)
        yield part, start, sign, made, after, draws(fits, turn, part, start, len(sign), rate)


def dealt(state: RDD, n: int, most: int) -> RDD:
    """Blocks of a larger table in turn to tasks of equal size, whatever partitions it came in; a block knows the rows it holds."""
    cores, blocks, parts = state.ctx.defaultParallelism, -(-n // most), state.getNumPartitions()
    if blocks < 2 * cores:
        return state
    tasks = cores * -(-blocks // (TASK_BLOCKS * cores))
    each = -(-blocks // parts)
    return state.map(lambda b: (b[0] * each + b[1] // most, b)).partitionBy(tasks, lambda k: k).values()


def train_all(train: DataFrame, y: str, fits: list[Fit], n: int, rounds: int, depth: int, step: float, rate: float, least: int, gain_least: float) -> None:
    """Grow the trees of all fits, whose cuts are known; ``train`` is stored, with labels 0 / 1."""
    sc = train.sparkSession.sparkContext
    same, most = sharing(fits), BLOCK_ROWS
    cols = list(dict.fromkeys(c for f in fits for c in f.cols))
    bare = [Fit(f.cols, f.seed, f.cuts) for f in fits]  # trees travel by themselves
    state = train.select(F.col(y).cast("double").alias(y), *cols).mapInArrow(lambda it: make_blocks(it, y, bare, same, rate, most), "block binary")
    state = dealt(state.rdd.map(lambda r: pickle.loads(r[0])), n, most).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(1, min(sum(len(f.used()) for f in fits), sc.defaultParallelism))
    old = None
    for turn in range(rounds):
        trees = [Tree(depth, f.width()) for f in fits]
        for level in range(depth):
            # arguments are bound here, as later turns give these names other values
            by_key = state.mapPartitions(lambda it, t=trees, lv=level: sums(it, bare, t, same, lv)).reduceByKey(np.add, tasks)
            got = by_key.map(lambda x, t=trees, lv=level: (x[0], cuts_of(x, bare, t, lv, least))).collect()
            if old is not None:
                old.unpersist()
                old = None
            for k, (fit, tree) in enumerate(zip(fits, trees)):
                found = {i: v for (kk, i), v in got if kk == k}
                if found:
                    grow(tree, fit, found, level, gain_least)
                else:
                    closed(tree, level)
        for fit, tree in zip(fits, trees):
            fit.trees.append(tree)
        if turn + 1 < rounds:
            old, weight = state, step if turn else 1.0
            state = state.mapPartitions(lambda it, t=trees, m=turn + 1, w=weight: moved(it, bare, t, same, m, w, rate)).persist(StorageLevel.MEMORY_AND_DISK)
            if (turn + 1) % LINEAGE == 0:
                state.checkpoint()
    state.unpersist()


def closed(tree: Tree, level: int) -> None:
    """A level without open nodes hands every value to the left."""
    first = 2**level - 1
    for i in range(first, 2 * first + 1):
        tree.value[2 * i + 1] = tree.value[i]


def score_all(test: DataFrame, y: str, fits: list[Fit], step: float) -> DataFrame:
    """``y`` and the probability of every fit, in columns s0, s1, ..."""
    cols = list(dict.fromkeys(c for f in fits for c in f.cols))
    same = sharing(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = [[(t.tables(t.depth), (step if turn else 1.0) * t.value[2**t.depth - 1:]) for turn, t in enumerate(f.trees)] for f in fits]
        for batch in batches:
            made = [binned(batch, f).astype(np.intp) if same[i] == i else None for i, f in enumerate(fits)]
            out = {y: batch.column(y)}
            for k, plan in enumerate(plans):
                margin = np.zeros(batch.num_rows)
                for tables, value in plan:
                    margin += value.take(reached(made[same[k]], tables))
                with np.errstate(over="ignore"):
                    out[f"s{k}"] = pa.array(1.0 - 1.0 / (1.0 + np.exp(2.0 * margin)))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"`{y}` int, " + ", ".join(f"s{k} double" for k in range(len(fits)))
    return test.select(F.col(y).cast("int").alias(y), *cols).mapInArrow(run, schema)
