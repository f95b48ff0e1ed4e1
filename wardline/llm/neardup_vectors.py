"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. Neighbour lists begin with nodes that lie side by side when nodes are sorted by random-hyperplane codes, and are
refined by comparing the neighbours of each node with each other. Where a list is full of links it is too short, so it is enlarged
to its whole group: within every group of linked nodes all are compared, block against block. Recall is audited against brute force on sampled
nodes, and more tables and rounds follow while it is under target.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import bound_batches, stored
from wardline.llm.components import components


def _matrix(column) -> np.ndarray:
    """Rows of a binary column of equal length as float64."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, u: the unit vector as bytes; null where the vector is null, empty, zero, or holds null or non-finite components."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column("embedding"):
                a = None
                if v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max(initial=0.0)
                    if np.isfinite(top) and top > 0:
                        x = x / top + 0.0  # no overflow in the norm, no negative zero
                        a = (x / np.sqrt(x @ x)).tobytes()
                out.append(a)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "u"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, u binary")


def first_lists(nodes: DataFrame, count: int, tables: range, ahead: int, seed: int, parts: int) -> DataFrame:
    """Edges (a, b, sim) between nodes close in the order of each table's code. Ranges of the order go to tasks, so a code that very many
    nodes share is spread like any other."""
    bits = max(1, math.ceil(math.log2(max(count, 2) / 16)))

    def code(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            size = np.array([len(x) for x in b.column("u").to_pylist()]) // 8
            for dim in np.unique(size).tolist():
                part = b.filter(pa.array(size == dim))
                m = _matrix(part.column("u"))
                for t in tables:
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng([seed, t, dim]).standard_normal((dim, bits + 1))
                    p = m @ planes[t, dim]
                    key = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    n = len(m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(key), pa.array(p[:, bits]),
                                                      part.column("node"), part.column("u")], names=["t", "dim", "code", "at", "node", "u"])

    def link(batches):
        tail = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if tail is None else pa.concat_tables([tail, rows])
            node, t, dim = (rows.column(c).to_numpy() for c in ("node", "t", "dim"))
            old = 0 if tail is None else len(tail)
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                m = _matrix(rows.column("u").combine_chunks().take(pa.array(own)))
                for step in range(1, ahead + 1):
                    i, j = own[:-step], own[step:]
                    ok = (t[i] == t[j]) & (j >= old)
                    sim = np.einsum("ij,ij->i", m[:-step][ok], m[step:][ok])
                    yield pa.RecordBatch.from_arrays([pa.array(node[i[ok]]), pa.array(node[j[ok]]), pa.array(sim)], names=["a", "b", "sim"])
            tail = rows.slice(max(0, len(rows) - ahead)).combine_chunks()

    order = ["t", "dim", "code", "at", "node"]
    return (nodes.select("node", "u").mapInArrow(code, "t int, dim int, code long, at double, node long, u binary")
            .repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(link, "a long, b long, sim double"))


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node: a, b, sim."""
    best = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("a", "b", "sim").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def descend(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: the neighbours of each node (own lists and, up to as many, lists that name it) are compared with each other; pairs better
    than the worst of an end's list enter it."""
    near = nearest(both_ways(lists), 2 * k)
    worst = lists.groupBy("a").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("n"))
    floor = nodes.join(worst, nodes["node"] == worst["a"], "left").select("node", "u", F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0).alias("low"))
    around = (near.join(floor, near["b"] == floor["node"]).groupBy("a").agg(F.collect_list(F.struct("node", "low", "u")).alias("x")))

    def meet(batches):
        for b in batches:
            out = [[], [], []]
            for row in b.column("x"):
                x = row.values
                node, low = x.field("node").to_numpy(), x.field("low").to_numpy()
                m = _matrix(x.field("u"))
                sim = m @ m.T
                take = sim > low[:, None]
                np.fill_diagonal(take, False)
                i, j = np.nonzero(take)
                out[0].append(node[i])
                out[1].append(node[j])
                out[2].append(sim[i, j])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "b", "sim"])

    found = around.select("x").mapInArrow(meet, "a long, b long, sim double")
    return nearest(lists.union(found), k)


def forest(edges: DataFrame) -> DataFrame:
    """Of the edges (a, b) those that join what the earlier edges of the same task have not joined."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            out = [[], []]
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def compare_groups(nodes: DataFrame, groups: DataFrame, least: float, block: int = 128) -> DataFrame:
    """node, linked, others: the rows in nodes linked with each node of `groups` (node, component), and those nodes, itself left out. All nodes of a component meet,
    in pairs of blocks; only counts leave a task."""
    size = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    spread = (groups.join(size, "component").join(nodes, "node").withColumn("own", own)
              .select("component", "node", "u", "w", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select("component", "node", "u", "w", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def count(t: pa.Table) -> pa.Table:
        own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
        node, w = t.column("node").to_numpy(), t.column("w").to_numpy()
        m = _matrix(t.column("u").combine_chunks())
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = m[one] @ m[two].T >= least
        if i[0] == j[0]:
            np.fill_diagonal(near, False)
            return pa.table({"node": node[one], "linked": near @ w[two], "others": near.sum(1)})
        return pa.table({"node": np.concatenate([node[one], node[two]]), "linked": np.concatenate([near @ w[two], w[one] @ near]),
                         "others": np.concatenate([near.sum(1), near.sum(0)])})

    return spread.groupBy("component", "i", "j").applyInArrow(count, "node long, linked long, others long").groupBy("node").agg(F.sum("linked").alias("linked"), F.sum("others").alias("others"))


def audit(nodes: DataFrame, linked: DataFrame, least: float, queries: int, seed: int, small: int = 8) -> float | None:
    """The share of its own links that a node with links has found, on average, for about `queries` nodes drawn by hash, each compared with every
    node; the average over nodes with at most `small` links alone, if that is lower. Copies count once, and a large group no more than its nodes.

    Nodes with and without found links are drawn apart, half of the queries each, and weighted back, so that many nodes without links do not keep
    linked ones out of the draw. None where no drawn node has a link: then recall is not known.
    """
    known = nodes.join(linked, "node", "left").select("node", "u", F.coalesce("others", F.lit(0)).alias("others"))
    sizes = {r["f"]: r["n"] for r in known.groupBy((F.col("others") > 0).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {f: min(1.0, queries / 2 / n) for f, n in sizes.items()}
    draw = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    picked = known.where(draw < F.when(F.col("others") > 0, F.lit(part.get(True, 0.0))).otherwise(F.lit(part.get(False, 0.0))))
    rows = picked.limit(2 * queries).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["u"]), []).append(r)
    sent = nodes.sparkSession.sparkContext.broadcast({d: (np.array([r["node"] for r in rs]), np.frombuffer(b"".join(r["u"] for r in rs), np.float64).reshape(len(rs), -1))
                                                      for d, rs in by_dim.items()})

    def truth(batches):
        n = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in sent.value.items()}
        for b in batches:
            size = np.array([len(x) for x in b.column("u").to_pylist()])
            for d, (ids, m) in sent.value.items():
                part = b.filter(pa.array(size == d))
                if len(part):
                    n[d] += ((m @ _matrix(part.column("u")).T >= least) & (ids[:, None] != part.column("node").to_numpy()[None, :])).sum(1)
        for d, (ids, _) in sent.value.items():
            yield pa.RecordBatch.from_pydict({"node": ids[n[d] > 0], "n": n[d][n[d] > 0]})

    there = {r["node"]: r["n"] for r in nodes.mapInArrow(truth, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    share = [(there[r["node"]], min(1.0, r["others"] / there[r["node"]]), 1 / part[r["others"] > 0]) for r in rows if r["node"] in there]
    return min((float(np.average([s for _, s, _ in x], weights=[w for _, _, w in x])) for x in (share, [s for s in share if s[0] <= small]) if x), default=None)


def saturated(lists: DataFrame, k: int, least: float) -> bool:
    """Whether some node's list is full of links: further ones may have found no room."""
    return not lists.where(F.col("sim") >= least).groupBy("a").count().where(F.col("count") >= k).isEmpty()


def near_duplicates(vectors: DataFrame, least: float = 0.95, k: int = 12, tables: int = 12, rounds: int = 3, target: float = 0.97, tries: int = 3,
                    queries: int = 1000, seed: int = 17) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links (other vectors with cosine >= least), component_id (the smallest vec_id
    reachable by links) and kept (vec_id = component_id).

    Every link is checked in double precision, so none is under `least`; links of a group whose nodes were not found to hang together can be
    missing, which the audit measures: while recall a node is under `target`, tables and rounds are added, up to `tries` times; then it is an error. Where
    the audit meets no link at all, tables are added once; if it still meets none, a warning says that recall is not known. Lists that are full of
    links are doubled while that joins groups. Vectors of
    different length do not link. Null, empty and zero vectors and those with null or non-finite components link with nothing. Repeated
    vectors and ids are rows of their own. Null ids are never smallest; a null id alone has a null component and is kept.
    """
    bound_batches(vectors.sparkSession)
    rows = stored(units(vectors), "units")
    grouped = rows.where("u is not null").groupBy("u").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("w"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "u", "low", "w"), "vector-nodes")
    count = nodes.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * tables / 50_000))
    lists = found = None
    for attempt in range(tries):
        begin = stored(first_lists(nodes, count, range(attempt * tables, (attempt + 1) * tables), 8, seed, parts), "begin")
        near = forest(begin.where(F.col("sim") >= least))  # also links that full lists have no room for
        found = stored(near if found is None else found.union(near), "found")
        lists = stored(nearest(both_ways(begin) if lists is None else both_ways(begin).union(lists), k), "lists")
        links = lists.where(F.col("sim") >= least).count()
        for _ in range(rounds):
            lists = stored(descend(lists, nodes, k), "lists")
            links, last = lists.where(F.col("sim") >= least).count(), links
            if links <= last * 1.001:
                break
        groups = stored(components(found.union(lists.where(F.col("sim") >= least).select("a", "b"))), "vector-groups")
        wide, apart, last = k, groups.select("component").distinct().count(), None
        while apart != last and saturated(lists, wide, least):
            # lists twice as long, as long as that joins groups: within a group all links are counted below, whatever the lists hold
            wide, last = 2 * wide, apart
            lists = stored(descend(lists, nodes, wide), "lists")
            groups = stored(components(found.union(lists.where(F.col("sim") >= least).select("a", "b"))), "vector-groups")
            apart = groups.select("component").distinct().count()
        linked = stored(compare_groups(nodes, groups, least), "linked")
        recall = audit(nodes, linked, least, queries, seed + attempt)
        if recall is not None and recall >= target or recall is None and (attempt or tries == 1 or count <= queries / 2):
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} a node is under {target} with {tries * tables} tables")
    if recall is None and count > queries / 2:
        warnings.warn(f"no link among the audited nodes of {count}: recall is not known", stacklevel=2)
    comp = nodes.join(groups, "node", "left").join(linked, "node", "left").select(
        "u", "low", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    label = comp.groupBy("c").agg(F.min("low").alias("component_id"))
    known = rows.where("u is not null").join(comp.join(label, "c").select("u", "n_links", "component_id"), "u").select("vec_id", "n_links", "component_id")
    alone = rows.where("u is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return known.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
