"""Population filters, exact quantiles and time-ordered train / test splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.functions import expr as X

FINAL_ROWS = 1_000_000


def exact_quantile(df: DataFrame, c: Column, q: float, final_rows: int = FINAL_ROWS) -> float | None:
    """Exact linear-interpolated quantile without ever sorting the table (see `at_ranks`)."""
    v = df.select(c.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    size = v.count()
    if size == 0:
        return None
    pos = q * (size - 1)
    k, frac = math.floor(pos), pos - math.floor(pos)
    found = at_ranks(v, size, [k] if frac == 0 else [k, k + 1], final_rows)
    low = found[k]
    return float(low if frac == 0 else low + (found[k + 1] - low) * frac)


def at_ranks(v: DataFrame, size: int, ranks: list[int], final_rows: int = FINAL_ROWS) -> dict[int, float]:
    """The values of column ``v`` (``size`` rows, none null or NaN) at neighbouring 0-based ranks.

    Each pass is a map-side-combined scan: a mergeable sketch brackets the wanted ranks, and exact counts say in
    which part they lie. Ties at the bracket ends are settled by counting, the open middle is bracketed again,
    and only a middle of at most ``final_rows`` rows is ranked row by row.
    """
    found: dict[int, float] = {}
    todo = list(ranks)
    cur, below = v, 0
    while todo:
        if size <= final_rows:
            # a bounded remainder, so one ordered pass is fine
            order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            ranked = cur.groupBy("v").count().withColumn("upto", F.sum("count").over(order))
            row = ranked.agg(*[F.min(F.when(F.col("upto") > r - below, F.col("v"))) for r in todo]).first()
            found |= dict(zip(todo, row))
            break
        eps = 1e-4
        ends = [max(0.0, (todo[0] - below) / size - eps), min(1.0, (todo[-1] + 1 - below) / size + eps)]
        a, b = cur.agg(*[F.percentile_approx("v", e, 20_000) for e in ends]).first()
        x = F.col("v")
        parts = {"lt": x < a, "lo": x == a, "mid": (x > a) & (x < b), "hi": (x == b) & (x > a), "gt": x > b}
        stats = cur.agg(*[f(F.when(cond, x)).alias(f"{p}_{n}") for p, cond in parts.items() for n, f in (("n", F.count), ("min", F.min), ("max", F.max))]).first()
        left = None
        for r in list(todo):
            at = r - below
            for p in parts:
                n = stats[f"{p}_n"]
                if at < n:
                    edge = stats[f"{p}_min"] if at == 0 or p in ("lo", "hi") else stats[f"{p}_max"] if at == n - 1 else None
                    if edge is None:
                        left = p
                    else:
                        found[r] = edge
                        todo.remove(r)
                    break
                at -= n
        if left:
            names = list(parts)
            below += sum(stats[f"{p}_n"] for p in names[:names.index(left)])
            size, cur = stats[f"{left}_n"], cur.filter(parts[left])
    return found


def take_by_hash(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all if fewer): those with the smallest seeded draws, ties by row id.

    The n-th smallest draw is found by rank, without sorting; then one filter takes all rows below it.
    """
    drawn = df.withColumn("_u", X.digest_fraction(F.col(row_id), seed))
    total = df.count()
    if n <= 0 or total <= n:
        return df.limit(0) if n <= 0 else df
    cut = at_ranks(drawn.select(F.col("_u").alias("v")), total, [n - 1])[n - 1]
    below = drawn.filter(F.col("_u") < cut)
    tied = drawn.filter(F.col("_u") == cut).orderBy(row_id).limit(n - below.count())  # rows of one 52-bit draw
    return below.unionByName(tied).drop("_u")


def login_population(df: DataFrame, mode: str = "success", success="success", takeover="takeover", ts="ts") -> DataFrame:
    """``success``: successful logins; ``genuine``: also no takeover; ``clamped``: up to the last negative."""
    ok = df.filter(F.col(success))
    if mode == "success":
        return ok
    if mode == "genuine":
        return ok.filter(~F.col(takeover))
    if mode == "clamped":
        last = ok.filter(~F.col(takeover)).agg(F.max(ts).alias("last_negative")).scalar()
        return ok.filter(F.col(ts) <= last)
    raise ValueError(f"unknown mode {mode!r}")


def split_at(df: DataFrame, column: str, cut) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cut, rows after it."""
    return df.filter(F.col(column) <= cut), df.filter(F.col(column) > cut)


def split_quantile(df: DataFrame, column: str, q: float = 0.8) -> tuple[DataFrame, DataFrame, float]:
    cut = exact_quantile(df, F.col(column), q)
    return *split_at(df, column, F.lit(cut)), cut


def split_label_quantile(df: DataFrame, ts: str, y: str, q: float = 0.6) -> tuple[DataFrame, DataFrame, int]:
    """Cut at the q-quantile of the positives' times (whole microseconds, rounded down); without positives all rows are before it."""
    cut = exact_quantile(df.filter(F.col(y) == 1), X.micros(ts), q)
    cut = 2**63 - 1 if cut is None else int(math.floor(cut))
    micros = X.micros(ts)
    return df.filter(micros <= cut), df.filter(micros > cut), cut


def cap_negatives(df: DataFrame, y: str, cap: int, seed: int, row_id: str) -> DataFrame:
    """All positives and exactly ``cap`` negatives, chosen by hash order (a seeded, repeatable draw)."""
    pos, neg = df.filter(F.col(y) == 1), df.filter(F.col(y) == 0)
    return pos.unionByName(take_by_hash(neg, row_id, cap, seed))


def thin_negatives(df: DataFrame, y: str, fraction: float, seed: int, row_id: str) -> DataFrame:
    """All positives and a hash-chosen fraction of the negatives: one filter, no shuffle."""
    return df.filter((F.col(y) == 1) | (X.hash_fraction(F.col(row_id), seed) < fraction))


def stratified_sample(df: DataFrame, label: str, p: float, seed: int, row_id: str | None = None) -> DataFrame:
    """Keep every positive and a Bernoulli(p) share of the rest; repeatable when a row id is given."""
    draw = X.digest_fraction(F.col(row_id), seed) if row_id else F.rand(seed)
    return df.filter(F.coalesce(F.col(label).cast("boolean"), F.lit(False)) | (draw < p))


def rtt_feature(df: DataFrame, column: str, impute: bool = False, out: str = "rtt") -> DataFrame:
    """log1p of a numeric-looking text column, missing values optionally set to the exact global median."""
    df = df.withColumn(out, X.log_rtt(F.col(column)))
    if not impute:
        return df
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(exact_quantile(df, F.col(out), 0.5))))
