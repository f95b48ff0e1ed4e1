"""Alert budgets, selection rates and parity costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators import joins as J
from wardline.operators.splits import exact_quantile


def _within(scored: DataFrame, budgets: list[int], score: str) -> DataFrame:
    """Top rows per day, once per budget they fit in: at most max(budget) rows per day are multiplied."""
    top = J.top_k_per_day(scored, score, max(budgets))
    fits = F.filter(F.array(*[F.lit(b) for b in budgets]), lambda b: b >= F.col("rank"))
    return top.withColumn("budget", F.explode(fits))


def budget_sweep(scored: DataFrame, budgets: list[int], score: str = "score") -> DataFrame:
    """Per daily alert budget: share of positive rows reached and distinct positive users found."""
    hit = F.col("y") == 1
    totals = scored.agg(F.count_if(hit).alias("n_pos"), F.count_distinct(F.when(hit, F.col("user"))).alias("n_users"))
    found = _within(scored, budgets, score).groupBy("budget").agg(
        F.count_if(hit).alias("_rows"), F.count_distinct(F.when(hit, F.col("user"))).alias("users_found")
    )
    both = totals.select(F.struct("*").alias("t")).scalar()
    pos, users = both["n_pos"], both["n_users"]
    return found.select(
        "budget", (F.col("_rows") / F.greatest(pos, F.lit(1))).alias("userday_recall"), "users_found", users.alias("users_total"),
        F.try_divide("users_found", users).alias("detection_rate"),
    )


def budget_by_scenario(scored: DataFrame, windows: DataFrame, budgets: list[int], score: str = "score") -> DataFrame:
    """found / total users of every scenario per budget."""
    found = _within(scored, budgets, score).filter("y = 1").select("budget", "user").distinct()
    users = J.distinct_pairs(windows, ["user", "scenario"])
    wanted = users.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    marked = wanted.join(found.withColumn("_hit", F.lit(1)), ["budget", "user"], "left")
    return marked.groupBy("budget", "scenario").agg(F.count("_hit").alias("found"), F.count(F.lit(1)).alias("total"))


def selection_rates(decisions: DataFrame, cohort: str, selected: str = "selected", min_size: int = 200) -> DataFrame:
    """Share of challenged rows in every cohort that is large enough."""
    out = decisions.groupBy(cohort).agg(F.avg(F.col(selected).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= min_size)


def disparate_impact(rates: DataFrame) -> DataFrame:
    """min / max of the cohort rates and the four-fifths verdict."""
    agg = rates.agg(F.count(F.lit(1)).alias("cohorts"), F.min("rate").alias("_lo"), F.max("rate").alias("_hi"))
    ratio = F.when(F.col("_hi") > 0, F.col("_lo") / F.col("_hi")).otherwise(F.lit(1.0))
    return agg.select("cohorts", ratio.alias("impact_ratio"), (ratio >= 0.8).cast("int").alias("passes"))


def score_quantile(df: DataFrame, column: str, q: float) -> float | None:
    return exact_quantile(df, F.col(column), q)


def parity_cost(scores: DataFrame, cohort: str, safe, hot, threshold: float) -> DataFrame:
    """Recall of the hot cohort at the global threshold and at the one that equals the safe cohort's rate.

    Without rows in the safe cohort there is no rate to match: rate, threshold and recall at parity are null."""
    share = scores.filter(F.col(cohort) == safe).agg(F.avg((F.col("score") >= threshold).cast("double"))).first()[0]
    group = scores.filter(F.col(cohort) == hot)
    after = None if share is None else exact_quantile(group, F.col("score"), 1 - share)
    hit = lambda t: F.count_if((F.col("score") >= t) & (F.col("y") == 1)) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))
    return group.agg(
        F.lit(share).cast("double").alias("safe_rate"), hit(threshold).alias("recall_global"),
        F.lit(after).cast("double").alias("parity_threshold"),
        (F.lit(None).cast("double") if after is None else hit(after)).alias("recall_parity"),
    )


def friction_change(before: DataFrame, after: DataFrame, selected: str = "selected") -> DataFrame:
    """Challenge rate of new users before and after, absolute and relative reduction."""
    rate = lambda d: d.agg(F.coalesce(F.avg(F.col(selected).cast("double")), F.lit(0.0)).alias("r")).scalar()
    base = before.agg(F.count(F.lit(1)).alias("n_before"))
    out = base.withColumns({"rate_before": rate(before), "rate_after": rate(after)})
    out = out.withColumn("absolute_reduction", F.col("rate_before") - F.col("rate_after"))
    return out.withColumn("relative_reduction_pct", F.coalesce(F.try_divide(100 * F.col("absolute_reduction"), "rate_before"), F.lit(0.0)))
