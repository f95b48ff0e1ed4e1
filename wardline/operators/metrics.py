"""One evaluation protocol for any score table (columns: variant keys, y, score, optional amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline import schemas as C
from wardline.operators import ordered as O

# ---- fixed values: the ten equal calibration bins of [0, 1] ----------------------
BIN_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def sample_weights(df: DataFrame, neg_rate: float = 1.0, y: str = "y", out: str = "weight") -> DataFrame:
    """Negatives kept at rate ``neg_rate`` stand for 1 / neg_rate rows each."""
    return df.withColumn(out, F.when(F.col(y) == 0, F.lit(1.0 / neg_rate)).otherwise(F.lit(1.0)))


def missing_last(score: Column) -> Column:
    """A null or NaN score ranks below every other score."""
    c = score.cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(float("-inf"))).otherwise(c)


def roc_curve(scores: DataFrame, by: list[str], neg_rate: float = 1.0, amount: str | None = None, y: str = "y",
              score: str = "score", drop_collinear: bool = False, hot_rows: int = O.HOT_ROWS) -> DataFrame:
    """One row per distinct score: cumulative tp / fp / caught from the highest score down, with the totals.

    Rows are first combined to score ties inside each task. The running sums are then one window per variant,
    or sliced by score with carries when a variant has more than ``hot_rows`` distinct scores. Each row also
    holds its own step (pos, neg), so area metrics need no further ordering. The (0, 0) start is implied.
    Null and NaN scores are one tie at minus infinity, the last vertex, whichever way the sums are made.
    """
    scores = scores.withColumn(score, missing_last(F.col(score)))
    caught = {"amt": F.sum(F.when(F.col(y) == 1, F.col(amount)).otherwise(F.lit(0.0)))} if amount else {}
    ties = scores.groupBy(*by, score).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"),
        *[c.alias(n) for n, c in caught.items()],
    )
    position = -F.col(score)
    s = O.probe(ties, by, position, hot_rows)
    aggs = {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}
    if amount:
        aggs["caught"] = ("sum", F.col("amt"))
    curve = O.running(ties, by, [F.desc(score)], aggs, s, position)
    totals = {"P": "pos", "N": "neg"} | ({"at_risk": "amt"} if amount else {})
    totals = {("n_pos" if k == "P" else "n_neg" if k == "N" else k): v for k, v in totals.items()}
    if s.split:
        sums = ties.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in totals.items()])
        curve = curve.join(sums, by)
    else:
        whole = Window.partitionBy(*by)
        curve = curve.withColumns({k: F.sum(v).over(whole) for k, v in totals.items()})
    if drop_collinear:
        curve = _corners(curve, by, score, s, position)
    return curve.withColumns({
        "tpr": F.try_divide("tp", "n_pos"), "fpr": F.try_divide("fp", "n_neg"),
        "fp_full": F.col("fp") / neg_rate, "n_full": F.col("n_neg") / neg_rate,
        "precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp") / neg_rate), F.lit(1.0)),
    }).withColumnRenamed(score, "threshold")


def _corners(curve: DataFrame, by: list[str], score: str, s: O.Slicing, position: Column) -> DataFrame:
    """Keep the first and last vertex and those where the step changes; steps then span the dropped ones."""
    if s.split:
        curve = O.ordinal(curve, by, [F.desc(score)], s, position, "_n")
    df, part = O.blocks(curve, by, s, "_n", back=1, ahead=1)
    w = Window.partitionBy(*part).orderBy(F.desc(score))
    step = lambda c: F.lead(c).over(w)
    df = df.withColumns({"_np": step("pos"), "_nn": step("neg"), "_first": F.lag("pos").over(w).isNull()})
    keep = F.col("_first") | F.col("_np").isNull() | (F.col("_np") != F.col("pos")) | (F.col("_nn") != F.col("neg"))
    kept = O.done(df.withColumn("_keep", keep)).filter("_keep").drop("_np", "_nn", "_first", "_keep")
    if s.split:
        kept = O.ordinal(kept.drop("_n"), by, [F.desc(score)], s, position, "_n")
    df, part = O.blocks(kept, by, s, "_n", back=1)
    w = Window.partitionBy(*part).orderBy(F.desc(score))
    for cum, own in (("tp", "pos"), ("fp", "neg")):
        df = df.withColumn(own, F.col(cum) - F.coalesce(F.lag(cum).over(w), F.lit(0)))
    return O.done(df).drop("_n")


def _previous():
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    scale = F.try_divide("fp_full", "fp")
    prec0 = F.coalesce(F.try_divide(tp0, tp0 + F.when(fp0 == 0, F.lit(0.0)).otherwise(fp0 * scale)), F.lit(1.0))
    return tp0, fp0, prec0


def average_precision() -> Column:
    return F.sum(F.col("pos") / F.col("n_pos") * F.col("precision"))


def roc_auc() -> Column:
    tp0, _, _ = _previous()
    return F.sum(F.col("neg") * (tp0 + F.col("tp")) / 2.0 / (F.col("n_pos") * F.col("n_neg")))


def pr_trapezoid() -> Column:
    _, _, prec0 = _previous()
    return F.sum(F.col("pos") / F.col("n_pos") * (F.col("precision") + prec0) / 2.0)


def partial_auc(max_fpr: float = 0.01) -> Column:
    """Standardised partial area up to ``max_fpr``, interpolated at the limit."""
    tp0, fp0, _ = _previous()
    x0, x1, y0, y1 = fp0 / F.col("n_neg"), F.col("fpr"), tp0 / F.col("n_pos"), F.col("tpr")
    f = F.lit(max_fpr)
    at = y0 + (f - x0) * F.coalesce(F.try_divide(y1 - y0, x1 - x0), F.lit(0.0))
    area = F.when(x0 >= f, 0.0).when(x1 <= f, (x1 - x0) * (y0 + y1) / 2.0).otherwise((f - x0) * (y0 + at) / 2.0)
    low = 0.5 * max_fpr**2
    return (1 + (F.sum(area) - low) / (max_fpr - low)) / 2.0


def ks_statistic() -> Column:
    return F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0))


def threshold_free(curve: DataFrame, by: list[str]) -> DataFrame:
    """All ranking metrics of every variant in one aggregate."""
    return curve.groupBy(*by).agg(
        F.max("n_pos").alias("n_positive"), F.max("n_neg").alias("n_negative"),
        average_precision().alias("pr_auc"), pr_trapezoid().alias("pr_auc_trapezoid"), roc_auc().alias("roc_auc"),
        partial_auc().alias("pauc_1pct"), ks_statistic().alias("ks"),
    ).withColumn("gini", 2 * F.col("roc_auc") - 1)


def operating_points(curve: DataFrame, by: list[str], targets: list[float] = C.FPR_TARGETS) -> DataFrame:
    """The last vertex with fpr <= target per target, and the confusion of the full population.

    Every target is one conditional maximum, so the curve is read once and never multiplied.
    """
    point = F.struct("fp", "tp", "fpr", "tpr", "precision", "threshold", "fp_full")
    best = curve.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_full").alias("n_full"),
        *[F.max(F.when(F.col("fpr") <= t, point)).alias(f"_t{i}") for i, t in enumerate(targets)],
    )
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias("p")) for i, t in enumerate(targets)])
    out = best.withColumn("_r", F.explode(rows)).select(*by, "n_pos", "n_full", "_r.target", "_r.p.*")
    recall, prec = F.coalesce("tpr", F.lit(0.0)), F.coalesce("precision", F.lit(1.0))
    fpr, fp = F.coalesce("fpr", F.lit(0.0)), F.coalesce("fp_full", F.lit(0.0))
    tp = F.coalesce("tp", F.lit(0))
    base = F.col("n_pos") / (F.col("n_pos") + F.col("n_full"))
    f_beta = lambda b: F.coalesce(F.try_divide((1 + b) * prec * recall, b * prec + recall), F.lit(0.0))
    return out.select(
        *by, "target", fpr.alias("step_up_rate"), recall.alias("recall"), prec.alias("precision"),
        f_beta(1.0).alias("f1"), f_beta(4.0).alias("f2"), (1 - fpr).alias("specificity"),
        F.try_divide(prec, base).alias("lift"), F.col("threshold"),
        tp.alias("tp"), (F.col("n_pos") - tp).alias("fn"),
        F.round(fp).cast("long").alias("fp"), F.round(F.col("n_full") - fp).cast("long").alias("tn"),
    )


def calibration(scores: DataFrame, by: list[str], neg_rate: float = 1.0, y: str = "y", score: str = "score") -> DataFrame:
    """Reliability per bin: weighted confidence, frequency, weight share and the bin's parts of Brier and ECE."""
    s = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    b = F.lit(0)
    for e in BIN_EDGES:
        b = b + (F.col("_s") >= e).cast("int")
    df = sample_weights(scores, neg_rate, y, "_w").withColumn("_s", s).withColumn("bin", b)
    bins = df.groupBy(*by, "bin").agg(
        F.sum("_w").alias("weight"), (F.sum(F.col("_w") * F.col("_s")) / F.sum("_w")).alias("confidence"),
        (F.sum(F.col("_w") * F.col(y)) / F.sum("_w")).alias("empirical"),
        F.sum(F.col("_w") * (F.col("_s") - F.col(y)) * (F.col("_s") - F.col(y))).alias("_sq"),
    )
    total = F.sum("weight").over(Window.partitionBy(*by))  # at most ten rows per variant
    return bins.withColumn("weight_frac", F.col("weight") / total).withColumn(
        "ece_part", F.col("weight_frac") * F.abs(F.col("empirical") - F.col("confidence"))
    ).withColumn("brier_part", F.col("_sq") / total).drop("_sq")


def calibration_summary(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg(F.sum("brier_part").alias("brier"), F.sum("ece_part").alias("ece"))


def _cheapest(curve: DataFrame, by: list[str], total: Column, extra: list[str], empty: Column | None = None) -> DataFrame:
    pick = F.min(F.struct(total.alias("total"), (-F.col("threshold")).alias("order"), *extra)).alias("_m")
    out = curve.groupBy(*by).agg(pick, F.max("n_pos").alias("_np"), F.max("n_full").alias("_nf"))
    return out.select(*by, "_np", "_nf", F.col("_m.total").alias("min_cost"), (-F.col("_m.order")).alias("threshold"),
                      *[F.col(f"_m.{c}").alias(c) for c in extra])


def cost_amount(curve: DataFrame, by: list[str], cost_fp: float = C.COST_FP, allow_none: bool = False) -> DataFrame:
    """Threshold with the least missed amount + cost of false positives (curve built with ``amount``).

    ``allow_none`` also considers flagging nobody, reported with a null threshold.
    """
    total = F.col("at_risk") - F.col("caught") + cost_fp * F.col("fp_full")
    out = _cheapest(curve, by, total, ["tp", "fp_full", "caught", "at_risk"])
    if allow_none:
        none = F.col("at_risk") < F.col("min_cost")
        out = out.withColumns({
            "threshold": F.when(~none, F.col("threshold")), "min_cost": F.least("at_risk", "min_cost"),
            "tp": F.when(none, 0).otherwise(F.col("tp")), "fp_full": F.when(none, 0.0).otherwise(F.col("fp_full")),
            "caught": F.when(none, 0.0).otherwise(F.col("caught")),
        })
    return out.select(
        *by, F.col("at_risk").alias("amount_at_risk"), "threshold", "min_cost",
        (F.col("tp") / F.greatest(F.col("_np"), F.lit(1))).alias("recall"),
        F.try_divide("fp_full", "_nf").alias("step_up_rate"), F.col("caught").alias("amount_recovered"),
    )


def cost_ratio(curve: DataFrame, by: list[str], ratios: tuple[int, ...] = (10, 100, 1000), cost_fp: float = C.COST_FP) -> DataFrame:
    """Cost-minimising threshold when a miss costs ``ratio`` times a false positive, for each ratio."""
    best = curve.groupBy(*by).agg(
        F.max("n_pos").alias("_np"), F.max("n_full").alias("_nf"),
        *[
            F.min(F.struct(
                (r * cost_fp * (F.col("n_pos") - F.col("tp")) + cost_fp * F.col("fp_full")).alias("total"),
                (-F.col("threshold")).alias("order"), "tp", "fp_full",
            )).alias(f"_r{r}")
            for r in ratios
        ],
    )
    rows = F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(f"_r{r}").alias("p")) for r in ratios])
    out = best.withColumn("_x", F.explode(rows)).select(*by, "_np", "_nf", "_x.ratio", "_x.p.*")
    return out.select(
        *by, "ratio", (-F.col("order")).alias("threshold"), F.col("total").alias("min_cost"),
        (F.col("tp") / F.greatest(F.col("_np"), F.lit(1))).alias("recall"), F.try_divide("fp_full", "_nf").alias("step_up_rate"),
    )


def per_user_eer(curve: DataFrame, user: str) -> DataFrame:
    """Equal error rate per user: the first vertex (start included) with the least |fpr - fnr|."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    pick = F.min(F.struct(gap.alias("gap"), (-F.col("threshold")).alias("order"), "fpr", "tpr"))
    out = curve.groupBy(user).agg(pick.alias("_m"), roc_auc().alias("roc_auc"))
    at_start = F.col("_m.gap") >= 1.0  # the (0, 0) vertex has gap 1 and comes first
    eer = F.when(at_start, F.lit(0.5)).otherwise((F.col("_m.fpr") + 1 - F.col("_m.tpr")) / 2.0)
    return out.select(user, eer.alias("eer"), "roc_auc")


def eer_summary(eer: DataFrame) -> DataFrame:
    return eer.agg(
        F.count(F.lit(1)).alias("users"), F.avg("eer").alias("mean_eer"), F.median("eer").alias("median_eer"),
        F.stddev_samp("eer").alias("std_eer"), F.avg("roc_auc").alias("mean_roc_auc"),
    )


def rule_rates(df: DataFrame, by: list[str], y: str = "y", flag: str = "rule_flag") -> DataFrame:
    """Class counts, base rate and the rule's hit rate in each class."""
    pos, neg = F.col(y) == 1, F.col(y) == 0
    return df.groupBy(*by).agg(
        F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.avg(F.col(y).cast("double")).alias("base_rate"),
        F.avg(F.when(pos, F.col(flag))).alias("rule_recall"), F.avg(F.when(neg, F.col(flag))).alias("rule_fpr"),
    )


def baseline_lift(scores: DataFrame, curve: DataFrame, by: list[str], flag: str = "rule_flag", y: str = "y") -> DataFrame:
    """Rule recall beside the model's recall at the rule's false-positive rate and at 2 %."""
    rates = rule_rates(scores, by, y, flag).select(*by, "rule_recall", "rule_fpr")
    at = curve.join(rates, by)  # one row per variant on the right
    return at.groupBy(*by).agg(
        F.max("rule_recall").alias("rule_recall"), F.max("rule_fpr").alias("rule_fpr"),
        F.coalesce(F.max(F.when(F.col("fpr") <= F.greatest("rule_fpr", F.lit(1e-9)), F.col("tpr"))), F.lit(0.0)).alias("model_recall_at_rule_budget"),
        F.coalesce(F.max(F.when(F.col("fpr") <= 0.02, F.col("tpr"))), F.lit(0.0)).alias("model_recall_at_2pct"),
    )


def rate_by_match(df: DataFrame, y: str, flag: str) -> DataFrame:
    """Positive rate with and without a partner row, and their ratio."""
    return df.agg(
        F.avg(F.when(F.col(flag) == 1, F.col(y))).alias("rate_with"), F.avg(F.when(F.col(flag) == 0, F.col(y))).alias("rate_without")
    ).withColumn("ratio", F.try_divide("rate_with", "rate_without"))


def stepup_curves(curve: DataFrame, by: list[str]) -> DataFrame:
    """Detection against challenge rate (percent) for plotting several variants."""
    return curve.select(*by, "threshold", (F.col("fpr") * 100).alias("step_up_pct"), (F.col("tpr") * 100).alias("detected_pct"))


def leaderboard(free: DataFrame, points: DataFrame, by: list[str], ci: DataFrame | None = None) -> DataFrame:
    """One row per variant: ranking metrics, the 2 % operating point and, if given, the AP interval."""
    at2 = points.filter(F.col("target") == 0.02).select(*by, F.col("recall").alias("recall_at_2pct"), F.col("f2").alias("f2_at_2pct"))
    out = free.join(at2, by)
    return out.join(ci, by, "left") if ci is not None else out


def rank_by(df: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    """Rank a small result table (one row per variant) by a metric, best first."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), *ties)))


def arg_best(df: DataFrame, by: list[str], value: str, metric: str, smallest: bool = False) -> DataFrame:
    pick = F.min_by if smallest else F.max_by
    return df.groupBy(*by).agg(pick(value, metric).alias(value))


def mean_abs_attribution(df: DataFrame, feature: str, phi: str) -> DataFrame:
    return df.groupBy(F.col(feature).alias("feature")).agg(F.avg(F.abs(F.col(phi))).alias("mean_abs"))


def importance_rank(df: DataFrame, metric: str) -> DataFrame:
    """Rank of each feature (a table of one row per feature)."""
    return rank_by(df, metric, ["feature"])


def label_correlation(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """Correlation of every feature with the label in one aggregate, and the strongest one."""
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])
    out = agg.select(F.explode(rows).alias("x")).select("x.feature", "x.r")
    return out.withColumn("strongest", F.max_by("feature", F.abs(F.col("r"))).over(Window.partitionBy(F.lit(0))))


def seed_summary(metrics: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def drift_gate(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected headline value against the stored metric; missing metrics fail."""
    out = expected.join(metrics, "metric", "left")
    ok = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)).cast("int"))


def earlier_catch(old: Column, new: Column) -> Column:
    """The new detector must catch, and before the old one if that caught at all."""
    return F.coalesce(new.isNotNull() & (old.isNull() | (new < old)), F.lit(False)).cast("int")
