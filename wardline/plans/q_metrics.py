"""Evaluation protocol queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.operators import fairness as FA, metrics as M
from wardline.plans import fixtures as V
from wardline.plans.registry import query

BY = ["variant"]


def _rounded(df, n=6, keep=()):
    return df.select(*[F.round(c, n).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes])


def curve_sql(rate: float = 1.0, source: str = "variants", by: str = "variant") -> str:
    return f"""ties as (select {by}, score as threshold, sum(y) as pos, sum(1 - y) as neg, sum(amount * y) as amt from {source} group by all),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(amt) over w as caught,
    sum(pos) over (partition by {by}) as np, sum(neg) over (partition by {by}) as nn, sum(amt) over (partition by {by}) as risk
  from ties window w as (partition by {by} order by threshold desc)),
curve as (select {by}, threshold, pos, neg, tp, fp, caught, risk, np, nn, tp / np as tpr, fp / nn as fpr, fp / {rate} as fpf, nn / {rate} as nf,
    tp / (tp + fp / {rate}) as prec, case when tp - pos + fp - neg = 0 then 1.0 else (tp - pos) / (tp - pos + (fp - neg) / {rate}) end as prec0,
    (tp - pos) / np as y0, (fp - neg) / nn as x0 from cum)"""


def curve(spark, sf, **kw):
    return M.roc_curve(V.score_variants(spark, sf), BY, amount="amount", **kw)


@query(
    "roc_curve", "K1,E15",
    f"with {V.SQL_VARIANTS}, {curve_sql()} select variant, threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, "
    "round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(caught, 2) as caught from curve",
)
def roc_curve(spark, sf):
    c = curve(spark, sf).select("variant", "threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"),
                                F.round("caught", 2).alias("caught"))
    return c


_FREE_SQL = """select variant, cast(max(np) as bigint) as n_positive, cast(max(nn) as bigint) as n_negative,
  round(sum(pos / np * prec), 6) as pr_auc, round(sum(pos / np * (prec + prec0) / 2), 6) as pr_auc_trapezoid,
  round(sum(neg * (tp - pos + tp) / 2.0 / (np * nn)), 6) as roc_auc,
  round((1 + (sum(case when x0 >= 0.01 then 0.0 when fpr <= 0.01 then (fpr - x0) * (y0 + tpr) / 2
     else (0.01 - x0) * (y0 + y0 + (0.01 - x0) * (tpr - y0) / (fpr - x0)) / 2 end) - 0.00005) / (0.01 - 0.00005)) / 2, 6) as pauc_1pct,
  round(greatest(max(tpr - fpr), 0.0), 6) as ks, round(2 * sum(neg * (tp - pos + tp) / 2.0 / (np * nn)) - 1, 6) as gini from curve group by 1"""


@query("threshold_free", "K3-K7", f"with {V.SQL_VARIANTS}, {curve_sql()} {_FREE_SQL}")
def threshold_free(spark, sf):
    return _rounded(M.threshold_free(curve(spark, sf), BY))


@query("weighted_pr", "K2,K3,K5", f"with {V.SQL_VARIANTS}, {curve_sql(0.02)} {_FREE_SQL}")
def weighted_pr(spark, sf):
    """Negatives kept at 2 %: precision-based metrics are corrected, rank metrics are not affected."""
    return _rounded(M.threshold_free(curve(spark, sf, neg_rate=0.02), BY))


_CORNER_SQL = """, seq as (select *, row_number() over w as i, lead(pos) over w as np1, lead(neg) over w as nn1 from curve window w as (partition by variant order by threshold desc)),
kept as (select * from seq where i = 1 or np1 is null or np1 <> pos or nn1 <> neg)"""


@query(
    "roc_curve_corners", "K1",
    f"with {V.SQL_VARIANTS}, {curve_sql()}{_CORNER_SQL} select variant, threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, "
    "cast(tp - coalesce(lag(tp) over w, 0) as bigint) as pos, cast(fp - coalesce(lag(fp) over w, 0) as bigint) as neg "
    "from kept window w as (partition by variant order by threshold desc)",
)
def roc_curve_corners(spark, sf):
    return curve(spark, sf, drop_collinear=True).select("variant", "threshold", "tp", "fp", "pos", "neg")


_TARGETS_SQL = ", t as (select unnest([" + ", ".join(f"{x}e0" for x in C.FPR_TARGETS) + "]) as target)"


@query(
    "operating_points", "K8",
    f"""with {V.SQL_VARIANTS}, {curve_sql(0.02)}{_TARGETS_SQL},
    k as (select variant, max(np) as np, max(nf) as nf from curve group by 1),
    p as (select variant, target, max_by(struct_pack(tp := tp, fpr := fpr, r := tpr, prec := prec, thr := threshold, fpf := fpf), fp * 1000000000 + tp) as m
      from curve join t on fpr <= target group by all),
    q as (select k.variant, t.target, np, nf, coalesce(m.fpr, 0.0) as fpr, coalesce(m.r, 0.0) as r, coalesce(m.prec, 1.0) as pr, m.thr as thr,
      coalesce(m.tp, 0) as tp, coalesce(m.fpf, 0.0) as fpf from k cross join t left join p on p.variant = k.variant and p.target = t.target)
    select variant, target, round(fpr, 6) as step_up_rate, round(r, 6) as recall, round(pr, 6) as precision,
      round(case when pr + r > 0 then 2 * pr * r / (pr + r) else 0.0 end, 6) as f1, round(case when 4 * pr + r > 0 then 5 * pr * r / (4 * pr + r) else 0.0 end, 6) as f2,
      round(1 - fpr, 6) as specificity, round(pr / (np / (np + nf)), 6) as lift, thr as threshold, cast(tp as bigint) as tp, cast(np - tp as bigint) as fn,
      cast(round(fpf) as bigint) as fp, cast(round(nf - fpf) as bigint) as tn from q""",
)
def operating_points(spark, sf):
    return _rounded(M.operating_points(curve(spark, sf, neg_rate=0.02), BY), keep=("threshold", "target"))


_BIN_SQL = " + ".join(f"cast(least(greatest(score, 0.0), 1.0) >= cast('{e!r}' as double) as int)" for e in M.BIN_EDGES)
_CAL_SQL = V.SQL_VARIANTS + f""", c as (select variant, y, least(greatest(score, 0.0), 1.0) as s, case when y = 0 then 50.0 else 1.0 end as w, {_BIN_SQL} as bin from variants),
bins as (select variant, bin, sum(w) as weight, sum(w * s) / sum(w) as confidence, sum(w * y) / sum(w) as empirical, sum(w * (s - y) * (s - y)) as sq from c group by all),
parts as (select *, weight / sum(weight) over v as weight_frac, weight / sum(weight) over v * abs(empirical - confidence) as ece_part, sq / sum(weight) over v as brier_part
  from bins window v as (partition by variant))"""


@query("calibration", "K9", f"with {_CAL_SQL} select variant, bin, weight, round(confidence, 6) as confidence, round(empirical, 6) as empirical, "
       "round(weight_frac, 6) as weight_frac, round(ece_part, 6) as ece_part, round(brier_part, 6) as brier_part from parts")
def calibration(spark, sf):
    return _rounded(M.calibration(V.score_variants(spark, sf), BY, neg_rate=0.02))


@query("calibration_summary", "K9", f"with {_CAL_SQL} select variant, round(sum(brier_part), 6) as brier, round(sum(ece_part), 6) as ece from parts group by 1")
def calibration_summary(spark, sf):
    return _rounded(M.calibration_summary(M.calibration(V.score_variants(spark, sf), BY, neg_rate=0.02), BY))


@query(
    "cost_amount", "K10,F5",
    f"""with {V.SQL_VARIANTS}, {curve_sql()}, c as (select *, risk - caught + 150000.0 * fpf as total from curve),
    m as (select * from c qualify row_number() over (partition by variant order by total, threshold desc) = 1)
    select variant, round(risk, 2) as amount_at_risk, threshold, round(total, 2) as min_cost, round(tp / greatest(np, 1), 2) as recall,
      round(fpf / nf, 2) as step_up_rate, round(caught, 2) as amount_recovered from m""",
)
def cost_amount(spark, sf):
    return _rounded(M.cost_amount(curve(spark, sf), BY, cost_fp=150000.0), 2, keep=("threshold",))


@query(
    "cost_ratio", "K11,F5",
    f"""with {V.SQL_VARIANTS}, {curve_sql()}, r as (select unnest([2, 10, 100]) as ratio),
    c as (select *, ratio * 17.0 * (np - tp) + 17.0 * fpf as total from curve cross join r),
    m as (select * from c qualify row_number() over (partition by variant, ratio order by total, threshold desc) = 1)
    select variant, ratio, threshold, round(total, 6) as min_cost, round(tp / greatest(np, 1), 6) as recall, round(fpf / nf, 6) as step_up_rate from m""",
)
def cost_ratio(spark, sf):
    return _rounded(M.cost_ratio(curve(spark, sf), BY, (2, 10, 100)), keep=("threshold",))


_EER_SQL = V.SQL_SCORES + ", " + curve_sql(source="scores", by="user_id") + """,
ok as (select * from curve where np > 0 and nn > 0),
pick as (select * from ok qualify row_number() over (partition by user_id order by abs(fpr - (1 - tpr)), threshold desc) = 1),
auc as (select user_id, sum(neg * (tp - pos + tp) / 2.0 / (np * nn)) as roc_auc from ok group by 1),
eer as (select user_id, case when abs(fpr - (1 - tpr)) >= 1 then 0.5 else (fpr + 1 - tpr) / 2 end as eer, roc_auc from pick join auc using (user_id))"""


def user_eer(spark, sf):
    c = M.roc_curve(V.scores(spark, sf), ["user_id"]).filter("n_pos > 0 and n_neg > 0")
    return M.per_user_eer(c, "user_id")


@query("per_user_eer", "K14", f"with {_EER_SQL} select user_id, round(eer, 6) as eer, round(roc_auc, 6) as roc_auc from eer")
def per_user_eer(spark, sf):
    return _rounded(user_eer(spark, sf))


@query(
    "eer_summary", "K14",
    f"with {_EER_SQL} select count(*) as users, round(avg(eer), 6) as mean_eer, round(median(eer), 6) as median_eer, "
    "round(stddev_samp(eer), 6) as std_eer, round(avg(roc_auc), 6) as mean_roc_auc from eer",
)
def eer_summary(spark, sf):
    return _rounded(M.eer_summary(user_eer(spark, sf)))


@query(
    "rule_rates", "D8",
    f"""with {V.SQL_VARIANTS} select variant, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg, round(avg(y), 6) as base_rate,
      round(avg(rule_flag) filter (y = 1), 6) as rule_recall, round(avg(rule_flag) filter (y = 0), 6) as rule_fpr from variants group by 1""",
)
def rule_rates(spark, sf):
    return _rounded(M.rule_rates(V.score_variants(spark, sf), BY))


@query(
    "baseline_lift", "K16",
    f"""with {V.SQL_VARIANTS}, {curve_sql()}, r as (select variant, avg(rule_flag) filter (y = 1) as rr, avg(rule_flag) filter (y = 0) as rf from variants group by 1)
    select variant, round(max(rr), 6) as rule_recall, round(max(rf), 6) as rule_fpr,
      round(coalesce(max(tpr) filter (fpr <= greatest(rf, 0.000000001)), 0.0), 6) as model_recall_at_rule_budget,
      round(coalesce(max(tpr) filter (fpr <= 0.02), 0.0), 6) as model_recall_at_2pct from curve join r using (variant) group by 1""",
)
def baseline_lift(spark, sf):
    s = V.score_variants(spark, sf)
    return _rounded(M.baseline_lift(s, curve(spark, sf), BY))


@query(
    "subset_eval", "K17",
    f"with {V.SQL_VARIANTS}, sub as (select * from variants where rule_flag = 1), {curve_sql(source='sub')} {_FREE_SQL}",
)
def subset_eval(spark, sf):
    s = V.score_variants(spark, sf).filter("rule_flag = 1")
    return _rounded(M.threshold_free(M.roc_curve(s, BY), BY))


@query(
    "stepup_curves", "K18",
    f"with {V.SQL_VARIANTS}, {curve_sql()} select variant, threshold, round(fpr * 100, 6) as step_up_pct, round(tpr * 100, 6) as detected_pct from curve",
)
def stepup_curves(spark, sf):
    return _rounded(M.stepup_curves(curve(spark, sf), BY), keep=("threshold",))


@query(
    "leaderboard", "K19,F4",
    f"""with {V.SQL_VARIANTS}, {curve_sql()}, f as ({_FREE_SQL}),
    p as (select variant, max(fp * 1000000000 + tp) as key from curve where fpr <= 0.02 group by 1),
    a as (select c.variant, tpr, prec from curve c join p on c.variant = p.variant and fp * 1000000000 + tp = key)
    select f.variant, pr_auc, roc_auc, pauc_1pct, ks, gini, round(tpr, 6) as recall_at_2pct,
      round(case when 4 * prec + tpr > 0 then 5 * prec * tpr / (4 * prec + tpr) else 0.0 end, 6) as f2_at_2pct,
      row_number() over (order by pr_auc desc, f.variant) as rank from f join a using (variant)""",
)
def leaderboard(spark, sf):
    c = curve(spark, sf)
    b = M.leaderboard(M.threshold_free(c, BY), M.operating_points(c, BY), BY)
    b = M.rank_by(b, "pr_auc", BY)
    return _rounded(b.select("variant", "pr_auc", "roc_auc", "pauc_1pct", "ks", "gini", "recall_at_2pct", "f2_at_2pct", "rank"))


_EXPECTED = [("main", "roc_auc", 0.8, 0.05), ("alt", "roc_auc", 0.6, 0.2), ("main", "ks", 0.42, 0.01), ("none", "roc_auc", 0.5, 1.0)]


@query(
    "drift_gate", "K20",
    f"""with {V.SQL_VARIANTS}, {curve_sql()}, f as ({_FREE_SQL}),
    m as (select variant||'.roc_auc' as metric, roc_auc as value from f union all select variant||'.ks', ks from f),
    x(metric, expected, tolerance) as (values {", ".join(f"('{v}.{k}', {e}, {t})" for v, k, e, t in _EXPECTED)})
    select metric, expected, value, coalesce(cast(abs(value - expected) <= tolerance as int), 0) as passed from x left join m using (metric)""",
)
def drift_gate(spark, sf):
    f = _rounded(M.threshold_free(curve(spark, sf), BY))
    pairs = F.array(*[F.struct(F.concat_ws(".", "variant", F.lit(k)).alias("metric"), F.col(k).alias("value")) for k in ("roc_auc", "ks")])
    metrics = f.select(F.explode(pairs).alias("x")).select("x.*")
    expected = spark.createDataFrame([(f"{v}.{k}", e, t) for v, k, e, t in _EXPECTED], "metric string, expected double, tolerance double")
    return M.drift_gate(metrics, expected).select("metric", "expected", "value", "passed")


@query(
    "seed_summary", "D14",
    f"""with {V.SQL_VARIANTS}, s as (select variant, row_id % 5 as seed, avg(score) as value from variants group by all)
    select variant, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max from s group by 1""",
)
def seed_summary(spark, sf):
    m = V.score_variants(spark, sf).groupBy("variant", (F.col("row_id") % 5).alias("seed")).agg(F.avg("score").alias("value"))
    return _rounded(M.seed_summary(m, BY))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "feature_label_corr", "D15",
    "with c as (" + " union all ".join(f"select '{c}' as feature, corr({c}, cast(l_returnflag = 'R' as double)) as r from lineitem" for c in _CORR)
    + ") select feature, round(r, 6) as r, (select feature from c order by abs(r) desc limit 1) as strongest from c",
)
def feature_label_corr(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return _rounded(M.label_correlation(li, _CORR, "y"))


@query(
    "arg_best", "F5",
    "select o_custkey, arg_max(o_orderkey, o_totalprice) as largest, arg_min(o_orderkey, o_totalprice) as smallest from orders group by 1",
)
def arg_best(spark, sf):
    o = V.table(spark, sf, "orders")
    a = M.arg_best(o, ["o_custkey"], "o_orderkey", "o_totalprice").withColumnRenamed("o_orderkey", "largest")
    b = M.arg_best(o, ["o_custkey"], "o_orderkey", "o_totalprice", smallest=True).withColumnRenamed("o_orderkey", "smallest")
    return a.join(b, "o_custkey")


# ---- fairness -------------------------------------------------------------------
_COHORT_SQL = V.SQL_SCORES + """, d as (select s.*, n.n_name as cohort, r.r_name as region, cast(score >= 0.6 as int) as selected from scores s
  join customer on c_custkey = user_id join nation n on n_nationkey = c_nationkey join region r on r_regionkey = n_regionkey)"""


def cohorts(spark, sf):
    s = V.scores(spark, sf).withColumn("selected", (F.col("score") >= 0.6).cast("int"))
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    n = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select("n_nationkey", F.col("n_name").alias("cohort"), F.col("r_name").alias("region"))
    return s.join(c, "user_id").join(n, "n_nationkey")


@query("selection_rate", "D12", f"with {_COHORT_SQL} select cohort, round(avg(selected), 6) as rate, count(*) as n from d group by 1 having count(*) >= 200")
def selection_rate(spark, sf):
    return _rounded(FA.selection_rates(cohorts(spark, sf), "cohort"))


@query(
    "disparate_impact", "D12,K21",
    f"""with {_COHORT_SQL}, r as (select region, avg(selected) as rate from d group by 1 having count(*) >= 200)
    select count(*) as cohorts, round(coalesce(min(rate) / nullif(max(rate), 0), 1.0), 6) as impact_ratio, cast(coalesce(min(rate) / nullif(max(rate), 0), 1.0) >= 0.8 as int) as passes from r""",
)
def disparate_impact(spark, sf):
    return _rounded(FA.disparate_impact(FA.selection_rates(cohorts(spark, sf), "region")))


@query(
    "parity_cost", "K21,D17",
    f"""with {_COHORT_SQL}, s as (select avg(cast(score >= 0.6 as int)) as rate from d where region = 'ASIA'),
    l as (select list(score order by score) as x, (1 - max(rate)) * (count(*) - 1) as pos from d, s where region = 'EUROPE'),
    q as (select x[cast(floor(pos) as int) + 1] + (x[cast(ceil(pos) as int) + 1] - x[cast(floor(pos) as int) + 1]) * (pos - floor(pos)) as thr from l)
    select round(max(rate), 6) as safe_rate, round(count(*) filter (score >= 0.6 and y = 1) / greatest(count(*) filter (y = 1), 1), 6) as recall_global,
      round(max(thr), 6) as parity_threshold, round(count(*) filter (score >= thr and y = 1) / greatest(count(*) filter (y = 1), 1), 6) as recall_parity
    from d, s, q where region = 'EUROPE'""",
)
def parity_cost(spark, sf):
    return _rounded(FA.parity_cost(cohorts(spark, sf), "region", "ASIA", "EUROPE", 0.6))


@query("score_quantiles", "D17", f"with {V.SQL_SCORES} select round(quantile_cont(score, 0.9), 6) as q90, round(quantile_cont(amount, 0.333), 6) as q333 from scores")
def score_quantiles(spark, sf):
    s = V.scores(spark, sf)
    return s.limit(1).select(F.round(F.lit(FA.score_quantile(s, "score", 0.9)), 6).alias("q90"), F.round(F.lit(FA.score_quantile(s, "amount", 0.333)), 6).alias("q333"))
