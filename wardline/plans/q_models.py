"""Detector, model-selection and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.models import iforest as IF, keystroke as KS, scale as SC, supervised as SV
from wardline.models.isotonic import isotonic_blocks, isotonic_map
from wardline.operators import bootstrap as BS, history as H, metrics as M
from wardline.plans import fixtures as V
from wardline.plans.q_features import MEASURES, deviations
from wardline.plans.q_metrics import curve_sql, user_eer
from wardline.plans.registry import query
from wardline.session import materialize

_R = lambda c, n=6: F.round(F.col(c), n).alias(c)
DIMS, ENROL, IMPOSTOR = 64, 20, 5


def keystrokes(spark, sf):
    return V.table(spark, sf, "embeddings").select(F.col("label").alias("subject"), "vec_id", "embedding")


_MAN_SQL = f"""r as (select vec_id, label, embedding, row_number() over (partition by label order by vec_id) as n from embeddings),
u as (select vec_id, label, n, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from r),
mu as (select label, i, avg(x) as m from u where n <= {ENROL} group by all),
md as (select label, i, any_value(m) as m, case when avg(abs(x - m)) = 0 then 0.000001 else avg(abs(x - m)) end as d from u join mu using (label, i) where n <= {ENROL} group by all),
sc as (select t.label as "user", u.vec_id, 0 as y, sum(abs(x - m) / d) as score from u join md t on t.label = u.label and t.i = u.i where n > {ENROL} group by all
  union all select t.label, u.vec_id, 1, sum(abs(x - m) / d) from u join md t on t.label <> u.label and t.i = u.i where n <= {IMPOSTOR} group by all)"""


@query("keystroke_scaled_manhattan", "J5,C5,E5", f'with {_MAN_SQL} select "user", vec_id, y, round(score, 4) as score from sc')
def keystroke_scaled_manhattan(spark, sf):
    return KS.scaled_manhattan(keystrokes(spark, sf), "subject", "vec_id", "embedding", DIMS, ENROL, IMPOSTOR).select("user", "vec_id", "y", _R("score", 4))


_KEYSTROKE_EER_SQL = f"""with {_MAN_SQL}, src as (select "user", y, round(score, 9) as score, 0.0 as amount from sc), {curve_sql(source="src", by='"user"')},
  seq as (select *, row_number() over w as i, lead(pos) over w as np1, lead(neg) over w as nn1 from curve window w as (partition by "user" order by threshold desc)),
  kept as (select * from seq where i = 1 or np1 is null or np1 <> pos or nn1 <> neg),
  pick as (select * from kept qualify row_number() over (partition by "user" order by abs(fpr - (1 - tpr)), threshold desc) = 1),
  auc as (select "user", sum(neg * (tp - pos + tp) / 2.0 / (np * nn)) as roc_auc from curve group by 1),
  eer as (select case when abs(fpr - (1 - tpr)) >= 1 then 0.5 else (fpr + 1 - tpr) / 2 end as eer, roc_auc from pick join auc using ("user"))
  select count(*) as users, round(avg(eer), 6) as mean_eer, round(median(eer), 6) as median_eer, round(stddev_samp(eer), 6) as std_eer, round(avg(roc_auc), 6) as mean_roc_auc from eer"""


@query("keystroke_eer", "J5,K14", _KEYSTROKE_EER_SQL)
def keystroke_eer(spark, sf):
    s = KS.scaled_manhattan(keystrokes(spark, sf), "subject", "vec_id", "embedding", DIMS, ENROL, IMPOSTOR)
    s = materialize(s.withColumn("score", F.round("score", 9)))
    out = M.eer_summary(M.per_user_eer(M.roc_curve(s, ["user"], drop_collinear=True), "user"))
    return out.select("users", *[_R(c) for c in ("mean_eer", "median_eer", "std_eer", "mean_roc_auc")])


@query("keystroke_mahalanobis", "J6")
def keystroke_mahalanobis(spark, sf):
    s = KS.mahalanobis(keystrokes(spark, sf), "subject", "vec_id", "embedding", DIMS, ENROL, IMPOSTOR)
    return s.select("user", "vec_id", "y", _R("score", 4))


@query(
    "template_similarity", "J7",
    """with t as (select label, arg_min(embedding, vec_id) as tpl from embeddings group by 1),
    p as (select vec_id, list_zip(tpl, embedding) as z, tpl from embeddings join t using (label))
    select vec_id, round(greatest(0.0, 1 - list_sum(list_transform(z, lambda q: abs(q[1]::double - q[2]::double))) / list_sum(list_transform(tpl, lambda x: abs(x::double)))), 4) as similarity from p""",
)
def template_similarity(spark, sf):
    e = V.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    t = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("tpl"))
    return e.join(t, "label").select("vec_id", F.round(X.template_similarity(F.col("tpl"), F.col("embedding")), 4).alias("similarity"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "standard_scale", "J4",
    "with s as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _NUM) + " from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"round(({c} - m_{c}) / case when s_{c} = 0 then 1.0 else s_{c} end, 5) as {c}_z" for c in _NUM) + " from lineitem, s",
)
def standard_scale(spark, sf):
    z = SC.standard_scale(V.table(spark, sf, "lineitem"), _NUM)
    return z.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[_R(f"{c}_z", 5) for c in _NUM])


@query("iforest_scores", "J2")
def iforest_scores(spark, sf):
    ud = materialize(deviations(spark, sf).withColumn("row_id", F.xxhash64("user", "day")))
    cols = [f"dev_{c}" for c in MEASURES]
    nodes = IF.iforest_fit(ud, cols, "row_id", trees=400)
    return IF.iforest_score(ud, nodes, cols).select("user", "day", _R("score"))


@query("serving_risk", "J2,J3,J4")
def serving_risk(spark, sf):
    """Replay features, scaled, scored by a 200-tree forest and mapped to a risk in [0, 1]."""
    cols = [f"{c}_z" for c in C.FEATURES]
    f = materialize(H.replay_features(V.identity_events(spark, sf)).select("event_id", *C.FEATURES))
    z = SC.standard_scale(f, C.FEATURES).select("event_id", *cols)
    scored = IF.iforest_score(z, IF.iforest_fit(z, cols, "event_id", trees=200), cols)
    scored = materialize(scored.select("event_id", "score"))
    return IF.serving_risk(scored).select("event_id", _R("score"), _R("ml_risk"))


#: Boosting rounds of the registered queries; the jobs take 100, the detectors' default.
ROUNDS = 20
_COLS = ["amount", "oldbalanceOrg", "newbalanceOrig", "hour", "dest_kind"]


def labelled_payments(spark, sf):
    p = V.payments(spark, sf).withColumns({
        "hour": X.hour_from_step(F.col("step")), "dest_kind": F.substring("nameDest", 1, 1),
        "y": ((F.col("isFraud") == 1) | (F.col("amount") > 450000)).cast("int"), "user": F.col("nameOrig"),
    })
    return p.select("row_id", "user", "y", "step", *_COLS)


def _split(spark, sf):
    return SV.hash_split(labelled_payments(spark, sf), "row_id", 0.7)


@query("gbt_scores", "J1")
def gbt_scores(spark, sf):
    train, test = _split(spark, sf)
    out = SV.gbt_fit_score(train, test, {"full": _COLS, "amount_only": ["amount"]}, "y", maxIter=ROUNDS)
    return out.select("row_id", "y", _R("score_full"), _R("score_amount_only"))


@query("bake_off", "J11,F4")
def bake_off(spark, sf):
    train, val = _split(spark, sf)
    families = {"gbt": {"params": {"maxIter": ROUNDS}}, "forest": {}, "logistic": {"balance": True}}
    return SV.bake_off(train, val, _COLS, "y", families)


@query("hyper_search", "J12")
def hyper_search(spark, sf):
    train, val = _split(spark, sf)
    return SV.search(train, val, _COLS, "y", {"maxDepth": [3, 4, 5], "maxIter": [10, 20, ROUNDS], "stepSize": [0.05, 0.1, 0.2]}, 8)


@query("seed_sweep", "J10,D14")
def seed_sweep(spark, sf):
    train, test = _split(spark, sf)
    return SV.seed_sweep(train, test, _COLS, "y", [1, 2, 3, 4, 5], maxIter=ROUNDS)


@query("permutation_importance", "J8,F6")
def permutation_importance(spark, sf):
    train, test = _split(spark, sf)
    m = SV.fit(train, _COLS, "y", maxIter=ROUNDS)
    return SV.permutation_importance(m, test, _COLS, "y", "row_id")


@query("leakage_audit", "J9")
def leakage_audit(spark, sf):
    train, test = _split(spark, sf)
    return SV.leakage_audit(train, test, _COLS, "y", ["oldbalanceOrg", "newbalanceOrig"], maxIter=ROUNDS)


@query("calibrate", "J13")
def calibrate(spark, sf):
    return SV.calibrate(V.scores(spark, sf))[2]


@query(
    "isotonic_fit", "J13",
    f"""with {V.SQL_SCORES}, t as (select score, sum(y) as s, count(*) as w from scores group by 1),
    c as (select row_number() over (order by score) as i, score, sum(s) over (order by score) as cs, sum(w) over (order by score) as cw, s, w from t),
    p as (select a.i as j, b.i as i, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as mean from c a join c b on b.i >= a.i),
    m as (select j, i, min(mean) over (partition by j order by i desc) as low from p), f as (select i, max(low) as value from m group by 1)
    select score, round(value, 9) as value from f join c using (i)""",
)
def isotonic_fit(spark, sf):
    """The pooled fit at every distinct score, pooled in many ranges; in SQL the largest of the smallest means of all stretches."""
    s = V.scores(spark, sf)
    blocks = isotonic_blocks(s, ranges=16, fan_in=4)
    at = isotonic_map(blocks)(s.select("score").distinct())
    return at.select("score", F.round("calibrated", 9).alias("value"))


@query("grouped_oof", "J14")
def grouped_oof(spark, sf):
    return SV.grouped_oof(labelled_payments(spark, sf), _COLS, "y", "user", k=5, maxIter=ROUNDS).select("row_id", "y", "fold", _R("score"))


@query(
    "keep_or_replace", "J16",
    f"""with {V.SQL_VARIANTS}, m as (select user_id % 40 as detector, avg(score) filter (variant = 'main') as old_value, avg(score) filter (variant = 'alt') as new_value from variants group by 1)
    select detector, case when new_value > coalesce(old_value, 0.0) + 0.01 then 'replace' else 'keep_incumbent' end as verdict from m""",
)
def keep_or_replace(spark, sf):
    v = V.score_variants(spark, sf)
    m = v.groupBy((F.col("user_id") % 40).alias("detector")).agg(
        F.avg(F.when(F.col("variant") == "main", F.col("score"))).alias("old_value"), F.avg(F.when(F.col("variant") == "alt", F.col("score"))).alias("new_value")
    )
    return SV.keep_or_replace(m, "margin").select("detector", "verdict")


# ---- bootstrap ------------------------------------------------------------------
@query("bootstrap_ci", "K12")
def bootstrap_ci(spark, sf):
    return BS.bootstrap_ci(V.score_variants(spark, sf), reps=1000)


@query("paired_bootstrap", "K13")
def paired_bootstrap(spark, sf):
    s = V.scores(spark, sf).withColumn("alt", ((F.col("row_id") * 104729) % 800 + 150 * F.col("y")) / 1000.0)
    return BS.paired_bootstrap(s, "score", "alt", reps=1000)


@query("bootstrap_users", "K15")
def bootstrap_users(spark, sf):
    return BS.bootstrap_users(user_eer(spark, sf), "user_id", reps=1000)
