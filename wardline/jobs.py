"""End-to-end jobs: raw files to feature tables, score tables and evaluation reports.

Each stage hands over a parquet table, so a stage can be rerun alone and later stages never repeat it.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline import schemas as C
from wardline.functions import expr as X
from wardline.models import iforest as IF, keystroke as KS, scale as SC, supervised as SV
from wardline.operators import bootstrap as BS, encode as E, fairness as FA, history as H, joins as J, metrics as M, privacy as P, splits as S, userday as U
from wardline.sources import readers as R, tables as TB

# fixed values: feature sets of the payment detectors
BEHAVIOUR = ["type", "amount", "log_amount", "hour", "orig_txn_idx", "dest_in_deg", "dest_is_merchant"]
BALANCE = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "err_orig", "err_dest", "orig_emptied",
           "dest_zero_before", "amt_ratio", "frac_orig_moved", "amount_eq_oldorig"]
LOGIN = ["hour", "rtt", "f_country", "f_asn", "f_browser", "f_os", "device_type"]
ZSUM = ["n_off_logon", "n_other_pc", "n_off_usb", "n_off_file", "n_usb", "n_file"]
USERDAY = ["n_logon", "n_off_logon", "n_pcs", "n_other_pc", "n_usb", "n_off_usb", "n_file", "n_off_file"]


def _stored(df: DataFrame, path: str) -> DataFrame:
    TB.save_table(df, path)
    return TB.load_table(df.sparkSession, path)


def long_scores(df: DataFrame, arms: list[str], keep: list[str]) -> DataFrame:
    """Score table in long form: one row per (row, variant)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("variant"), F.col(f"score_{a}").alias("score")) for a in arms])
    return df.withColumn("_v", F.explode(pairs)).select(*keep, "_v.variant", "_v.score")


def evaluate(scores: DataFrame, out: str, neg_rate: float = 1.0, amount: str | None = None, probability: bool = True,
             reps: int = 1000, flag: str | None = None) -> dict[str, DataFrame]:
    """The whole protocol for a long score table (variant, y, score, ...): one curve, then metrics from it."""
    by = ["variant"]
    curve = _stored(M.roc_curve(scores, by, neg_rate, amount), f"{out}/curve")
    parts = {
        "threshold_free": M.threshold_free(curve, by),
        "operating_points": M.operating_points(curve, by),
        "cost": M.cost_amount(curve, by) if amount else M.cost_ratio(curve, by),
    }
    if probability:
        parts["calibration"] = M.calibration(scores, by, neg_rate)
    if flag:
        parts["baseline_lift"] = M.baseline_lift(scores, curve, by, flag)
    if reps:
        parts["bootstrap"] = BS.bootstrap_ci(scores, reps, neg_rate=neg_rate)
    parts = {k: _stored(v, f"{out}/{k}") for k, v in parts.items()}
    ci = None
    if reps:
        ci = parts["bootstrap"].filter("metric = 'pr_auc'").select("variant", F.col("ci_low").alias("pr_auc_low"), F.col("ci_high").alias("pr_auc_high"))
    board = M.rank_by(M.leaderboard(parts["threshold_free"], parts["operating_points"], by, ci), "pr_auc", by)
    TB.write_leaderboard(board, f"{out}/leaderboard")
    TB.write_report(parts["operating_points"], f"{out}/report", by)
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    counts = scores.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.lit(float(neg_rate)).alias("neg_rate"), F.round(neg / neg_rate).cast("long").alias("n_neg_full"),
                                     (pos / (pos + neg / neg_rate)).alias("base_rate_full"), F.lit(bool(probability)).alias("is_probability"))
    TB.write_document({"counts": counts, **parts}, f"{out}/document", by, single=("counts", "threshold_free"))
    return parts | {"leaderboard": board}


def payments_job(spark: SparkSession, path: str, out: str, cut: int = 600, neg_cap: int = 2_000_000, seed: int = 42, reps: int = 1000, **params):
    """Mobile-money fraud: causal features, cut by step, full and behaviour-only detectors, amount-based cost."""
    raw = R.read_payments(spark, path)
    df = X.with_row_id(raw).withColumns({"ts": F.timestamp_seconds(F.col("step").cast("long") * 3600)})
    df = H.causal_index(df, "nameOrig", "ts", "row_id", "orig_txn_idx")
    df = H.causal_index(df, "nameDest", "ts", "row_id", "dest_in_deg")
    df = X.balance_features(df).withColumns({
        "hour": X.hour_from_step(F.col("step")), "log_amount": X.log_amount(F.col("amount")), "dest_is_merchant": X.is_merchant(F.col("nameDest")),
        "y": F.col("isFraud").cast("int"), "rule_flag": F.col("isFlaggedFraud").cast("int"),
    })
    feats = _stored(df.select("row_id", "step", "y", "rule_flag", *BEHAVIOUR, *BALANCE), f"{out}/features")
    train, test = S.split_at(feats, "step", cut)
    train = _stored(S.cap_negatives(train, "y", neg_cap, seed, "row_id"), f"{out}/train")
    params = {"maxDepth": 6, "maxIter": 100} | params
    scored = SV.score(SV.fit(train, BEHAVIOUR + BALANCE, "y", "gbt", seed, balance=True, **params), test, BEHAVIOUR + BALANCE, "score_full")
    scored = SV.score(SV.fit(train, BEHAVIOUR, "y", "gbt", seed, balance=True, **params), scored, BEHAVIOUR, "score_behavioral")
    scores = _stored(long_scores(scored, ["full", "behavioral"], ["row_id", "y", "rule_flag", "amount"]), f"{out}/scores")
    return evaluate(scores, f"{out}/evaluation", amount="amount", reps=reps, flag="rule_flag")


def cards_job(spark: SparkSession, txn_path: str, identity_path: str, out: str, seed: int = 42, reps: int = 1000, space: dict[str, list] | None = None, trials: int = 20,
              **params):
    """Card fraud: transactions with and without device identity, time-quantile split, identity-only subset. With a search ``space`` the
    device detector is tuned on the last fifth of the training time, calibrated there and evaluated again, and its stability is measured."""
    idn = E.top_k_bucket(R.read_card_identity(spark, identity_path), "DeviceInfo", 100, "DeviceInfo_top")
    idn = idn.withColumns({"id30_fam": X.family(F.col("id_30"), lower=True), "id31_fam": X.family(F.col("id_31"), lower=True)})
    idn = idn.drop("DeviceInfo", "id_30", "id_31")
    df = J.left_join_flag(R.read_card_txns(spark, txn_path), idn, "TransactionID", "has_identity")
    feats = _stored(df.withColumnsRenamed({"isFraud": "y", "TransactionID": "row_id"}), f"{out}/features")
    train, test, _ = S.split_quantile(feats, "TransactionDT", 0.8)
    base = C.CARD_NUM + C.CARD_CAT
    device = base + C.IDENTITY_NUM + ["DeviceType", "DeviceInfo_top", "id30_fam", "id31_fam", "id_15", "id_28", "id_29", "has_identity"]
    scored = SV.gbt_fit_score(train, test, {"txn_only": base, "with_device": device}, "y", seed, **params)
    scored = scored.withColumn("amount", F.col("TransactionAmt"))
    scores = _stored(long_scores(scored, ["txn_only", "with_device"], ["row_id", "y", "has_identity", "amount"]), f"{out}/scores")
    subset = scores.filter("has_identity = 1 and variant = 'with_device'").withColumn("variant", F.lit("with_device_identity_subset"))
    tables = evaluate(scores.unionByName(subset), f"{out}/evaluation", amount="amount", reps=reps)
    if space is None:
        return tables
    inner, val, _ = S.split_quantile(train, "TransactionDT", 0.8)
    tables |= {f"selection_{k}": v for k, v in selection_job(inner, val, test, device, "y", space, f"{out}/selection", trials, seed, reps, **params).items()}
    return tables | stability_job(train, test, device, "y", C.IDENTITY_NUM, f"{out}/stability", (seed, seed + 1, seed + 2), **params)


def logins_job(spark: SparkSession, path: str, out: str, neg_cap: int | None = None, neg_rate: float = 1.0, seed: int = 42, reps: int = 500,
               balance: bool = True, **params):
    """Account takeover among successful logins: label-anchored time split, train-only frequency codes, IP-feed ablation."""
    df = S.login_population(R.read_logins(spark, path), "clamped" if neg_rate < 1 else "success")
    df = X.with_row_id(df).withColumns({
        "y": F.col("takeover").cast("int"), "ip": F.col("attack_ip").cast("int"), "hour": F.hour("ts"),
        "rtt": X.log_rtt(F.col("rtt_ms")), "device_type": F.coalesce("device_type", F.lit("unknown")),
        "browser": X.family(F.col("browser_full")), "os": X.family(F.col("os_full")),
    })
    base = _stored(df.select("row_id", "ts", "y", "ip", "hour", "rtt", "country", "asn", "browser", "os", "device_type"), f"{out}/logins")
    fit_on, _, cut = S.split_label_quantile(base, "ts", "y", 0.6)
    coded = base
    for c in ("country", "asn", "browser", "os"):
        coded = E.frequency_encoding(fit_on, coded, c, "y")
    feats = _stored(coded, f"{out}/features")
    train, test = feats.filter(X.micros("ts") <= cut), feats.filter(X.micros("ts") > cut)
    train = _stored(S.cap_negatives(train, "y", neg_cap, seed, "row_id") if neg_cap else train, f"{out}/train")
    scored = SV.score(SV.fit(train, LOGIN, "y", "gbt", seed, balance=balance, **params), test, LOGIN, "score_noip")
    scored = SV.score(SV.fit(train, LOGIN + ["ip"], "y", "gbt", seed, balance=balance, **params), scored, LOGIN + ["ip"], "score_ip")
    scored = scored.withColumns({"score_ip_flag": F.col("ip").cast("double"), "rule_flag": F.col("ip")})
    scores = _stored(long_scores(scored, ["noip", "ip", "ip_flag"], ["row_id", "y", "rule_flag"]), f"{out}/scores")
    return evaluate(scores, f"{out}/evaluation", neg_rate, reps=reps, flag="rule_flag")


def keystroke_job(spark: SparkSession, path: str, out: str, enrol: int = 200, impostor: int = 5, reps: int = 1000) -> dict[str, DataFrame]:
    """Per-user typing detector: scores, per-user equal error rates, their summary and bootstrap interval."""
    df, feats = R.read_keystrokes(spark, path)
    order = F.col("sessionIndex") * 100_000 + F.col("rep")
    df = df.select("subject", F.struct(order.alias("o"), "subject").alias("rep_id"), F.array(*feats).alias("vec"))
    scores = KS.scaled_manhattan(df, "subject", "rep_id", "vec", len(feats), enrol, impostor)
    scores = _stored(scores.select("user", "y", "score"), f"{out}/scores")
    eer = _stored(M.per_user_eer(M.roc_curve(scores, ["user"], drop_collinear=True), "user"), f"{out}/per_user_eer")
    return {"per_user_eer": eer, "summary": M.eer_summary(eer), "interval": BS.bootstrap_users(eer, "user", reps=reps)}


def insider_job(spark: SparkSession, logon: str, device: str, file: str, windows: str, out: str, release: str = "4.2", trees: int = 400,
                seed: int = 42, reps: int = 1000) -> dict[str, DataFrame]:
    """Insider threat: user-day activity, robust deviations, forest and deviation-sum scores, alert-budget sweep."""
    logons = R.read_activity(spark, logon, "logon").filter("activity = 'Logon'")
    tables = [
        U.userday_logons(logons),
        U.userday_transfers(R.read_activity(spark, device, "device"), "Connect", "usb"),
        U.userday_transfers(R.read_activity(spark, file, "file"), None, "file"),
    ]
    ud = J.full_outer_userday(tables, ["user", "day"])
    wins = R.read_windows(spark, windows, release)
    ud = U.robust_deviation(J.interval_label(ud, wins), "user", USERDAY).withColumn("row_id", F.xxhash64("user", "day"))
    feats = _stored(ud, f"{out}/features")
    dev = [f"dev_{c}" for c in USERDAY]
    scored = IF.iforest_score(feats, IF.iforest_fit(feats, dev, "row_id", trees, seed=seed), dev, out="score_iforest")
    scored = U.deviation_sum(scored, [f"dev_{c}" for c in ZSUM], "score_zsum")
    wide = _stored(scored.select("row_id", "user", "day", "y", "score_iforest", "score_zsum"), f"{out}/scores")
    sweep = FA.budget_sweep(wide, [5, 10, 25, 50], "score_iforest")
    by_scenario = FA.budget_by_scenario(wide, wins, [5, 10, 25, 50], "score_iforest")
    parts = evaluate(long_scores(wide, ["iforest", "zsum"], ["row_id", "y"]), f"{out}/evaluation", probability=False, reps=reps)
    return parts | {"budget_sweep": sweep, "budget_by_scenario": by_scenario}


def compare_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """One leaderboard over the results of several jobs (a table of one row per detector)."""
    rows = [df.drop("rank").withColumn("dataset", F.lit(name)) for name, df in reports.items()]
    return M.rank_by(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), "pr_auc", ["dataset", "variant"])


# ---- jobs on genuine logins -----------------------------------------------------
def login_events(logins: DataFrame) -> DataFrame:
    """Login rows as identity events (coarse device fingerprint, country as location, no amount)."""
    no = F.lit(False)
    return X.with_row_id(logins, "event_id").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("identity_id"), F.lit("login").alias("event_type"),
        F.lit("internet_banking").alias("channel"), X.device_key(F.col("device_type"), F.col("browser_full"), F.col("os_full")).alias("device_id"),
        F.col("country").alias("geo"), F.hour("ts").alias("hour_of_day"), F.lit(None).cast("double").alias("amount"),
        no.alias("is_new_beneficiary"), no.alias("recovery_contact_changed"),
    )


def replay_job(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Replay features of genuine logins, stored for the serving model and the private export."""
    genuine = S.login_population(R.read_logins(spark, path), "genuine")
    return _stored(H.replay_features(login_events(genuine)), f"{out}/replay")


def serving_job(replay: DataFrame, out: str, trees: int = 200, contamination: float = 0.02, seed: int = 42) -> DataFrame:
    """Scaled isolation forest over replay features: stored nodes, scores and the mapped risk."""
    cols = [f"{c}_z" for c in C.FEATURES]
    z = SC.standard_scale(replay, C.FEATURES).select("event_id", *cols)
    nodes = _stored(IF.iforest_fit(z, cols, "event_id", trees, seed=seed), f"{out}/nodes")
    scored = _stored(IF.iforest_score(z, nodes, cols).select("event_id", "score"), f"{out}/scores")
    return IF.serving_risk(scored, contamination=contamination)


def privacy_job(replay: DataFrame, out: str, secret: bytes, noise_multiplier: float = 4.0, release: str = "first", dataset: str = "logins") -> dict[str, DataFrame]:
    """Noised cohort means and the privacy ledger of all releases so far. A release name is booked first and works once; its noise is its own."""
    ledger = P.open_release(replay.sparkSession, f"{out}/ledger", dataset, release, noise_multiplier)
    means = _stored(P.identity_means(replay, F.col("geo")), f"{out}/identity_means-{release}")
    noised = _stored(P.dp_cohort_means(means, noise_multiplier, secret, release=release), f"{out}/cohort_means-{release}")
    return {"cohort_means": noised, "ledger": P.privacy_ledger(ledger)}


def travel_job(spark: SparkSession, path: str) -> DataFrame:
    """How many takeovers with an earlier login show impossible travel, and how many genuine logins do."""
    ok = S.login_population(R.read_logins(spark, path), "success").withColumn("takeover", F.col("takeover").cast("int"))
    ok = X.with_row_id(ok)
    return H.travel_lift(H.impossible_travel(ok, "user_id", "ts", "row_id"))


def fairness_job(decisions: DataFrame, cohort: str, min_size: int = 200) -> tuple[DataFrame, DataFrame]:
    """Challenge rate per cohort and the disparate-impact verdict of a decision table."""
    chosen = decisions.withColumn("selected", (F.col("decision") != "ALLOW").cast("int"))
    rates = FA.selection_rates(chosen, cohort, min_size=min_size)
    return rates, FA.disparate_impact(rates)


def parity_job(scores: DataFrame, cohort: str, safe, hot, threshold: float, out: str) -> DataFrame:
    """What it costs the challenged cohort's recall to be challenged as rarely as the safe one."""
    return _stored(FA.parity_cost(scores, cohort, safe, hot, threshold), f"{out}/parity_cost")


def cold_start_job(before: DataFrame, after: DataFrame, out: str) -> DataFrame:
    """Challenge rate of identities' first events (decision tables) without and with the cold-start prior."""
    def first(d: DataFrame) -> DataFrame:
        e = J.first_event(d, "identity_id", "ts", "event_id")
        return e.withColumn("selected", (F.col("decision") != "ALLOW").cast("int"))

    return _stored(FA.friction_change(first(before), first(after)), f"{out}/cold_start")


# ---- model selection ------------------------------------------------------------
def selection_job(train: DataFrame, val: DataFrame, test: DataFrame, cols: list[str], y: str, space: dict[str, list], out: str, trials: int = 20,
                  seed: int = 42, reps: int = 1000, **incumbent) -> dict[str, DataFrame]:
    """Search on the validation rows, then the incumbent against the best trial on the test rows: intervals of the difference and a verdict.

    The map from score to probability is chosen on the validation rows alone; the test rows are scored once, and the calibrated winner gets
    the whole evaluation beside the incumbent.
    """
    table = _stored(SV.search(train, val, cols, y, space, trials, seed), f"{out}/trials")
    best = dict(ast.literal_eval(table.orderBy("rank", "trial").first()["params"]))
    tuned = SV.fit(train, cols, y, "gbt", seed, **best)
    seen = _stored(SV.score(tuned, val, cols, "new").select(F.col(y).alias("y"), "new"), f"{out}/validation_scores")
    chosen, to_probability, briers = SV.calibrate(seen, "y", "new")
    both = SV.score(SV.fit(train, cols, y, "gbt", seed, **incumbent), test, cols, "old")
    both = SV.score(tuned, both, cols, "new").select(F.col(y).alias("y"), "old", "new")
    both = _stored(to_probability(both), f"{out}/scores")
    long = both.select("y", F.col("old").alias("score_old"), F.col("calibrated").alias("score_tuned"))
    again = evaluate(long_scores(long, ["old", "tuned"], ["y"]), f"{out}/evaluation", reps=reps)
    interval = _stored(BS.paired_bootstrap(both, "old", "new", reps, seed), f"{out}/intervals")
    verdict = SV.keep_or_replace(interval.filter("metric = 'pr_auc'").withColumn("detector", F.lit("gbt")), "ci")
    briers = _stored(briers.withColumn("chosen", F.col("method") == chosen), f"{out}/calibration")
    return {"trials": table, "calibration": briers, "intervals": interval, "verdict": _stored(verdict, f"{out}/verdict"), "evaluation": again["leaderboard"]}


def stability_job(train: DataFrame, test: DataFrame, cols: list[str], y: str, suspects: list[str], out: str, seeds: tuple[int, ...] = (1, 2, 3, 4, 5),
                  **params) -> dict[str, DataFrame]:
    """Spread of the metrics over seeds, and the leakage audit."""
    return {"seeds": _stored(SV.seed_sweep(train, test, cols, y, list(seeds), **params), f"{out}/seeds"),
            "leakage": _stored(SV.leakage_audit(train, test, cols, y, suspects, **params), f"{out}/leakage")}


def headline_job(metrics: DataFrame, expected: DataFrame, catches: DataFrame, out: str) -> DataFrame:
    """Stored metrics (metric, value) against expected ones (metric, expected, tolerance), and per case (metric, old, new: sessions until caught)
    whether the new detector catches earlier. One row per check."""
    gate = M.drift_gate(metrics, expected).select("metric", "passed")
    earlier = catches.select("metric", M.earlier_catch(F.col("old"), F.col("new")).alias("passed"))
    return _stored(gate.unionByName(earlier), f"{out}/headline")
