"""Supervised detectors on MLlib: fitting, scoring, comparison, search, calibration and audits."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from wardline.functions import expr as X
from wardline.models import boost as B
from wardline.models.isotonic import isotonic_blocks, isotonic_map
from wardline.operators import metrics as M
from wardline.session import checkpoint_dir, materialize

MAX_CATEGORIES = 256
#: What ``boost`` knows of MLlib's parameters.
BOOST_PARAMS = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "minInfoGain"}


def split_types(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    text = [c for c in cols if df.schema[c].dataType.simpleString() == "string"]
    return [c for c in cols if c not in text], text


def with_null_flags(df: DataFrame, num: list[str]) -> DataFrame:
    """Missing numbers become an indicator column, because MLlib trees take no nulls."""
    return df.withColumns({c: F.col(c).cast("double") for c in num} | {f"{c}_null": F.col(c).isNull().cast("double") for c in num})


def balanced(df: DataFrame, y: str) -> DataFrame:
    """Weights that give both classes the same total."""
    stats = df.agg(F.avg(F.col(y).cast("double")).alias("rate")).scalar()
    share = F.when(F.col(y) == 1, stats).otherwise(1 - stats)
    return df.withColumn("_weight", F.coalesce(F.try_divide(F.lit(0.5), share), F.lit(1.0)))


def encoders(num: list[str], text: list[str]) -> list:
    """Stages that treat every column by itself, so that fits on some of the columns can share them."""
    stages = [Imputer(inputCols=num, outputCols=[f"{c}_imp" for c in num], strategy="median")] if num else []
    return stages + ([StringIndexer(inputCols=text, outputCols=[f"{c}_idx" for c in text], handleInvalid="keep")] if text else [])


def assembly(num: list[str], text: list[str], linear: bool = False) -> list:
    stages = []
    inputs = [f"{c}_imp" for c in num] + [f"{c}_null" for c in num]
    if text:
        if linear:
            stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in text], outputCols=[f"{c}_hot" for c in text], handleInvalid="keep"))
        inputs += [f"{c}_hot" if linear else f"{c}_idx" for c in text]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw" if linear else "_features", handleInvalid="keep"))
    if linear:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=False))
    return stages


def estimator(family: str, y: str, seed: int, **params):
    common = dict(labelCol=y, featuresCol="_features", weightCol="_weight")
    if family == "gbt":
        return GBTClassifier(seed=seed, maxBins=MAX_CATEGORIES, **common, **({"maxDepth": 5, "maxIter": 100} | params))
    if family == "forest":
        return RandomForestClassifier(seed=seed, maxBins=MAX_CATEGORIES, **common, **({"maxDepth": 8, "numTrees": 50} | params))
    if family == "logistic":
        return LogisticRegression(**common, **({"maxIter": 100} | params))
    raise ValueError(f"unknown family {family!r}")


def fit(train: DataFrame, cols: list[str], y: str, family: str = "gbt", seed: int = 42, balance: bool = False, **params):
    """Fitted pipeline. Leaf budgets of 31 / 63 correspond to maxDepth 5 / 6."""
    checkpoint_dir(train.sparkSession)
    num, text = split_types(train, cols)
    df = with_null_flags(train, num)
    df = balanced(df, y) if balance else df.withColumn("_weight", F.lit(1.0))
    return Pipeline(stages=[*encoders(num, text), *assembly(num, text, family == "logistic"), estimator(family, y, seed, **params)]).fit(df)


def score(model, df: DataFrame, cols: list[str], out: str = "score") -> DataFrame:
    num, _ = split_types(df, cols)
    keep = df.columns
    flagged = with_null_flags(df, num).withColumn("_weight", F.lit(1.0))
    p = vector_to_array(F.col("probability"))[1].alias(out)
    return model.transform(flagged).select(*keep, p)


def encoded(train: DataFrame, test: DataFrame, cols: list[str], y: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns encoded as ``fit`` does it, written once for several fits."""
    num, text = split_types(train, cols)
    flagged = with_null_flags(train, num)
    model = Pipeline(stages=encoders(num, text)).fit(flagged)
    made = [f"{c}{end}" for c in num for end in ("_imp", "_null")] + [f"{c}_idx" for c in text]
    done = [materialize(model.transform(df).select(y, *made)) for df in (flagged, with_null_flags(test, num))]
    return done[0], done[1]


def fit_rank(train: DataFrame, test: DataFrame, types: tuple[list[str], list[str]], y: str, family: str = "gbt", seed: int = 42, balance: bool = False, **params) -> DataFrame:
    """Ranking metrics on ``test`` of a model of ``train``, both encoded; ``types`` are the numbers and texts it reads."""
    checkpoint_dir(train.sparkSession)
    df = balanced(train, y) if balance else train.withColumn("_weight", F.lit(1.0))
    model = Pipeline(stages=[*assembly(*types, family == "logistic"), estimator(family, y, seed, **params)]).fit(df)
    p = vector_to_array(F.col("probability"))[1].alias("score")
    return ranking(model.transform(test.withColumn("_weight", F.lit(1.0))).select(y, p), y)


def boost_rank(train: DataFrame, test: DataFrame, arms: list[tuple[tuple[list[str], list[str]], int]], y: str, **params) -> DataFrame:
    """Ranking metrics on ``test`` by ``arm``, the place in ``arms`` (numbers and texts read, seed), of boosted models of ``train``, both encoded.

    ``boost`` grows all models at once. What it does not know (other parameters, labels or tables MLlib refuses) goes to MLlib, one fit each.
    """
    fits = [B.Fit([f"{c}_imp" for c in num] + [f"{c}_null" for c in num] + [f"{c}_idx" for c in text], seed) for (num, text), seed in arms]
    n, valid = train.agg(F.count(F.lit(1)), F.count_if(F.col(y).cast("double").isin(0.0, 1.0))).first()
    p = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "minInstancesPerNode": 1, "minInfoGain": 0.0} | params
    known = not params.keys() - BOOST_PARAMS and 0 < p["maxDepth"] <= B.MAX_DEPTH and 0 < n == valid
    if not known or not all(f.cols and all(B.arity(train, c) <= min(n, MAX_CATEGORIES) for c in f.cols) for f in fits):
        each = lambda x: fit_rank(train, test, x[1][0], y, "gbt", x[1][1], **params).withColumn("arm", F.lit(x[0]))
        return reduce(DataFrame.unionByName, side_by_side(each, enumerate(arms)))
    checkpoint_dir(train.sparkSession)
    side_by_side(lambda f: B.find_cuts(train, f, n), fits)
    B.train_all(train, y, fits, n, p["maxIter"], p["maxDepth"], p["stepSize"], p["subsamplingRate"], p["minInstancesPerNode"], p["minInfoGain"])
    scored = materialize(B.score_all(test, y, fits, p["stepSize"]))
    pairs = F.array(*[F.struct(F.lit(i).alias("arm"), F.col(f"s{i}").alias("score")) for i in range(len(fits))])
    s = scored.select(F.col(y).alias("y"), F.explode(pairs).alias("_p")).select("_p.arm", "y", "_p.score")
    return M.threshold_free(M.roc_curve(s, ["arm"]), ["arm"])


def gbt_fit_score(train: DataFrame, test: DataFrame, arms: dict[str, list[str]], y: str, seed: int = 42, **params) -> DataFrame:
    """Test rows with one score column per arm (an arm is a named feature set, for ablations)."""
    out = test
    for name, cols in arms.items():
        out = score(fit(train, cols, y, "gbt", seed, **params), out, cols, f"score_{name}")
    return out


def ranking(scored: DataFrame, y: str, column: str = "score") -> DataFrame:
    """Ranking metrics of one score column. The scores are written first: the curve reads them several times."""
    s = materialize(scored.select(F.lit("m").alias("variant"), F.col(y).cast("int").alias("y"), F.col(column).alias("score")))
    return M.threshold_free(M.roc_curve(s, ["variant"]), ["variant"])


def _metrics(spark, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def side_by_side(one: Callable, items, parallelism: int = 4) -> list:
    """Results of ``one`` for all items, in order; a few fits share the cluster at a time."""
    with ThreadPool(parallelism) as pool:
        return pool.map(one, list(items))


# ---- comparison -----------------------------------------------------------------
def bake_off(train: DataFrame, val: DataFrame, cols: list[str], y: str, families: dict[str, dict], seed: int = 42) -> DataFrame:
    """Validation metrics per family (incumbent against alternatives), best AP first."""
    types = split_types(train, cols)
    train, val = encoded(materialize(train), val, cols, y)

    def one(item):
        name, p = item
        return fit_rank(train, val, types, y, p.get("family", name), seed, p.get("balance", False), **p.get("params", {})).withColumn("family", F.lit(name))

    parts = side_by_side(one, families.items())
    return M.rank_by(reduce(DataFrame.unionByName, parts), "pr_auc", ["family"]).select("family", "pr_auc", "roc_auc", "ks", "rank")


def search(train: DataFrame, val: DataFrame, cols: list[str], y: str, space: dict[str, list], n: int, seed: int = 42, family: str = "gbt") -> DataFrame:
    """Trial table of a seeded random search with validation AP as the objective."""
    rng = random.Random(seed)
    types = split_types(train, cols)
    train, val = encoded(materialize(train), val, cols, y)
    trials = [(trial, {k: rng.choice(v) for k, v in sorted(space.items())}) for trial in range(n)]

    def one(item):
        r = fit_rank(train, val, types, y, family, seed, **item[1]).first()
        return item[0], str(sorted(item[1].items())), float(r["pr_auc"]), float(r["roc_auc"])

    rows = side_by_side(one, trials)
    df = _metrics(train.sparkSession, rows, "trial int, params string, pr_auc double, roc_auc double")
    return M.rank_by(df, "pr_auc", ["trial"])


def seed_sweep(train: DataFrame, test: DataFrame, cols: list[str], y: str, seeds: list[int], **params) -> DataFrame:
    """Metric spread over seeds: mean, population std, min and max."""
    types = split_types(train, cols)
    train, test = encoded(materialize(train), test, cols, y)

    found = boost_rank(train, test, [(types, s) for s in seeds], y, **({"subsamplingRate": 0.8} | params)).collect()
    rows = [(seeds[r["arm"]], k, float(r[k])) for r in found for k in ("pr_auc", "roc_auc")]
    return M.seed_summary(_metrics(train.sparkSession, rows, "seed int, metric string, value double"), ["metric"])


def hash_ranks(df: DataFrame, row_id: str, salt: int, name: str, bucket_rows: int = 100_000, n: int | None = None) -> DataFrame:
    """Number all rows 1 .. n in a seeded hash order: a rank within hash buckets of bounded size, and the rows in the buckets before."""
    n = df.count() if n is None else n
    span = -(-(2**53) // max(1, -(-n // bucket_rows)))
    h = F.pmod(F.xxhash64(row_id, F.lit(salt)), F.lit(2**53))
    df = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / span))
    sizes = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # one row per bucket
    before = sizes.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", row_id))
    return df.withColumn("_r", rank).join(before, "_b").withColumn(name, F.col("_r") + F.col("_s")).drop("_h", "_b", "_r", "_s")


def permutation_importance(model, df: DataFrame, cols: list[str], y: str, row_id: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """AP lost when one column is shuffled over all rows, averaged over repeats."""
    base = materialize(df.select(row_id, y, *cols))
    n = base.count()
    full = float(ranking(score(model, base, cols), y).first()["pr_auc"])
    left = materialize(hash_ranks(base, row_id, seed, "_k", n=n))  # one order for all rounds

    def one(item):
        i, r = item
        right = hash_ranks(base.select(row_id, cols[i]), row_id, seed + 1 + i * repeats + r, "_k", n=n).drop(row_id)
        ap = float(ranking(score(model, left.drop(cols[i]).join(right, "_k").drop("_k"), cols), y).first()["pr_auc"])
        return cols[i], full - ap

    rows = side_by_side(one, [(i, r) for i in range(len(cols)) for r in range(repeats)])
    imp = _metrics(df.sparkSession, rows, "feature string, drop double").groupBy("feature").agg(F.avg("drop").alias("importance"))
    return M.importance_rank(imp, "importance")


def leakage_audit(train: DataFrame, test: DataFrame, cols: list[str], y: str, suspects: list[str], seed: int = 42, **params) -> DataFrame:
    """Metrics with all features, without the one most correlated with the label, and without documented suspects."""
    train = materialize(train)
    num, text = split_types(train, cols)
    top = M.label_correlation(train, num, y).orderBy(F.desc(F.abs("r")), "feature").first()["feature"]
    arms = {"all": cols, f"without_{top}": [c for c in cols if c != top], "without_suspects": [c for c in cols if c not in suspects]}
    train, test = encoded(train, test, cols, y)

    types = [([c for c in a if c in num], [c for c in a if c in text]) for a in arms.values()]
    found = boost_rank(train, test, [(t, seed) for t in types], y, **params).collect()
    rows = [(list(arms)[r["arm"]], r["pr_auc"], r["roc_auc"]) for r in sorted(found, key=lambda r: r["arm"])]
    return _metrics(train.sparkSession, rows, "arm string, pr_auc double, roc_auc double")


def grouped_oof(df: DataFrame, cols: list[str], y: str, group: str, k: int = 5, seed: int = 42, **params) -> DataFrame:
    """Out-of-fold scores; a group (user) is never in both the fitting and the scored side."""
    df = df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))
    df = materialize(df)
    parts = side_by_side(lambda i: score(fit(df.filter(F.col("fold") != i), cols, y, "gbt", seed, **params), df.filter(F.col("fold") == i), cols), range(k))
    return reduce(DataFrame.unionByName, parts)


# ---- calibration ----------------------------------------------------------------
def calibrate(val: DataFrame, y: str = "y", column: str = "score") -> tuple[str, Callable[[DataFrame], DataFrame], DataFrame]:
    """Isotonic or logistic map of the score, whichever has the lower Brier score on the validation rows.

    The isotonic fit pools score ranges in parallel (`isotonic_blocks`); a constant fit or a straight line between its blocks is applied.
    """
    iso = isotonic_map(isotonic_blocks(val, y, column))
    vec = VectorAssembler(inputCols=["_s"], outputCol="_v")
    platt = LogisticRegression(featuresCol="_v", labelCol="_y").fit(vec.transform(val.select(F.col(column).alias("_s"), F.col(y).cast("double").alias("_y"))))

    def by_iso(df: DataFrame) -> DataFrame:
        return iso(df, column, "calibrated")

    def by_platt(df: DataFrame) -> DataFrame:
        a, b = float(platt.coefficients[0]), float(platt.intercept)
        return df.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(a * F.col(column) + b))))

    maps = {"isotonic": by_iso, "logistic": by_platt}
    brier = lambda d, c: d.agg(F.avg(F.pow(F.col(c) - F.col(y), 2))).first()[0]
    rows = [("none", float(brier(val, column)))] + [(k, float(brier(f(val), "calibrated"))) for k, f in maps.items()]
    best = min((r for r in rows if r[0] != "none"), key=lambda r: (r[1], r[0]))[0]
    return best, maps[best], _metrics(val.sparkSession, rows, "method string, brier double")


# ---- decision -------------------------------------------------------------------
def keep_or_replace(metrics: DataFrame, rule: str = "ci") -> DataFrame:
    """Verdict per detector: ``ci`` needs a paired interval above 0, ``margin`` a validation gain over 0.01,
    ``lower`` a lower error."""
    better = {
        "ci": lambda: F.col("ci_low") > 0,
        "margin": lambda: F.col("new_value") > F.coalesce(F.col("old_value"), F.lit(0.0)) + 0.01,
        "lower": lambda: F.col("new_value") < F.col("old_value"),
    }[rule]()
    return metrics.withColumn("verdict", F.when(F.coalesce(better, F.lit(False)), "replace").otherwise("keep_incumbent"))


def hash_split(df: DataFrame, row_id: str, share: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    u = X.hash_fraction(F.col(row_id), seed)
    return df.filter(u < share), df.filter(u >= share)
