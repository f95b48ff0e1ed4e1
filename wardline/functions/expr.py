"""Column expressions: derived features, parsing helpers, policy chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline import schemas as C


def micros(ts) -> Column:
    """Whole microseconds since 1970 of a timestamp column with or without a zone (session zone UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


# ---- payments -------------------------------------------------------------------
def hour_from_step(step: Column) -> Column:
    return F.pmod(step, F.lit(24)).cast("int")


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def is_merchant(dest: Column) -> Column:
    return dest.startswith("M").cast("int")


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerant equality, relative to ``b`` only."""
    return (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)).cast("int")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps null as null."""
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def balance_features(df, amount="amount", old_orig="oldbalanceOrg", new_orig="newbalanceOrig",
                     old_dest="oldbalanceDest", new_dest="newbalanceDest"):
    """Residuals, emptied / zero-before flags and ratios of the two balance pairs."""
    a, oo, no, od, nd = (F.col(x) for x in (amount, old_orig, new_orig, old_dest, new_dest))
    ratio = a / (oo + 1.0)
    return df.withColumns({
        "err_orig": oo - a - no,
        "err_dest": od + a - nd,
        "orig_emptied": ((no == 0) & (oo > 0)).cast("int"),
        "dest_zero_before": (od == 0).cast("int"),
        "amt_ratio": ratio,
        "frac_orig_moved": clip(ratio, 0.0, 5.0),
        "amount_eq_oldorig": is_close(a, oo),
    })


# ---- logins and devices ---------------------------------------------------------
def text_bool(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1")


def log_rtt(c: Column) -> Column:
    """log1p of the round-trip time; text that is no number becomes null."""
    return F.log1p(c.cast("string").try_cast("double"))


def family(c: Column, lower: bool = False, empty: str | None = None) -> Column:
    """First whitespace token (product family) of a version string."""
    token = F.split(F.trim(c), r"\s+")[0]
    token = F.lower(token) if lower else token
    token = F.when(token != "", token)
    return F.coalesce(token, F.lit(empty)) if empty is not None else token


def device_key(device_type: Column, browser: Column, os: Column) -> Column:
    parts = [F.coalesce(device_type, F.lit("unknown")), family(browser, empty="unknown"), family(os, empty="unknown")]
    return F.concat_ws("|", *parts)


def off_hours(ts: Column) -> Column:
    h = F.hour(ts)
    return ((h < 6) | (h >= 20)).cast("int")


def country(geo: Column) -> Column:
    return F.substring_index(F.coalesce(geo, F.lit("")), "-", 1)


def coarsen_geo(state: Column) -> Column:
    return F.concat(F.lit("IN-"), state)


# ---- risk tables ----------------------------------------------------------------
def _table(c: Column, table: dict[str, float]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, c)


def criticality(c: Column) -> Column:
    return _table(c, C.CRITICALITY)


def channel_risk(c: Column) -> Column:
    return _table(c, C.CHANNEL_RISK)


def det_risk(vec: dict[str, Column] | None = None) -> Column:
    """Weighted sum of the eleven features, clipped to [0, 1]."""
    total = F.lit(0.0)
    for name in C.FEATURES:
        total = total + F.lit(C.WEIGHTS[name]) * (vec[name] if vec else F.col(name))
    return clip(total, 0.0, 1.0)


def blend(ml: Column, det: Column) -> Column:
    return F.coalesce(F.lit(0.55) * ml + F.lit(0.45) * det, det)


def cold_prior_applies(event_type: Column, channel: Column, new_payee: Column, contact_changed: Column, amount: Column) -> Column:
    """Benign-shaped first contact: the only case in which novelty is softened."""
    return (
        event_type.isin("login", "transaction")
        & channel.isin("mobile_app", "internet_banking", "branch")
        & ~new_payee
        & ~contact_changed
        & (amount.isNull() | (amount < C.COLD_MAX_AMOUNT))
    )


def risk_band(trust: Column, risk: Column) -> Column:
    return (
        F.when((trust >= 650) & (risk < 0.45), "LOW")
        .when((trust >= 400) & (risk < 0.65), "ELEVATED")
        .when(trust >= 150, "HIGH")
        .otherwise("CRITICAL")
    )


def decision(band: Column, event_type: Column) -> Column:
    """Both policies agree on the outcome per band; privileged access differs in the method only."""
    return F.when(band == "LOW", "ALLOW").when(band == "CRITICAL", "BLOCK").otherwise("STEP_UP")


def friction_method(event_type: Column, strong: Column) -> Column:
    return (
        F.when(event_type.isin("account_recovery", "onboarding"), "video_kyc")
        .when(strong, "otp_sms")
        .otherwise("device_biometric")
    )


def step_up_method(band: Column, event_type: Column) -> Column:
    challenged = band.isin("ELEVATED", "HIGH")
    return (
        F.when(challenged & (event_type == "privileged_access"), F.lit("manager_approval"))
        .when(challenged, friction_method(event_type, band == "HIGH"))
    )


def degraded_policy(dec: Column, band: Column, method: Column, event_type: Column, degraded: Column):
    """(decision, band, method) when no model is available: sensitive events fail closed."""
    closed = degraded & event_type.isin(*C.FAIL_CLOSED)
    lifted = closed & (dec == "ALLOW")
    strong = F.when(event_type == "privileged_access", "manager_approval").otherwise("video_kyc")
    return (
        F.when(lifted, "STEP_UP").otherwise(dec),
        F.when(closed, "DEGRADED_FAILCLOSED").when(degraded, "DEGRADED_FAILOPEN").otherwise(band),
        F.when(lifted, strong).otherwise(method),
    )


def trust_delta(risk: Column) -> Column:
    """Uncapped change of the trust score for one event (negative when risky)."""
    loss = -((risk - 0.45) * 900).cast("int")
    return F.when(risk > 0.45, loss).otherwise(((F.lit(0.45) - risk) * 60).cast("int"))


# ---- explanation ----------------------------------------------------------------
def contributions(vec: dict[str, Column] | None = None) -> Column:
    """All weighted features as (value, name), largest first; equal values by name descending."""
    arr = F.array(*[
        F.struct((F.lit(C.WEIGHTS[n]) * (vec[n] if vec else F.col(n))).alias("value"), F.lit(n).alias("name"))
        for n in C.FEATURES
    ])
    return F.sort_array(arr, asc=False)


def reasons(contrib: Column, k: int = 3, minimum: float = 0.05) -> Column:
    text = F.create_map(*[F.lit(x) for kv in C.REASON_TEXT.items() for x in kv])
    top = F.filter(F.slice(contrib, 1, k), lambda x: x["value"] > minimum)
    named = F.transform(top, lambda x: F.element_at(text, x["name"]))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(C.NORMAL_REASON)))


def attribution(vec: dict[str, Column] | None = None) -> Column:
    """Additive attribution weight * (feature - baseline), by magnitude; ties keep the feature order."""
    arr = F.array(*[
        F.struct(
            F.round(F.lit(C.WEIGHTS[n]) * ((vec[n] if vec else F.col(n)) - F.lit(C.BASELINE[n])), 4).alias("phi"),
            F.lit(n).alias("name"), F.lit(i).alias("pos"),
        )
        for i, n in enumerate(C.FEATURES)
    ])
    by_size = lambda a, b: (
        F.when(F.abs(a["phi"]) > F.abs(b["phi"]), -1).when(F.abs(a["phi"]) < F.abs(b["phi"]), 1)
        .otherwise(a["pos"] - b["pos"])
    )
    return F.transform(F.array_sort(arr, by_size), lambda x: F.struct(x["phi"].alias("phi"), x["name"].alias("name")))


def counterfactual(attr: Column, amount: Column, amount_ref: Column) -> Column:
    """One sentence naming the change that would lower the risk most."""
    top, name = attr[0]["phi"], attr[0]["name"]
    text = F.create_map(*[F.lit(x) for kv in C.COUNTERFACTUAL_TEXT.items() for x in kv])
    has_amount = amount.isNotNull() & (amount != 0)
    say = {k: F.lit(v) for k, v in C.COUNTERFACTUAL_SENTENCES.items()}
    usual = F.concat(say["usual_before"], F.format_number(amount_ref.cast("long"), 0), say["usual_after"])
    return (
        F.when(top <= 0, say["none"])
        .when((name == "amount_zscore") & has_amount, F.when(amount_ref > 0, usual).otherwise(say["vague"]))
        .otherwise(F.concat(say["lower_if"], F.element_at(text, name), F.lit(".")))
    )


# ---- arrays and JSON ------------------------------------------------------------
def template_similarity(template: Column, observed: Column) -> Column:
    """max(0, 1 - sum|t-o| / sum|t|); empty or unequal length gives 0."""
    add = lambda acc, x: acc + x
    dist = F.aggregate(F.zip_with(template, observed, lambda t, o: F.abs(t - o).cast("double")), F.lit(0.0), add)
    norm = F.aggregate(F.transform(template, lambda t: F.abs(t).cast("double")), F.lit(0.0), add)
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    usable = (F.size(template) > 0) & (F.size(template) == F.size(observed))
    return F.when(F.coalesce(usable, F.lit(False)), F.greatest(F.lit(0.0), F.lit(1.0) - dist / norm)).otherwise(F.lit(0.0))


def canonical_json(*names: str) -> Column:
    """JSON object with fields in sorted order; nulls are written so the digest covers them."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def laplace(u: Column, scale: float) -> Column:
    """Inverse-CDF Laplace noise from a uniform draw in (-0.5, 0.5)."""
    sign = F.when(u >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return -F.lit(scale) * sign * F.log(1 - 2 * F.abs(u))


def hash_fraction(key: Column, seed: int) -> Column:
    """Deterministic uniform in [0, 1) with 1e-6 steps, stable under re-partitioning and retries."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def digest_fraction(key: Column, seed: int) -> Column:
    """Deterministic uniform in [0, 1) from 52 bits of a SHA-256, which any SQL engine can repeat."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A 64-bit id per row: the hash of its values and of its number among equal rows, so that repeated log rows keep apart.

    Nulls take part with their place, so rows that hold the same values in different columns differ; rows that still share a hash are
    numbered in order of their values. Equal rows are interchangeable, so the ids do not depend on how the table is dealt out.
    """
    values = df.columns
    h = F.xxhash64(*[F.col(f"`{c}`") for c in values], *[F.col(f"`{c}`").isNull() for c in values])
    same = Window.partitionBy("_h").orderBy(*[F.col(f"`{c}`") for c in values])
    out = df.withColumn("_h", h).withColumn("_n", F.row_number().over(same))
    return out.withColumn(name, F.xxhash64("_h", "_n")).drop("_h", "_n")
