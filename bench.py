"""Time the headline queries on $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "replay_features", "risk_bands", "trust_decisions", "payment_features", "causal_index", "impossible_travel", "trailing_rate",
    "device_identity_count", "drift_cusum", "drift_mean_shift", "userday_activity", "robust_deviation", "budget_sweep",
    "frequency_encoding", "temporal_split_quantile", "roc_curve", "threshold_free", "operating_points", "calibration", "cost_amount",
    "per_user_eer", "leaderboard", "disparate_impact", "keystroke_scaled_manhattan", "standard_scale", "pseudonymize",
    "idempotency_status", "assertion_status", "chain_round_trip", "head_checkpoint", "vault_round_trip", "identity_means",
    "dp_export", "bootstrap_ci", "iforest_scores", "gbt_scores", "serving_risk", "calibrate",
]
#: Timed a second time, when code is generated and compiled.
WARM = ["replay_features", "trust_decisions", "roc_curve", "operating_points", "calibration", "leaderboard", "keystroke_scaled_manhattan", "standard_scale"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wardline import plans
    from wardline.plans.registry import QUERIES
    from wardline.session import build_session

    plans.load()
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__default__parallelism=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    seconds, warm, rates = {}, {}, {}
    for name, into in [*((n, seconds) for n in names), *((n, warm) for n in WARM if n in names)]:
        t0 = time.time()
        QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        into[name] = round(time.time() - t0, 3)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    for name in ("replay_features", "trust_decisions"):
        if name in seconds:
            rates[f"{name}_events_per_sec"] = round(events / seconds[name], 1)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/")), "rates": rates, "warm": warm}))


if __name__ == "__main__":
    main()
