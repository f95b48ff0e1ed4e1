"""Causal medians against plain ones."""

import random
from datetime import date, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from wardline.operators import userday as U


def test_past_against_sorting():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50):
        for _ in range(60):
            values = [r.choice([r.randint(-3, 3), r.random() * 6 - 3]) for _ in range(n)]
            past = U.Past()
            for x in values:
                past.add(x)
            centre = r.choice([past.median(), r.randint(-4, 4), 100.0, -100.0])
            assert past.median() == (median(values) if values else None)
            assert past.spread(centre) == (pytest.approx(median(abs(x - centre) for x in values)) if values else None)


def test_causal_deviation_of_keys_with_gaps_nulls_and_slices(spark):
    r = random.Random(2)
    rows = [(k, date(2024, 1, 1) + timedelta(days=2 * i), r.choice([None, r.randint(0, 9), r.randint(0, 9)]), float(i % 4)) for k in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "user string, day date, x int, z double")

    def plain(values):
        out = []
        for i, x in enumerate(values):
            past = [v for v in values[:i] if v is not None]
            m = median(past) if past else None
            s = median(abs(v - m) for v in past) if past else None
            out.append(max((x - m) / (1.4826 * s), 0.0) if x is not None and s else 0.0)
        return out

    want = {}
    for k in ("a", "b", None):
        mine = [r for r in rows if r[0] == k]
        for r_, dx, dz in zip(mine, plain([m[2] for m in mine]), plain([m[3] for m in mine])):
            want[k, r_[1]] = (pytest.approx(dx), pytest.approx(dz))
    got = {(r["user"], r["day"]): (r["dev_x"], r["dev_z"]) for r in U.robust_deviation(df, "user", ["x", "z"], causal=True).collect()}
    assert got == want
    assert U.robust_deviation(df.withColumn("day", F.unix_date("day")), "user", ["x"], causal=True).count() == len(rows)
