"""Run registered queries beside their SQL in DuckDB and compare every value."""

from __future__ import annotations

import math
import sys
import time

from pyspark.sql import SparkSession

from wardline.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark: SparkSession, sf: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, str]:
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    result = {}
    for name in names or list(QUERIES):
        q = QUERIES[name]
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            got = [tuple(r) for r in df.collect()]
            sec = time.time() - t0
            if q.sql is None:
                result[name] = f"rows {len(got)}"
            else:
                cur = con.execute(q.sql)
                types = {d[0]: str(d[1]) for d in cur.description}
                want = cur.fetchall()
                gc, g = _rows(df.columns, got)
                wc, w = _rows(list(types), want)
                bad = [f"{c}:{t}" for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
                if gc != wc:
                    result[name] = f"FAIL columns {gc} vs {wc}"
                elif len(g) != len(w):
                    result[name] = f"FAIL rows {len(g)} vs {len(w)}"
                elif g != w:
                    diff = [(a, b) for a, b in zip(g, w) if a != b]
                    result[name] = f"FAIL {len(diff)} rows differ, e.g. {diff[0]}"
                elif bad:
                    result[name] = f"FAIL oracle types {bad}"
                else:
                    kinds = {type(v).__name__ for r in g for v in r}
                    result[name] = f"ok {len(g)}" + (" EMPTY" if not g else "") + f" {sorted(kinds)}"
        except Exception as e:  # report and go on with the next query
            sec = time.time() - t0
            result[name] = "FAIL " + str(e).strip().replace("\n", " ")[:600]
        if verbose:
            print(f"{name:34s} {sec:6.2f}s {result[name]}", flush=True)
    return result


def main() -> None:
    from wardline import plans
    from wardline.session import build_session

    plans.load()
    sf = sys.argv[1]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or None
    if names:
        names = [n for n in QUERIES if any(n.startswith(p) for p in names)]
    res = compare(spark, sf, names)
    fails = [n for n, r in res.items() if r.startswith("FAIL")]
    print(f"{len(res)} queries, {len(fails)} failed: {fails}")


if __name__ == "__main__":
    main()
