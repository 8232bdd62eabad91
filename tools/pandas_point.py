"""Single-process pandas timing of the flagship monthly outlet mart on the
same Parquet tables (a single-node comparison point for bench.py).

usage: python tools/pandas_point.py [sf_dir]
"""

from __future__ import annotations

import json
import sys
import time

import pandas as pd

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def monthly_outlet(sf_dir: str) -> pd.DataFrame:
    li = pd.read_parquet(f"{sf_dir}/lineitem.parquet",
                         columns=["l_orderkey", "l_extendedprice", "l_discount", "l_tax"])
    o = pd.read_parquet(f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderdate"])
    c = pd.read_parquet(f"{sf_dir}/customer.parquet", columns=["c_custkey", "c_nationkey", "c_mktsegment"])
    n = pd.read_parquet(f"{sf_dir}/nation.parquet", columns=["n_nationkey", "n_name"])
    dims = (o.merge(c, left_on="o_custkey", right_on="c_custkey", how="left")
             .merge(n, left_on="c_nationkey", right_on="n_nationkey", how="left"))
    lines = li.merge(dims, left_on="l_orderkey", right_on="o_orderkey")
    sales = (lines.l_extendedprice * (1 - lines.l_discount) * (1 + lines.l_tax))
    d = lines.o_orderdate
    frame = pd.DataFrame({
        "year": d.dt.year.astype(str),
        "month": d.dt.month.map(lambda m: MONTHS[m - 1]),
        "outlet_name": lines.n_name,
        "brand": lines.c_mktsegment.fillna("Other"),
        "invoice_no": lines.l_orderkey,
        "sales": sales,
    })
    g = frame.groupby(["year", "month", "outlet_name", "brand"]).agg(
        mtd_sales=("sales", "sum"), mtd_bills=("invoice_no", "nunique")).reset_index()
    g["mtd_abv"] = (g.mtd_sales / g.mtd_bills).where(g.mtd_bills > 0, 0.0)
    return g


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    best = None
    for _ in range(3):
        t0 = time.perf_counter()
        out = monthly_outlet(sf_dir)
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    print(json.dumps({"query": "q_monthly_outlet", "engine": "pandas " + pd.__version__,
                      "rows": len(out), "best_of_3_sec": round(best, 3)}))


if __name__ == "__main__":
    main()
