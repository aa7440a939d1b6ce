"""Run registered queries against their DuckDB oracles (the driver's check, locally).

    python -m tests.oracle_compare [sf_dir] [name ...]

Compares row count, column names and the multiset of rows (columns sorted by
name, floats compared to 1e-9 relative).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return bool(v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    rows = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    q = queries()[name]
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sdf), "spark_s": round(t1 - t0, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        res["oracle"] = "none"
        return res
    con = con or duck(sf_dir)
    odf = con.execute(sql).df()
    res["oracle_rows"] = len(odf)
    res["cols_match"] = sorted(sdf.columns) == sorted(odf.columns)
    if not res["cols_match"]:
        res["cols"] = (sorted(sdf.columns), sorted(odf.columns))
        res["match"] = False
        return res
    a, b = rows_of(sdf), rows_of(odf)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        res["only_spark"] = sorted(sa - sb)[:3]
        res["only_oracle"] = sorted(sb - sa)[:3]
    return res


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = argv
    if argv and argv[0].startswith("/"):
        sf_dir, names = argv[0], argv[1:]
    sys.path.insert(0, ".")
    from agora.session import get_session
    from __spark_entry__ import queries
    spark = get_session("local[8]")
    con = duck(sf_dir)
    names = names or list(queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("match", r.get("oracle") == "none")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
