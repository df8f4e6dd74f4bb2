"""Run a registered query on Spark and its SQL on DuckDB and compare every value."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from footlamp import get_session  # noqa: E402
from footlamp.catalog import REGISTRY  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    q = REGISTRY[name]
    start = time.time()
    df = q.run(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    out = {"name": name, "rows": len(got), "spark_s": round(time.time() - start, 2), "ok": True, "note": ""}
    if q.sql is None:
        out["note"] = "rows only"
        return out
    start = time.time()
    table = con.sql(q.sql).to_arrow_table()
    out["duck_s"] = round(time.time() - start, 2)
    if sorted(table.column_names) != cols:
        return {**out, "ok": False, "note": f"columns {cols} vs {sorted(table.column_names)}"}
    types = {f.name: str(f.type) for f in table.schema}
    spark_types = dict(df.dtypes)
    kinds = {"double": "double", "int64": "bigint", "int32": "int", "string": "string", "bool": "boolean"}
    odd = [f"{c}:{spark_types[c]}/{types[c]}" for c in cols if kinds.get(types[c], types[c]) != spark_types[c]]
    odd = [o for o in odd if not (o.split(":")[1].split("/")[0] in ("int", "bigint") and "int" in o.split("/")[1])]
    if odd:
        out["note"] = "types " + " ".join(odd)
    data = table.select(cols).to_pydict()
    want = list(zip(*[data[c] for c in cols])) if table.num_rows else []
    if len(want) != len(got):
        return {**out, "ok": False, "note": f"rows {len(got)} vs {len(want)}"}
    bad = []
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if a != b:
            bad.append((a, b))
    if bad:
        close = sum(
            all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y))) for x, y in zip(a, b))
            for a, b in bad
        )
        out.update(ok=False, note=f"{len(bad)} rows differ ({close} within rounding) {cols} e.g. {bad[0]}")
    return out


def main() -> None:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    names = [n for n in REGISTRY if not wanted or any(n.startswith(w) for w in wanted)]
    spark = get_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            r = {"name": n, "ok": False, "note": f"{type(e).__name__}: {str(e)[:1200]}"}
        failed += not r["ok"]
        print("ok  " if r["ok"] else "FAIL", r["name"], r.get("rows"), r.get("spark_s"), r.get("duck_s"), r["note"], flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main()
