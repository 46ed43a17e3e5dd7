"""Runs registered queries against their SQL twins in DuckDB.

    python tests/oracle.py [--sf DIR] [--hot ROWS] [name or prefix ...]

``--hot`` lowers the row count above which keys are split, so that small tables
take the path of large ones.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "\\N"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_cell(y) for y in x) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{_cell(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, oracles) -> str:
    """Empty text when equal, else what differs."""
    df = queries[name](spark, sf_dir)
    columns = df.columns
    got = _rows(columns, df.collect())
    if name not in oracles:
        return "" if got else "no rows (rows-only check)"
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = _rows(names, cur.fetchall())
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}: {k} vs {kinds[c]}" for c, k in df.dtypes if k in family and family[k] != kinds[c]]
    if got != want:
        g, w = set(got), set(want)
        return (f"rows {len(got)} vs {len(want)} columns {sorted(names)}\n  only spark {sorted(g - w)[:3]}"
                f"\n  only sql   {sorted(w - g)[:3]}")
    return f"TYPES {odd}" if odd else ""


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from caseledger.operators import ordering
    from caseledger.session import build_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    if argv[:1] == ["--hot"]:
        ordering.HOT_ROWS, argv = int(argv[1]), argv[2:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": os.environ.get("ORACLE_PARTITIONS", "8"), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, q, o, bad = duck(sf), queries(), oracle_sql(), []
    for name in q:
        if argv and not any(name == a or name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            text = compare(spark, con, name, sf, q, o)
        except Exception as e:  # noqa: BLE001 - report and go on
            text = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        kind = "sql " if name in o else "rows"
        print(f"{'ok  ' if not text else 'FAIL'} {kind} {time.time() - t0:6.2f}s {name} {text}", flush=True)
        if text:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
