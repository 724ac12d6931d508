"""Run registered queries and their SQL side by side and compare rows, columns and values."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - started
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 200_000 else []
        missing = [r for r in theirs if r not in set(mine)][:3] if len(mine) < 200_000 else []
        return False, f"rows {len(mine)} against {len(theirs)}; only here {extra}; only in SQL {missing}"
    return True, f"rows={len(mine)} {took:.1f}s"


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from fleetbump.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        if name not in sqls:
            print("none", name, "has no SQL", flush=True)
            continue
        try:
            ok, note = compare(spark, con, fn, sqls[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
