"""Compare registered queries with their DuckDB twins: python tests/oracle_check.py SF [names...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, plan, sql, sf):
    """(spark rows, duckdb rows, first difference or None)."""
    df = plan(spark, sf)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(mine), len(theirs), f"columns {sorted(df.columns)} / {sorted(names)}"
    types = [(f.name, f.dataType.simpleString()) for f in df.schema]
    odd = [t for t in types if t[1] not in ("int", "bigint", "string", "double", "boolean")]
    if mine != theirs:
        for a, b in zip(mine, theirs):
            if a != b or [type(x) for x in a] != [type(x) for x in b]:
                return len(mine), len(theirs), f"{str(a)[:600]}\n   <> {str(b)[:600]}"
        return len(mine), len(theirs), "row counts differ"
    wrong = [(a, b) for a, b in zip(mine, theirs) if [type(x) for x in a] != [type(x) for x in b]]
    if wrong:
        return len(mine), len(theirs), f"types {wrong[0]}"
    return len(mine), len(theirs), None if not odd else f"ok, but types {odd}"


def main():
    from corpusloom.session import build_session
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, plan in queries.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                n, m, diff = compare(spark, con, plan, oracles[name], sf)
            else:
                n, m, diff = plan(spark, sf).count(), "-", None
        except Exception as error:  # report and go on
            n = m = "?"
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28} {n}/{m} {time.time() - t:.2f}s {'' if diff is None else chr(10) + '   ' + diff}", flush=True)
    print("differences:", bad, "of", len(queries), "with oracle", len(oracles))


if __name__ == "__main__":
    main()
