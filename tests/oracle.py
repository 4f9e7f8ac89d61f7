"""Run queries beside their SQL and compare the rows, whatever their order.

    python tests/oracle.py [folder] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, build, sql, folder):
    df = build(spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = normal(cursor.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    if got != want:
        only = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only here {only}; lacking {lacking}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE",
            "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    odd = [f"{c}: {k} vs {kinds[c]}" for c, k in df.dtypes if same.get(k) != kinds[c]]
    return f"types {odd}" if odd else ""


def main():
    from __spark_entry__ import oracle_sql, queries
    from vitalake.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, "oracle")
    con = connect(folder)
    built, sqls, bad = queries(), oracle_sql(), 0
    for name in sys.argv[2:] or built:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, built[name], sqls[name], folder)
            else:
                problem = "" if built[name](spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or built)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
