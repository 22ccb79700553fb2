"""Run every query beside its SQL and compare rows: ``python -m crosscheck.compare [sf_dir] [name...]``."""

import sys
import time
from collections import Counter

import duckdb

from reldrift.session import build_session

from .oracle import ORACLE
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(row) for row in df.select(*columns).collect())


def oracle_rows(connection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(r[i] for i in order) for r in result.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "crosscheck", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            columns, mine = spark_rows(QUERIES[name](spark, sf_dir))
            middle = time.time()
            theirs_columns, theirs = oracle_rows(connection, ORACLE[name])
            same = columns == theirs_columns and mine == theirs
            print(f"{'ok  ' if same else 'DIFF'} {name}: {sum(mine.values())} rows, "
                  f"spark {middle - start:.1f}s, oracle {time.time() - middle:.1f}s", flush=True)
            if not same:
                failed += 1
                print("   columns", columns, theirs_columns)
                print("   only spark ", list((mine - theirs).items())[:2])
                print("   only oracle", list((theirs - mine).items())[:2], flush=True)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
