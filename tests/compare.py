"""Registered queries against their SQL: ``python tests/compare.py DIR [names]``."""

from __future__ import annotations

import datetime
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def differences(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {spark_df.columns} vs {names}"
    order = sorted(names)
    ours = Counter(
        tuple(_plain(r[n]) for n in order) for r in spark_df.select(*order).collect()
    )
    place = [names.index(n) for n in order]
    theirs = Counter(tuple(_plain(r[i]) for i in place) for r in result.fetchall())
    if ours != theirs:
        return (
            f"rows {sum(ours.values())} vs {sum(theirs.values())};"
            f" only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
        )
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    wanted = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            found = differences(entry.queries()[name](spark, sf_dir), con, sql[name])
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:32s} {time.time() - t0:6.1f} {'ok' if found is None else found}", flush=True)
    print(f"{len(wanted)} queries, {bad} differ")


if __name__ == "__main__":
    main()
