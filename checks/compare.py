"""Run registered queries on Spark and in DuckDB and compare the results.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark: SparkSession, duck, sf_dir: str, name: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in ORACLE:
        return f"{name}: {sum(ours.values())} rows, no SQL, {took:.1f}s"
    start = time.time()
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    sql_took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"{name}: DIFFERS in columns {sorted(df.columns)} {sorted(columns)}"
    if ours != theirs:
        extra, lack = list((ours - theirs).items()), list((theirs - ours).items())
        return (
            f"{name}: DIFFERS {sum(ours.values())} vs {sum(theirs.values())} rows\n"
            f"  only Spark {len(extra)}: {str(extra[:3])[:600]}\n"
            f"  only SQL {len(lack)}: {str(lack[:3])[:600]}"
        )
    return f"{name}: ok, {sum(ours.values())} rows, spark {took:.1f}s sql {sql_took:.1f}s"


def connect(sf_dir: str):
    import duckdb

    duck = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        duck.execute(f"CREATE VIEW {file.stem} AS FROM read_parquet('{file}')")
    return duck


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = connect(sf_dir)
    for name in argv[1:] or QUERIES:
        try:
            print(compare(spark, duck, sf_dir, name), flush=True)
        except Exception as e:  # report and go on with the next query
            print(f"{name}: FAILED {type(e).__name__}: {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
