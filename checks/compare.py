"""Run registered queries against their SQL twins and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import QUERIES
from voucherlens.session import configure


def local_session(cpus: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    """What differs between two tables, order of rows and columns aside."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} against {len(theirs)}"]
    names = sorted(ours.columns)
    numeric = {c: "float64" for c in names if pd.api.types.is_numeric_dtype(ours[c])}
    problems = [
        f"type of {c}: {ours[c].dtype} against {theirs[c].dtype}"
        for c in names
        # A column of longs with missing values comes as doubles from one engine.
        if pd.api.types.is_integer_dtype(ours[c]) != pd.api.types.is_integer_dtype(theirs[c])
        and not (ours[c].isna().any() and theirs[c].isna().any())
    ]
    left, right = (
        df[names].astype(numeric).sort_values(names).reset_index(drop=True)
        for df in (ours, theirs)
    )
    problems += [f"values of {c}" for c in names if not left[c].equals(right[c])]
    return problems


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    oracle = oracle_sql()
    names = argv[1:] or list(QUERIES)
    spark, connection = local_session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        ours = QUERIES[name](spark, sf_dir).toPandas()
        took = time.time() - start
        if name not in oracle:
            print(f"{name}: rows only, {len(ours)} rows, {took:.1f}s", flush=True)
            continue
        problems = differences(ours, connection.execute(oracle[name]).df())
        failed += bool(problems)
        print(f"{name}: {problems or 'same'}, {len(ours)} rows, {took:.1f}s", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
