"""Run queries and their SQL counterparts side by side.

    python -m checks.compare [--split] [sf_dir] [names..]

``--split`` treats every key group above a few rows as hot, so that all queries
take the paths meant for groups too big for one task.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from checks.duckdb_sql import ORACLES
from checks.fixtures import TABLES
from checks.spark_queries import QUERIES
from weirflow.session import build_session, drop_steps


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(
        (tuple(map(str, row)) for row in frame.itertuples(index=False, name=None)),
    )


def mismatch(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides hold the same rows under the same names."""
    got, want = result.toPandas(), con.execute(sql).fetch_df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = _normal(_as_plain(got)), _normal(_as_plain(want))
    if a != b:
        extra, lacking = list(set(a) - set(b))[:2], list(set(b) - set(a))[:2]
        return f"{len(a)} rows != {len(b)} rows; only here {extra}; only there {lacking}"
    return None


def _as_plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Integer columns with NULLs come as floats or nullable integers; give both one form."""
    out = frame.copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].astype("datetime64[us]")
        elif pd.api.types.is_numeric_dtype(out[c]):
            out[c] = out[c].astype("Float64").round(6)
    return out


SPLIT = {"spark.weirflow.oneTaskBytes": "0", "spark.weirflow.hotGroupRows": "8"}


def main(argv: list[str]) -> int:
    split = "--split" in argv
    argv = [a for a in argv if a != "--split"]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in (SPLIT if split else {}).items():
        spark.conf.set(key, value)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            problem = mismatch(QUERIES[name](spark, sf_dir), con, ORACLES[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.perf_counter() - start:6.2f}s {problem or 'ok'}", flush=True)
    drop_steps(spark)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
