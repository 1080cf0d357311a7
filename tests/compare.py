"""Run queries beside their SQL in DuckDB: python tests/compare.py SF_DIR [QUERY...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in order; integers as one type."""
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_integer_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df = df.assign(**{c: df[c].astype("float64" if df[c].isna().any() else "int64")})
        elif df[c].dtype == object and len(df) and hasattr(df[c].iloc[0], "__len__") and not isinstance(df[c].iloc[0], str):
            df = df.assign(**{c: df[c].map(lambda v: None if v is None else str(list(v)))})
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty if both are the same."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(set(spark_rows.columns) ^ set(sql_rows.columns))}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    a, b = plain(spark_rows), plain(sql_rows)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            return f"{(~same).sum()} rows differ in {c}: {a[c][~same].iloc[0]!r} and {b[c][~same].iloc[0]!r}"
        kinds = {x.kind.replace("b", "i") if hasattr(x, "kind") else str(x) for x in (a[c].dtype, b[c].dtype)} - {"O", "str"}
        if len(kinds) > 1:
            return f"types of {c}: {a[c].dtype} and {b[c].dtype}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            got = queries[name](made, sys.argv[1]).toPandas()
            spent = time.time() - began
            said = differences(got, oracle(sys.argv[1], oracles[name])) if name in oracles else "no SQL"
            print(f"{'ok  ' if not said else 'DIFF'} {name} {len(got)} rows, {spent:.1f} s {said}", flush=True)
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:400]}", flush=True)
