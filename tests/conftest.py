import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _values(df):
    import pandas as pd

    def one(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    """same_rows(spark_df, sql, sf_dir or {table: pandas}): asserts equal columns and rows."""
    import duckdb

    def check(df, sql, tables):
        c = duckdb.connect()
        if isinstance(tables, str):
            for t in TABLES:
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
        else:
            for name, t in tables.items():
                c.register(name, t)
        got, want = df.toPandas(), c.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _values(got) == _values(want)

    return check
