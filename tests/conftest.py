import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "4",
        ).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config(
            "spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")),
        ).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not Path(DATA).exists():
        pytest.skip("the test tables are not here")
    return DATA


@pytest.fixture(scope="session")
def duck(data_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns by name: for comparing two engines."""
    import pandas as pd

    def text(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return "NULL"
        if isinstance(v, (bool, float, int)) or type(v).__module__ == "numpy":
            return repr(float(v))
        return str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(text(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))
