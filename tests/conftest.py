import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v) -> str:
    import decimal
    import math

    import numpy as np

    if v is None or str(v) in ("NaT", "nan", "<NA>"):
        return ""
    if isinstance(v, list | np.ndarray):
        return str([plain(x) for x in v])
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "" if math.isnan(v) else str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v)


def rows(pdf) -> list[str]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted("|".join(map(plain, r)) for r in pdf.itertuples(index=False))
