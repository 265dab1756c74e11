import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a Spark query with SQL over the same tables, rows in any order."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def value(v):
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, list):
            return [value(x) for x in v]
        return round(float(v), 9) if type(v).__name__ == "Decimal" else v

    def check(df, sql):
        columns = sorted(df.columns)
        got = sorted(repr([value(r[c]) for c in columns]) for r in df.collect())
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(repr([value(r[names.index(c)]) for c in columns]) for r in result.fetchall())
        assert got == want

    return check
