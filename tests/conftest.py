import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"{tmp}/shared").config("spark.local.dir", str(tmp)).config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _split(row):
    """What sorts a row: all but its floating-point numbers; and these, with NaN as null."""
    exact = repr([x for x in row if not isinstance(x, float)])
    return exact, [None if isinstance(x, float) and x != x else x for x in row]


def rows(df):
    """Sorted rows with columns by name."""
    names = sorted(df.columns)
    return names, sorted((_split([r[c] for c in names]) for r in df.collect()), key=repr)


def same(got, wanted):
    """Equal names and rows, floating-point numbers up to rounding."""
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    for (exact, a), (other, b) in zip(got[1], wanted[1]):
        assert exact == other
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], rel=1e-6, abs=2e-6)


@pytest.fixture(scope="session")
def oracle():
    def run(sql, sf=SMALL, **tables):
        con = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            name = os.path.basename(f)[:-8]
            if name not in tables:
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
        for name, frame in tables.items():
            con.register(name, frame)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        order = [names.index(c) for c in sorted(names)]
        return sorted(names), sorted((_split([r[i] for i in order]) for r in got.fetchall()), key=repr)

    return run
