"""Every entity-graph query against DuckDB, and properties of those that SQL cannot state."""

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tests.conftest import SMALL, rows, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, oracle, name):
    same(rows(catalog.QUERIES[name](spark, SMALL)), oracle(catalog.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["graph_id", "src", "dst", "dist"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_macenko_fit_has_unit_stains(spark):
    for r in catalog.QUERIES["macenko_fit"](spark, SMALL).collect():
        for v in r.asDict().values():
            if isinstance(v, list):
                assert abs(sum(x * x for x in v) - 1) < 1e-6


def test_normalized_images_stay_in_range(spark):
    for name in ("macenko_image",):
        df = catalog.QUERIES[name](spark, SMALL)
        assert df.filter(F.least("r", "g", "b") < 0).count() == 0


def test_merged_superpixels_cover_the_same_pixels(spark):
    df = catalog.QUERIES["merge_superpixels"](spark, SMALL)
    assert df.count() > 0
    assert df.count() == df.select(*df.columns[:2]).distinct().count()
