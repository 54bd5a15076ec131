import pytest

from seqlake.plans import catalog

from .duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


def test_write_groups_follow_the_limits(spark):
    rows = catalog.queries()["write_groups"](spark, SF).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["queue"], r["group_id"]), []).append(r["pos"])
    assert all(len(v) <= 16 for v in sizes.values())
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_flagship_has_rows(spark):
    df = catalog.flagship(spark, SF)
    assert df.columns == ["key", "value"]
    assert df.count() > 0
