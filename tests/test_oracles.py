"""Every catalogue query against its SQL; those without SQL give the same rows however Spark deals them."""

import pytest
from conftest import SF
from oracle_check import connect, difference, ordered
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark import catalogue

NAMES = sorted(n for n in catalogue.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


LARGER = SF.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.ORACLE_SQL])
def test_agrees_with_sql(spark, con, sf, name):
    found = difference(con, catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name])
    if found == "no rows":
        found = difference(connect(LARGER), catalogue.QUERIES[name](spark, LARGER), catalogue.ORACLE_SQL[name])
    assert found is None


def rough(rows):
    return [tuple(float(x) if isinstance(x, float) else x for x in r) for r in ordered(rows)]


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.ORACLE_SQL])
def test_same_rows_however_they_are_dealt(spark, sf, name):
    folder = sf if catalogue.QUERIES[name](spark, sf).limit(1).count() else LARGER
    found = []
    for width in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            df = catalogue.QUERIES[name](spark, folder)
            found.append(rough(df.select(*[F.col(c).cast("string") if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    one, two = found
    assert one and len(one) == len(two)
    for r, s in zip(one, two, strict=True):
        assert r == pytest.approx(s, rel=1e-6, abs=1e-6) if all(isinstance(x, (int, float)) for x in r) else [x if not isinstance(x, float) else round(x, 4) for x in r] == [x if not isinstance(x, float) else round(x, 4) for x in s]
