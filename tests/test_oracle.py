"""Every registered query that has a SQL twin gives the same rows."""

import pytest

import __spark_entry__ as entry
import oracle

from conftest import SF

# 25 rows per class: the smallest class of the smallest corpus has 17, which is an error.
LARGER = {"stratified_sample": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def connections():
    return {folder: oracle.connect(folder) for folder in {SF, *LARGER.values()}}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, connections, name):
    folder = LARGER.get(name, SF)
    rows, problem = oracle.compare(entry.queries()[name](spark, folder), connections[folder], entry.oracle_sql()[name])
    assert problem is None


def test_too_small_a_class_is_an_error(spark):
    with pytest.raises(ValueError, match="fewer than 25"):
        entry.queries()["stratified_sample"](spark, SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "frequency"] and df.limit(1).count() == 1
