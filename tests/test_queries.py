"""Every named query: its SQL twin must give the same rows, or it must return rows."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, message = compare.compare(
        spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)
    )
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
