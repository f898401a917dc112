"""Every registered query against its DuckDB equivalent; those without one must run and give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from __spark_entry__ import entry  # noqa: E402
from reviewloom.workload import oracles as oracle_sql  # noqa: E402
from reviewloom.workload import queries  # noqa: E402

EXACT = sorted(oracle_sql())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", EXACT)
def test_matches_oracle(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    types = dict(zip(cols, (str(c[1]) for c in cur.description)))
    assert not check.compare(rows, df.columns, cur.fetchall(), cols)
    for column, kind in df.dtypes:
        assert check.SAME.get(kind, types[column]) == types[column], column


@pytest.mark.parametrize("name", sorted(set(queries()) - set(EXACT)))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
