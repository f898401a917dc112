"""Corpus queries against their DuckDB equivalents."""

import os
import sys

import pytest

pytest.importorskip("corpus_pipeline")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check  # noqa: E402
from reviewloom.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_oracle(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = check.connect(sf_dir).execute(registry.oracles()[name])
    cols = [c[0] for c in cur.description]
    types = dict(zip(cols, (str(c[1]) for c in cur.description)))
    assert not check.compare(rows, df.columns, cur.fetchall(), cols)
    for column, kind in df.dtypes:
        assert check.SAME.get(kind, types[column]) == types[column], column
