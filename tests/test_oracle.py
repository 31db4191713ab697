"""Every query of the core against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docloom.plans import corpus, feeds, pipeline

NAMES = [(m, n) for m in (feeds, pipeline, corpus) for n in m.SQL]


def _rows(df):
    def one(v):
        if isinstance(v, float):
            return None if v != v else int(v) if v == int(v) else round(v, 9)
        return v

    cols = sorted(df.columns)
    return sorted(str([one(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_matches_sql(spark, duck, sf_dir, module, name):
    got, want = module.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(module.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
