"""Every query of the core against its SQL on the smallest tables, where they are there."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from tanzaku.plans.catalogue import ORACLES, QUERIES

DATA = Path(os.environ.get("TANZAKU_TEST_TABLES", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, engine, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    assert not [t for _, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = engine.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, str(DATA)).collect()
    assert len(rows) == len({tuple(r) for r in rows})


def test_recommend_plan_reads_only_what_it_needs(spark):
    plan = QUERIES["cosine_topk"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[1].split("\n")[0]
    recall = QUERIES["recall_quota"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in recall
