"""Every query of the engine against its SQL on the smallest tables, and its plan's shape where that matters."""

import glob
from pathlib import Path

import duckdb
import pytest

from loomstat.plans import core, extended, pictures, relational

SF = "/root/testdata/sf0.001"
PLANS = (core, extended, pictures, relational)
QUERIES, SQL = ({k: v for p in PLANS for k, v in getattr(p, n).items()} for n in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float) and v == v and v == int(v) and abs(v) < 1e15:
        return int(v)
    return None if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    if name not in SQL:
        assert rows or name in ("near_dup_pairs",)
        return
    made = duck.execute(SQL[name])
    names = [c[0] for c in made.description]
    at = [names.index(c) for c in sorted(got.columns)]
    assert sorted(names) == sorted(got.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in made.fetchall()), key=repr)


def test_cosine_topk_asks_for_every_row(spark, duck):
    got = {(r["query"], r["rank"]) for r in extended.cosine_topk(spark, SF).collect()}
    ids = [x for (x,) in duck.execute("SELECT vec_id FROM embeddings").fetchall()]
    assert len(ids) > 20 and got == {(i, k) for i in ids for k in (1, 2, 3)}
    assert "% 20" not in SQL["cosine_topk"] and "a.id % 20 = 0" in SQL["threshold_or_best"]


def test_scans_read_only_what_they_need(spark):
    plan = core.two_stage_mean(spark, SF)._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "l_quantity" in x and "ReadSchema" in x)
    assert "l_shipdate" not in scan and "l_orderkey" not in scan.split("ReadSchema")[1]
    plan = core.left_plan_join(spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
