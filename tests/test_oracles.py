"""Each query that has SQL gives the rows of that SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sparkmeter.plans import context, logs, planted, reports, text, usage

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (usage, logs, text, context, reports, planted)
PAIRS = [(m, n) for m in MODULES for n in sorted(m.SQL)]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("module, name", PAIRS, ids=[n for _, n in PAIRS])
def test_same_rows(spark, duck, module, name):
    df = module.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(module.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)


def test_names_are_unique_and_entry_runs(spark):
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() == 5


def test_plans_prune_and_broadcast(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    plan = usage.QUERIES["cost_by_model"](spark, DATA)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "props" not in plan.split("ReadSchema")[-1]
    plan = usage.QUERIES["session_scope"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
