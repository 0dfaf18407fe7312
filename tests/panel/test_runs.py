"""Queries of what a run writes and what a user adds, held to their SQL; writers and searches that meet odd cases."""

import glob
import os
import random

import duckdb
import pytest

from tessera.operators import evolve as gp
from tessera.plans import catalog, run_reports
from tessera.plans.expression import Node, lookup, parse
from tessera.plans.reports import REPORTS
from tessera.plans.subsets import CROSSOVER, MUTATION

SF = "/root/testdata/sf0.001"
NAMES = [n for n, (f, sql) in REPORTS.items() if sql and f.__module__ == run_reports.__name__]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    want = ordered(tuple(r[at.index(k)] for k in columns) for r in want.fetchall())
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    assert len(got) == len(want) and got
    for g, v in zip(got, want):
        assert all(a == b or (isinstance(a, float) and b is not None and a == pytest.approx(b, abs=2e-6)) for a, b in zip(g, v)), (g, v)


def test_point_mutation_without_operators_of_an_arity():
    """First trees of operators of two arguments, mutations of one: a node that no operator fits stays, its features may change."""
    rng, s = random.Random(5), gp.Settings(crossover=0.0, subtree=0.0, hoist=0.0, point=1.0, point_replace=1.0)
    t = parse("cs_add(cs_sub(x, y), cs_rank(x))")
    seen = set()
    for _ in range(30):
        how, new = gp.child(rng, s, t, t, list(MUTATION), ["x", "y", "z"])
        assert how == "point" and new.op == "cs_add" and new.args[0].op == "cs_sub" and new.args[1].op in {lookup(m)[0] for m in MUTATION}
        seen |= {n.value for n in new.nodes() if n.op == "feature"}
    assert seen == {"x", "y", "z"} and all(lookup(m)[2] == 1 for m in MUTATION) and all(lookup(m)[2] == 2 for m in CROSSOVER)
    assert isinstance(new, Node)
