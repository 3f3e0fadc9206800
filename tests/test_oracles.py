"""Every SQL twin binds to the tables, and twins and queries belong together."""

import glob
import os

import duckdb
import pytest
from foretell.plans import oracles, queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_twin_binds(tables, name):
    assert name in queries.QUERIES
    tables.execute(f"EXPLAIN {oracles.ORACLES[name]}").fetchall()


def test_parts_of_the_engineered_frame():
    from foretell.schema import FEATURES, GOAL_FEATURES, SHOT_FEATURES

    parts = [oracles.FORM_FEATURES, oracles.CALENDAR_FEATURES, oracles.STRENGTH_FEATURES]
    assert sorted(sum(parts, [])) == sorted(set(FEATURES) - {*GOAL_FEATURES, *SHOT_FEATURES})
    assert all(len(p) > 15 for p in parts)


def test_only_matches_read_all_columns(spark, sf_dir):
    """All orders are joined by their teams; the lines' other columns are grouped for those that become matches only."""
    from foretell.sources.derived import matches

    plan = matches(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    wide = [i for i, line in enumerate(plan) if "Aggregate [l_orderkey" in line and "l_extendedprice" in line]
    assert wide and all("Join LeftSemi" in "".join(plan[i + 1 : i + 4]) for i in wide)
