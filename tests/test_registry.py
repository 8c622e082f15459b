"""Every registered query against its SQL in DuckDB, and the planted counts by formula."""

import pytest
from compare import duck, duck_bag, spark_bag

import __spark_entry__ as contract
import oracles
from ledgermatch import registry
from ledgermatch.fixtures import PROFILES, Recipe
from ledgermatch.operators.pairing import both_keys
from ledgermatch.plans import profiles

QUERIES, SQL = registry.QUERIES, oracles.build()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert spark_bag(QUERIES[name](spark, sf_dir)) == duck_bag(con, SQL[name])


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"cause", "row_count", "engine_usd", "provider_usd", "diff_usd"}


@pytest.mark.parametrize(("name", "hot_rows"), [*[(n, 2) for n in PROFILES], ("id_fx", 3), ("keyless", 3)])
def test_spread_route_gives_the_same_pairs(spark, sf_dir, name, hot_rows):
    """Every key, or every copied key, is taken for heavy, and nothing else may change."""
    plain, spread = Recipe(spark, sf_dir), Recipe(spark, sf_dir, hot_rows=hot_rows)
    hot = spread.heavy(name)[name].pair
    assert hot.count > (1000 if hot_rows == 2 else 0)
    assert spark_bag(spread.pairs(name)) == spark_bag(plain.pairs(name))


@pytest.mark.parametrize(("name", "sides"), [("id_base", 2), ("id_fx", 2), ("id_own", 2), ("keyless", 3), ("journal", 3)])
def test_ledgers_are_shuffled_once(spark, sf_dir, name, sides):
    """One exchange per side; keyless adds its fee lines, the journal its rank on another key."""
    recipe = Recipe(spark, sf_dir)
    plan = recipe.pairs(name)._jdf.queryExecution().executedPlan().toString()
    of_rates = ("hashpartitioning(currency#", "hashpartitioning(rate_date#")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in exchanges if not any(r in line for r in of_rates)]) == sides
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_search_for_heavy_keys_reads_key_columns_only(spark, sf_dir):
    recipe = Recipe(spark, sf_dir)
    sides = profiles._keyed(recipe.engine("id_fx", False), recipe.provider("id_fx", False), recipe.profile("id_fx"))
    stacked, on = both_keys(*sides, ["pair_key"])
    plan = stacked.select(*on)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "o_orderdate" not in plan and "o_orderstatus" not in plan
