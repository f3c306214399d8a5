import os

import pytest

import check
from hirecube.plans import catalog

SF = "/root/testdata/sf0.001"

# one query of each kind; check.py compares all of them
SAMPLE = [
    "mean_pay_by_month_gender", "build_cube", "merge_cube", "gender_gap", "history", "month_category_grid",
    "repair_months_in_sequence", "parse_decimal_comma", "group_series_all_scenarios", "regression_groups",
    "forecast_first_order", "chart_education", "read_raw_files_to_cube",
]


@pytest.fixture(scope="module")
def contract():
    import __spark_entry__ as module
    return module


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_contract(contract):
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 70
    own = set(catalog.load())
    assert not own - set(oracle) - {"ols_all_terms", "fit_seasonal_ar", "project_groups"}


def test_entry(spark, contract, db):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, contract, db, name):
    frame = contract.queries()[name](spark, SF)
    got = check.canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = db.execute(contract.oracle_sql()[name])
    assert got == check.canonical([d[0] for d in result.description], result.fetchall())
