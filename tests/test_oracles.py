"""Every query against its check text, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from oracle_texts import ORACLES
from tallyward.plans.catalogue import QUERIES
from compare import oracle_rows, spark_rows, star_connection, type_differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return star_connection(sf_dir)


def test_every_query_has_a_check_text():
    assert set(QUERIES) == set(ORACLES) <= set(contract.queries()) == set(contract.queries()) | set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_check_text(spark, sf_dir, con, name):
    df = contract.queries()[name](spark, sf_dir)
    columns, rows = spark_rows(df)
    expected_columns, expected, types = oracle_rows(con, contract.oracle_sql()[name])
    assert columns == expected_columns
    assert not type_differences(df, types)
    assert rows == expected


def test_entry_has_rows_and_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["encounter_class", "cost_tier", "age_group", "total_claims", "avg_cost", "total_cost",
                          "avg_out_of_pocket"]
    assert df.count() > 0
