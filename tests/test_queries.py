"""Registered queries against their SQL oracles on the smallest tables.

All of them run with PLATEWRIGHT_ALL_QUERIES=1; by default one or two of each section.
"""

import os

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

SAMPLE = (
    "src_1 src_3 src_5 snk_3 chk_2 chk_4 chk_9 chk_13 str_2 str_6 arr_1 arr_6 mth_5 fil_2 joi_1 joi_4 joi_9 agg_1 agg_3 agg_5 "
    "agg_7 agg_15 agg_27 win_1 win_3 win_5 top_1 set_2 rsh_4 fea_5 fea_7 fea_8 fea_9 sim_2 sim_6 sim_8 sim_10 mod_4 mod_8 mod_11 "
    "mod_19 sta_1 sta_3 sta_5 sta_7 sta_8 sel_4 sel_7 sel_9 sel_11 udf_3"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(QUERIES) if os.environ.get("PLATEWRIGHT_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLES])
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert compare(got, want) == ""


@pytest.mark.parametrize("name", ["fea_10", "mod_15", "sel_3", "sel_12"])
def test_rows_only_queries(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
