"""What the optimiser makes of the queries: columns pruned, filters pushed, no products of tables."""

import re

import pytest

from ledgerline.plans import catalogue

SF = "/root/testdata/sf0.001"
#: A product with one row (totals, means), or a matrix over a dimension.
ONE_ROW = {"q07_ordinal_pct", "q20_rank_bands", "q106_repair_cases", "q43_lagged_staleness", "q44_spearman_matrix", "q59_mann_whitney", "q93_leave_one_out", "q14_critic_weights", "q21_anova_effects", "q58_permutation", "q75_group_transform_impute"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - {"q60_peer_kmeans", "q61_pca_weights", "q62_portfolio_qp"}))
def test_no_products(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert ("BroadcastNestedLoopJoin" in text) <= (name in ONE_ROW)


@pytest.mark.parametrize("name, table, columns", [
    ("q01_company_year_attribution", "lineitem", {"l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate"}),
    ("q30_hhi", "lineitem", {"l_partkey", "l_suppkey", "l_quantity"}),
    ("q46_status_resolution", "documents", {"doc_id", "n_chars"}),
    ("q70_masks_and_membership", "orders", {"o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"}),
])
def test_columns_are_pruned(spark, name, table, columns):
    text = plan(catalogue.queries()[name](spark, SF))
    read = [set(re.findall(r"(\w+):", m)) for m in re.findall(rf"{table}\.parquet\].*?ReadSchema: struct<([^>]*)>", text)]
    assert read and all(r == columns for r in read)


@pytest.mark.parametrize("name, column", [
    ("q35_semi_anti", "o_totalprice"), ("q74_two_level_rate", "l_returnflag"), ("q80_join_shapes", "p_size"), ("q77_lists_and_ranges", "value"),
])
def test_filters_reach_the_scan(spark, name, column):
    assert re.search(rf"PushedFilters: \[[^\]]*\({column},", plan(catalogue.queries()[name](spark, SF)))
