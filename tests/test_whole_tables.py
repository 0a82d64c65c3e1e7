"""Queries whose tables have few rows at the smallest scale, held against their SQL on larger tables too."""

from collections import Counter

import duckdb
import pytest
from test_queries_sql import TABLES, plain

from gridloom.plans import catalog

LARGER = {
    "sf0.01": ["rank_bucket_table", "rank_hit_rates", "rank_calibration", "extreme_portfolio", "mirrored_edges", "pair_node_edges", "two_hop_paths", "panel_diagnostics", "intermittent_levels", "tsb_levels", "intermittent_selection", "spatial_block_folds", "grouped_fold_table", "best_of_bank_forecasts"],
    "sf0.1": ["link_score_table", "aggregation_layer", "cosine_table"],
}


def test_every_supplier_gets_a_model(spark):
    sf = "/root/testdata/sf0.01"
    want = {str(r[0]) for r in spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R'").select("l_suppkey").distinct().collect()}
    assert len(want) > 13 and {str(r["series_id"]) for r in catalog.QUERIES["intermittent_selection"](spark, sf).collect()} == want


@pytest.mark.parametrize(("sf", "name"), [(sf, n) for sf, names in LARGER.items() for n in names])
def test_matches_sql_on_larger_tables(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in catalog.QUERIES[name](spark, f"/root/testdata/{sf}").collect()) == want
