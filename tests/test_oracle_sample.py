"""A representative slice of the registered queries, checked against their DuckDB
oracles on the smallest fixture (the full set runs with tools/check_oracle.py)."""

import math

import duckdb
import pytest

from tests.conftest import SF_SMALL

SAMPLE = ["overview", "profile_columns", "iqr_outliers", "clean_table", "fill_forward_backward", "suggest_target",
          "one_hot", "encode_target_codes", "classification_metrics", "roc_auc", "stratified_split", "silhouette",
          "assign_clusters", "bandit_sufficient_stats", "reward_curve", "weighted_scores", "findings_by_group",
          "ungrounded_numbers", "npv_percentiles", "even_sample", "bcg_summary", "report_recommendations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    from tablesight.plans.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sdf.columns
    got = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == exp
