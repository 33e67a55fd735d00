"""The catalogue of the registered tag queries covers every given table."""

import duckdb
import pytest

from tablesight.functions.columns import schema_kind
from tablesight.plans import q_tags
from tablesight.plans.tables import DERIVED_COLUMNS, TABLES, load
from tests.conftest import SF_SMALL

QUERIES = ["suggest_target", "categorical_like", "applicable_analyses", "domain_match", "target_frame", "column_tags",
           "logistics_availability", "goal_labels"]


def test_catalogue_lists_every_table_and_column(spark):
    assert set(q_tags.CATALOG_TABLES) == {*TABLES, *DERIVED_COLUMNS}
    for t in TABLES:
        schema = [(f.name, schema_kind(f.dataType)) for f in load(spark, SF_SMALL, t).schema]
        assert q_tags.CATALOG_TABLES[t] == schema


@pytest.mark.parametrize("name", QUERIES)
def test_tag_queries_cover_every_table(spark, name):
    import __spark_entry__ as E

    out = E.queries()[name](spark, SF_SMALL)
    rows = [r.asDict() for r in out.collect()]
    table = "req_domain" if name == "goal_labels" else "table_name"
    if name != "column_tags":  # a table without a tagged column has no row there
        assert {r[table] for r in rows} == {*TABLES, *DERIVED_COLUMNS}
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(map(repr, ([r[c] for c in names] for r in rows))) == sorted(map(repr, ([r[c] for c in names] for r in want)))


def test_vocabulary_falls_back_to_general(spark):
    from tablesight.operators import tags as TG
    from tablesight.operators import vocabulary as V
    req = spark.createDataFrame([(" Finanzas ",), ("nope",), (None,)], "domain string")
    got = {r["domain"]: (r["eff_domain"], r["row_word"]) for r in TG.vocab_for(req, V.vocab_frame(spark)).collect()}
    assert got == {" Finanzas ": ("finanzas", "cliente o transaccion"), "nope": ("general", "fila"), None: ("general", "fila")}


def test_cluster_traits_text(spark):
    from tablesight.operators import cluster as C
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 10.0, 6.0)], "cluster int, a double, b double")
    text = C.traits_text(C.cluster_profile(df, "cluster", ["a", "b"]), ["a", "b"])
    assert text == "Cluster 0: a bajo; Cluster 1: a alto" and C.traits_text(df, []) == ""
