"""Bindings to the driver's parquet tables and the dirty variants derived from them.

The dirty variants are defined once here, as SQL text that both Spark and DuckDB
run, so the Spark query and its oracle see exactly the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_DIRTY_SELECT = (
    "SELECT event_id, ts, user_id, "
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type, "
    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, props FROM events"
)
# Nulls injected into two columns plus exact duplicate rows (same rows twice).
DIRTY_EVENTS_SQL = f"{_DIRTY_SELECT} UNION ALL {_DIRTY_SELECT} WHERE event_id < 50"

# Gaps in the timestamp column for the ordered fill.
GAPPY_EVENTS_SQL = (
    "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id < 3 THEN NULL ELSE ts END AS ts, "
    "user_id, event_type, value FROM events"
)

# Free-text gaps for the constant fill.
GAPPY_DOCUMENTS_SQL = (
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text, lang, source FROM documents"
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views named like the tables, so SQL text can be shared with the oracle."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def sql(spark: SparkSession, sf_dir: str, text: str, names=TABLES) -> DataFrame:
    register_views(spark, sf_dir, names)
    return spark.sql(text)


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DIRTY_EVENTS_SQL, ("events",))


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, GAPPY_EVENTS_SQL, ("events",))


def gappy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, GAPPY_DOCUMENTS_SQL, ("documents",))


# Domain-flavoured tables derived from the driver's tables (same shape of data as
# the reference's finance / logistics / strategy samples). Each entry holds the
# Spark SQL and the DuckDB SQL of the same derivation (date arithmetic differs).
_LEAD_SPARK = "datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))"
_LEAD_DUCK = "datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))"

_FINANZAS = (
    "SELECT o_orderkey AS transaccion_id, o_custkey AS cliente_id, "
    "o_totalprice AS monto_transaccion, c_acctbal AS saldo_cuenta, "
    "c_mktsegment AS segmento_cliente, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS churn "
    "FROM orders JOIN customer ON o_custkey = c_custkey")

_LOGISTICA = (
    "SELECT l_orderkey AS pedido_id, l_linenumber AS linea, l_extendedprice / 100.0 AS distancia_km, "
    "l_quantity AS peso_kg, {lead} AS lead_time_dias, CAST(l_quantity * 10 AS DOUBLE) AS stock_disponible, "
    "lower(r_name) AS ruta, CASE WHEN {lead} > 90 THEN 1 ELSE 0 END AS retraso_entrega "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")

_ESTRATEGIA = (
    "SELECT o_orderkey AS registro_id, o_totalprice AS ventas_trimestre, "
    "c_acctbal AS inversion_marketing, CAST(c_nationkey AS DOUBLE) AS antiguedad_meses, "
    "r_name AS region, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS segmento_alto_valor "
    "FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")

DERIVED = {
    "finanzas": {"spark": _FINANZAS, "duckdb": _FINANZAS},
    "logistica": {"spark": _LOGISTICA.format(lead=_LEAD_SPARK), "duckdb": _LOGISTICA.format(lead=_LEAD_DUCK)},
    "estrategia": {"spark": _ESTRATEGIA, "duckdb": _ESTRATEGIA},
}

# Column type classes of the derived tables (for generated oracle SQL).
DERIVED_COLUMNS = {
    "finanzas": [("transaccion_id", "numeric"), ("cliente_id", "numeric"), ("monto_transaccion", "numeric"),
                 ("saldo_cuenta", "numeric"), ("segmento_cliente", "string"), ("churn", "numeric")],
    "logistica": [("pedido_id", "numeric"), ("linea", "numeric"), ("distancia_km", "numeric"),
                  ("peso_kg", "numeric"), ("lead_time_dias", "numeric"), ("stock_disponible", "numeric"),
                  ("ruta", "string"), ("retraso_entrega", "numeric")],
    "estrategia": [("registro_id", "numeric"), ("ventas_trimestre", "numeric"),
                   ("inversion_marketing", "numeric"), ("antiguedad_meses", "numeric"),
                   ("region", "string"), ("segmento_alto_valor", "numeric")],
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, DERIVED[name]["spark"])


def derived_duck(name: str) -> str:
    return DERIVED[name]["duckdb"]
