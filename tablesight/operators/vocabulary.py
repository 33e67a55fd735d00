"""Fixed vocabulary of the reference (keyword lists, frames, goal labels, weights).

These values must equal the reference's for the same results; they are stated
here as plain data, in their natural order, and turned into small broadcast
DataFrames by ``rules_frame`` / ``goal_labels_frame``. Nothing here computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: target-name keywords (router) --------------------------
TARGET_KEYWORDS = ("target", "label", "class", "objetivo", "resultado", "y",
                   "price", "precio", "churn", "default", "outcome", "sales", "ventas")

# --- fixed values: domain keywords ----------------------------------------
DOMAIN_KEYWORDS = {
    "finanzas": ["cliente", "transaccion", "transacción", "monto", "credito", "crédito",
                 "pago", "factura", "riesgo", "fraude", "saldo", "ingreso", "mora",
                 "default", "churn", "deuda", "cartera", "prestamo", "préstamo"],
    "logistica": ["pedido", "envio", "envío", "entrega", "ruta", "inventario", "stock",
                  "sku", "lead_time", "leadtime", "transporte", "flota", "almacen",
                  "almacén", "retraso", "delay", "distancia", "peso", "volumen"],
    "estrategia": ["segmento", "mercado", "region", "región", "kpi", "ventas", "crecimiento",
                   "canal", "producto", "categoria", "categoría", "cuota", "penetracion",
                   "penetración", "competidor", "marca"],
    "general": [],
}

# --- fixed values: target frames per domain (first frame whose keyword matches) ---
TARGET_FRAMES = {
    "finanzas": [
        ("riesgo de fuga de ingresos", ["churn", "fuga", "cancel", "abandono", "baja"]),
        ("riesgo de incumplimiento crediticio", ["default", "mora", "impago", "atraso"]),
        ("indicador de fraude o anomalia", ["fraude", "anomal"]),
    ],
    "logistica": [
        ("incumplimiento de SLA", ["retraso", "delay", "atraso", "incumpl", "sla"]),
        ("riesgo de quiebre de inventario", ["stock", "inventario", "quiebre", "stockout"]),
    ],
    "estrategia": [
        ("KPI de crecimiento", ["crecimiento", "growth"]),
        ("segmento de alto valor", ["segmento", "valor", "tier"]),
    ],
    "general": [],
}

# --- fixed values: default target phrase per domain -----------------------
TARGET_PHRASE = {
    "finanzas": "indicador de riesgo financiero",
    "logistica": "indicador de cumplimiento de entrega",
    "estrategia": "KPI estrategico",
    "general": "variable objetivo",
}

# --- fixed values: words for rows, gaps and groups per domain --------------
VOCAB = {
    "finanzas": {"row_word": "cliente o transaccion",
                 "null_phrase": "datos faltantes en el historial financiero",
                 "duplicate_phrase": "transacciones registradas mas de una vez",
                 "outlier_phrase": "movimientos con montos atipicos (posibles anomalias)",
                 "target_phrase": "indicador de riesgo financiero",
                 "group_word": "segmento de clientes",
                 "action_word": "politica de credito o retencion"},
    "logistica": {"row_word": "pedido o envio",
                  "null_phrase": "datos faltantes en el registro logistico",
                  "duplicate_phrase": "pedidos registrados mas de una vez",
                  "outlier_phrase": "tiempos o costos fuera de lo normal (posibles cuellos de botella)",
                  "target_phrase": "indicador de cumplimiento de entrega",
                  "group_word": "grupo de rutas o SKUs",
                  "action_word": "politica de inventario o ruteo"},
    "estrategia": {"row_word": "registro de mercado o segmento",
                   "null_phrase": "datos faltantes en la informacion de mercado",
                   "duplicate_phrase": "registros de mercado repetidos",
                   "outlier_phrase": "valores fuera de lo esperado (posibles oportunidades o riesgos)",
                   "target_phrase": "KPI estrategico",
                   "group_word": "segmento estrategico",
                   "action_word": "asignacion de recursos o inversion"},
    "general": {"row_word": "fila",
                "null_phrase": "valores nulos",
                "duplicate_phrase": "filas duplicadas",
                "outlier_phrase": "valores atipicos (outliers)",
                "target_phrase": "variable objetivo",
                "group_word": "grupo",
                "action_word": "accion"},
}

# --- fixed values: column-tag keywords ------------------------------------
MONEY_KEYWORDS = ("monto", "ingreso", "pago", "factura", "saldo", "credito", "crédito",
                  "deuda", "cartera", "prestamo", "préstamo", "transaccion", "transacción",
                  "precio", "venta", "flujo", "caja", "capital")
LAT_KEYWORDS = ("lat", "latitud", "latitude")
LON_KEYWORDS = ("lon", "lng", "longitud", "longitude")
LOCATION_KEYWORDS = ("ciudad", "ruta", "region", "región", "destino", "origen", "zona", "sede",
                     "almacen", "almacén")
STOCK_KEYWORDS = ("stock", "inventario", "existencia", "unidades_disponibles")
DELAY_KEYWORDS = ("retraso", "delay", "incumpl", "sla")

# --- fixed values: business goals -----------------------------------------
GOALS = ("predecir", "segmentar", "decidir", "explorar")
DEFAULT_GOAL = "explorar"
GOAL_LABELS = {
    "finanzas": {"predecir": "Minimizar riesgo crediticio",
                 "segmentar": "Detectar fraude o anomalias",
                 "decidir": "Maximizar retencion de ingresos",
                 "explorar": "Explorar el comportamiento financiero sin objetivo fijo"},
    "logistica": {"predecir": "Reducir tiempos de entrega",
                  "segmentar": "Optimizar niveles de inventario",
                  "decidir": "Minimizar costos de transporte",
                  "explorar": "Explorar la operacion logistica sin objetivo fijo"},
    "estrategia": {"predecir": "Priorizar crecimiento",
                   "segmentar": "Identificar segmentos de alto valor",
                   "decidir": "Optimizar asignacion de recursos",
                   "explorar": "Explorar el panorama estrategico sin objetivo fijo"},
    "general": {"predecir": "Predecir un valor o categoria concreta",
                "segmentar": "Descubrir grupos o segmentos",
                "decidir": "Optimizar una decision o accion",
                "explorar": "Explorar el dataset sin objetivo fijo"},
}
DOMAIN_LABELS = {"finanzas": "Finanzas", "logistica": "Logistica", "estrategia": "Estrategia",
                 "general": "General"}

# --- fixed values: recommender weights (goal x approach) ------------------
APPROACHES = ("supervised", "unsupervised", "reinforcement")
GOAL_WEIGHTS = {
    "predecir": {"supervised": 1.0, "unsupervised": 0.4, "reinforcement": 0.7},
    "segmentar": {"supervised": 0.4, "unsupervised": 1.0, "reinforcement": 0.3},
    "decidir": {"supervised": 0.7, "unsupervised": 0.3, "reinforcement": 1.0},
    "explorar": {"supervised": 0.7, "unsupervised": 0.7, "reinforcement": 0.6},
}
DEFAULT_WEIGHT = 0.5
APPROACH_LABELS = {"supervised": "Aprendizaje supervisado",
                   "unsupervised": "Aprendizaje no supervisado",
                   "reinforcement": "Aprendizaje por refuerzo (bandit)"}


def rules_frame(spark: SparkSession) -> DataFrame:
    """(rule, domain, keyword, priority, frame): every name rule as one small table."""
    rows = []
    for i, k in enumerate(TARGET_KEYWORDS):
        rows.append(("target", None, k, i, None))
    for d, kws in DOMAIN_KEYWORDS.items():
        for i, k in enumerate(kws):
            rows.append(("domain", d, k, i, None))
    for d, frames in TARGET_FRAMES.items():
        for fi, (frame, kws) in enumerate(frames):
            for k in kws:
                rows.append(("frame", d, k, fi, frame))
    for rule, kws in (("money", MONEY_KEYWORDS), ("lat", LAT_KEYWORDS), ("lon", LON_KEYWORDS),
                      ("location", LOCATION_KEYWORDS), ("stock", STOCK_KEYWORDS),
                      ("delay", DELAY_KEYWORDS)):
        for i, k in enumerate(kws):
            rows.append((rule, None, k, i, None))
    return spark.createDataFrame(rows, "rule string, domain string, keyword string, priority int, frame string")


def goal_labels_frame(spark: SparkSession) -> DataFrame:
    rows = [(d, g, GOAL_LABELS[d][g]) for d in GOAL_LABELS for g in GOALS]
    return spark.createDataFrame(rows, "domain string, goal string, goal_label string")


def weights_frame(spark: SparkSession) -> DataFrame:
    rows = [(g, a, GOAL_WEIGHTS[g][a]) for g in GOALS for a in APPROACHES]
    return spark.createDataFrame(rows, "goal string, approach string, weight double")


def vocab_frame(spark):
    """One row per domain with its words (a fixed small table)."""
    keys = list(VOCAB["general"])
    return spark.createDataFrame([(d, *[w[k] for k in keys]) for d, w in VOCAB.items()],
                                 "domain string, " + ", ".join(f"{k} string" for k in keys))
