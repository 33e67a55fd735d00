"""Sentence formats of the reference and the helper that fills them.

Fixed values of the reference: every text format below must read exactly as the
reference's so that generated text matches; placeholders are ``{name}``. They
are data - ``fill`` turns a format into a Spark ``concat`` of literal pieces and
column values (values are never searched for placeholders).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: key finding (J5) ---------------------------------------
FRAME_NOTE = " (marco de referencia: {frame})"
FINDING_CATEGORICAL = ("En '{target}'{frame_note}, el valor mas frecuente es '{majority}' con {majority_pct}% "
                       "de los {n_rows} registros analizados.")
FINDING_MINORITY = (" El grupo menos representado ('{minority}') concentra solo {minority_pct}%, lo que marca "
                    "un desbalance a vigilar.")
FINDING_CONTINUOUS = ("En '{target}'{frame_note}, el valor promedio es {media} (mediana {mediana}), con un rango "
                      "que va de {min} a {max} en los {n_rows} registros analizados.")
FINDING_NEUTRAL = ("Se analizaron {n_rows} registros sobre '{target}'{frame_note}; los datos quedaron completos y "
                   "listos para decidir.")

# --- fixed values: cleaning sentences (C10) -------------------------------
CLEAN_BEFORE = ("El dataset tiene {n_rows} registros de {row_word} y {n_cols} columnas. Detecte {n_duplicates} "
                "{duplicate_phrase}, {total_missing} {null_phrase} en total y {total_outliers} {outlier_phrase} en "
                "columnas numericas.")
CLEAN_AFTER = ("Dataset limpio: {n_rows_after} registros de {row_word} x {n_cols_after} columnas. Elimine {n_duplicates} "
               "{duplicate_phrase}, impute {n_imputed} columnas y trate {outlier_phrase} en {n_clipped} columnas. "
               "Ya no quedan {null_phrase}: {none_missing}.")

# --- fixed values: cluster traits (G9) -------------------------------------
CLUSTER_TRAIT = "Cluster {cluster}: {column_name} {direction}"

# --- fixed values: report (J6) --------------------------------------------
REPORT_TITLE = "Reporte Ejecutivo: Analisis de {target_title}"
REPORT_SUMMARY = ("Se analizo{domain_clause} un universo de {n_rows} registros con {n_cols} variables, enfocado en "
                  "'{target}'. El objetivo de negocio planteado fue: {goal_label}. El analisis apunta a un enfoque "
                  "de {winner_label}.")
DOMAIN_CLAUSE = " desde una perspectiva de {domain_label}"
REPORT_NEXT_STEP = ("Aprobar un piloto acotado alineado a '{target}' y asignar un responsable para ejecutar la "
                    "primera recomendacion en el proximo ciclo.")
IMPACT_CLASSIFICATION = ("Anticipar casos de '{target}' con {perf} permite actuar antes de que ocurran, en lugar de "
                         "reaccionar tarde.")
PERF_CLASSIFICATION = "{acc}% de aciertos"
PERF_CLASSIFICATION_NONE = "un desempeno solido"
IMPACT_REGRESSION = "Estimar '{target}' por adelantado {perf} da margen para planificar con datos y no por intuicion."
PERF_REGRESSION = "explicando el {r2}% de la variacion"
PERF_REGRESSION_NONE = "con buena precision"
PERF_BANDIT = "acierta {fr}% de las decisiones frente a {base}% al azar"
PERF_BANDIT_NONE = "supera a la decision al azar"
DISTINCTIVE = " Rasgos que distinguen los grupos: {distinctive}."
REPORT_RECOMMENDATIONS = {
    "supervised": [
        ("Anticiparse usando '{target}' como senal temprana",
         "Incorporar la estimacion de '{target}' al proceso de decision para priorizar los casos antes de que "
         "se materialicen.",
         "{impacto_supervisado}",
         "La estimacion se basa en los datos historicos disponibles; conviene revalidarla al cambiar el contexto."),
        ("Focalizar recursos en '{top}'",
         "'{top}' es el factor que mas incide en '{target}'. Concentrar esfuerzo y presupuesto donde este factor "
         "pesa mas.",
         "Mayor retorno por cada peso invertido al actuar sobre la palanca de mayor efecto en lugar de repartir "
         "sin foco.",
         "Correlacion no implica causa: conviene confirmar la relacion con una prueba controlada antes de escalar."),
        ("Institucionalizar el seguimiento del indicador",
         "Definir un tablero mensual de '{target}' y sus factores clave, con responsables y umbrales de alerta.",
         "Deteccion temprana de desvios y decisiones mas rapidas, sostenidas en el tiempo.",
         "Requiere datos frescos y de calidad de forma recurrente; sin eso, el seguimiento pierde valor."),
    ],
    "unsupervised": [
        ("Adoptar una estrategia segmentada en {k} grupos",
         "Los datos revelan {k} segmentos naturales con perfiles distintos. Disenar propuestas diferenciadas "
         "para cada uno.",
         "Mensajes y ofertas mas relevantes por segmento, con mejor conversion que un enfoque unico para todos.",
         "Los segmentos describen patrones actuales; conviene revisarlos periodicamente porque pueden evolucionar."),
        ("Priorizar el segmento de mayor valor",
         "Identificar cual de los grupos aporta mas valor de negocio y asignarle atencion preferente.{rasgos}",
         "Uso mas eficiente de recursos comerciales al concentrarlos donde el retorno es mayor.",
         "Definir 'valor' con criterio de negocio explicito para no sesgar la priorizacion."),
        ("Validar los segmentos con las areas operativas",
         "Contrastar los grupos hallados con el conocimiento de ventas y operaciones antes de accionarlos.",
         "Segmentacion accionable y creible internamente, con mayor adopcion por los equipos.",
         "Si un grupo no tiene interpretacion de negocio clara, no conviene forzar acciones sobre el."),
    ],
    "reinforcement": [
        ("Pilotar una politica de decision guiada por datos",
         "Probar en un piloto acotado una regla que elija la mejor accion sobre '{target}' segun el perfil de "
         "cada caso.",
         "La estrategia {perf_refuerzo}, lo que sugiere margen real de mejora frente a decidir sin datos.",
         "Es una simulacion sobre datos historicos, no un entorno real; el piloto debe confirmar el resultado "
         "en vivo."),
        ("Medir el impacto con un grupo de control",
         "Ejecutar el piloto contra un grupo de control para aislar el efecto real de la nueva politica de "
         "decision.",
         "Evidencia solida del beneficio incremental antes de invertir en un despliegue amplio.",
         "Requiere disciplina en la medicion; sin control, la mejora observada puede deberse a otros factores."),
        ("Escalar por etapas segun resultados",
         "Ampliar la politica solo si el piloto confirma la mejora, avanzando por fases controladas.",
         "Captura del beneficio limitando el riesgo de un despliegue prematuro.",
         "Definir de antemano los criterios de exito que habilitan pasar de una etapa a la siguiente."),
    ],
}

# --- fixed values: grounded answers (K6) ------------------------------------
ANSWERS = {
    "recomendacion": ("Segun el Agente Recomendador, el enfoque que conviene seguir es {enfoque_ganador} "
                      "({detalle_ganador}), para tu objetivo de {objetivo_de_negocio}."),
    "variable": "Segun el Agente Supervisado, la variable que mas influye es '{variable_mas_importante}', usando "
                "el modelo {mejor_modelo}.",
    "filas": "Segun el Agente ETL, el dataset limpio tiene {filas} filas y {columnas} columnas.",
    "clusters": "Segun el Agente No Supervisado, se encontraron {numero_de_clusters} grupos, con un silhouette "
                "de {silhouette}.",
    "refuerzo": "Segun el Agente de Refuerzo, la politica aprendida acierta {acierto_final}% de las veces, frente "
                "a {acierto_al_azar}% de elegir al azar.",
    "siguiente_paso": "Segun el Reporte Ejecutivo, el siguiente paso sugerido es: {siguiente_paso}",
    "hallazgo": "Segun el Reporte Ejecutivo, el hallazgo clave es: {hallazgo_clave}",
}
ANSWER_DEFAULT = ("No tengo un dato exacto para esa pregunta en lo que ya calculamos. Intenta preguntar, por "
                  "ejemplo, 'cual fue el mejor modelo' o 'que variable importa mas'.")

# --- fixed values: portfolio summary (N9) and ranking (I4) ------------------
BCG_LINE = "Cluster {cluster} ({size} registros) es '{label}': {x_name}={x}, {y_name}={y}."
RANKING_PIECE = "{label}: calidad {score} x peso {weight} = {final}"

_TOKEN = re.compile(r"\{([a-z_]+)\}")


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by ``values[name]`` (null -> empty)."""
    pieces: list[Column] = []
    pos = 0
    for m in _TOKEN.finditer(template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(F.coalesce(values[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces) if pieces else F.lit("")
