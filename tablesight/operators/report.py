"""Report facts (J1-J7): target statistics, distributions, class balance, the long
facts table, one key-finding sentence per group, report templates and a JSON
validator - all grouped aggregates and string expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, fixed_text
from ..functions.frequent import frequent_values
from ..functions.quantiles import group_quantiles, quantile_map

TOP_VALUES = 6
REPORT_KEYS = ("titulo", "resumen_situacion", "hallazgo_clave", "recomendaciones", "siguiente_paso_sugerido")
REC_FIELDS = ("titulo", "descripcion", "impacto_esperado", "riesgo_o_consideracion")
N_RECS = 3


def target_stats(df: DataFrame, target: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, min, max of a continuous target, rounded to 2."""
    x = col(target).cast("double")
    g = list(group_by)
    rest = [F.round(F.avg(x), 2).alias("media"), F.round(F.min(x), 2).alias("min"), F.round(F.max(x), 2).alias("max"),
            F.count(F.lit(1)).cast("long").alias("n_rows")]
    if g:
        stats = group_quantiles(df, [target], [0.5], g, rest).withColumn("mediana", F.col("__q0")[0])
    else:
        found = quantile_map(df, [target], [0.5]).get(target)
        stats = df.agg(*rest).withColumn("mediana", F.lit(found[0] if found else None).cast("double"))
    return stats.select(*g, "media", F.round("mediana", 2).alias("mediana"), "min", "max", "n_rows")


def _counts(df: DataFrame, target: str, group_by: Sequence[str]) -> DataFrame:
    """(group..., value, n, pct): value counts and their share of the group's non-null
    values. Totals come from a grouped aggregate (a scalar when ungrouped), not from a
    window over all distinct values."""
    g = list(group_by)
    c = df.filter(col(target).isNotNull()).groupBy(*[col(x) for x in g],
                                                   col(target).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    if g:
        c = c.join(c.groupBy(*g).agg(F.sum("n").alias("__tot")), g)
    else:
        c = c.withColumn("__tot", F.lit(c.agg(F.sum("n")).first()[0]))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.col("__tot"), 1)).drop("__tot")


def target_distribution(df: DataFrame, target: str, group_by: Sequence[str] = (), k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values with count and % of the non-null values
    (``row_number() <= k``: Spark keeps at most k rows per group in each map task). Of a whole
    table only the candidates of a sketch are counted (``functions.frequent``)."""
    if not group_by:
        top, total = frequent_values(df, col(target), k)
        w = Window.orderBy(F.col("n").desc(), F.col("value"))  # k rows
        return top.select("value", F.col("n").cast("long").alias("n"), F.round(F.col("n") * 100.0 / F.lit(total), 1).alias("pct"),
                          F.row_number().over(w).cast("long").alias("rank"))
    w = Window.partitionBy(*[col(x) for x in group_by]).orderBy(F.col("n").desc(), F.col("value"))
    return (_counts(df, target, group_by).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(*group_by, "value", F.col("n").cast("long"), "pct", F.col("rank").cast("long")))


def class_balance(df: DataFrame, target: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Majority and minority class (smallest value on count ties) with their %."""
    c = _counts(df, target, group_by)
    return c.groupBy(*group_by).agg(
        F.min_by(F.struct("value", "pct"), F.struct(-F.col("n"), F.col("value"))).alias("may"),
        F.min_by(F.struct("value", "pct"), F.struct(F.col("n"), F.col("value"))).alias("mino")).select(
        *group_by, F.col("may.value").alias("majority"), F.col("may.pct").alias("majority_pct"),
        F.col("mino.value").alias("minority"), F.col("mino.pct").alias("minority_pct"))


def facts_long(df: DataFrame, section: str, keys: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """J4 helper: wide facts -> long (group..., section, key, num_value, str_value)."""
    types = dict(df.dtypes)
    cells = []
    for k in keys:
        num = types[k] not in ("string",)
        cells.append(F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"),
                              (col(k).cast("double") if num else F.lit(None).cast("double")).alias("num_value"),
                              (F.lit(None).cast("string") if num else col(k)).alias("str_value")))
    return df.select(*[col(g) for g in group_by], F.inline(F.array(*cells)))


def _fmt_target(target: str) -> str:
    return target.replace("_", " ")


def _num_text(c: Column) -> Column:
    """A double rounded to 2 as Python prints it: 33.2, 50.0, 12345678.5, never with an exponent
    below 1e16."""
    plain = F.regexp_replace(fixed_text(c.cast("double"), 2), r"0$", "")
    return F.when(F.abs(c) < 1e16, plain).otherwise(c.cast("double").cast("string"))


def findings(balance: DataFrame | None, stats: DataFrame | None, target: str, frame: str | None,
             n_rows: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """The key-finding sentence per group (categorical, continuous or neutral form)."""
    from . import texts as X
    base = {"target": F.lit(_fmt_target(target)),
            "frame_note": F.lit(X.FRAME_NOTE.replace("{frame}", frame) if frame else ""),
            "n_rows": F.col("n_rows").cast("string")}
    if balance is not None:
        b = n_rows.join(balance, list(group_by), "left")
        v = {**base, "majority": F.col("majority"), "majority_pct": _num_text(F.col("majority_pct")),
             "minority": F.col("minority"), "minority_pct": _num_text(F.col("minority_pct"))}
        cat = F.concat(X.fill(X.FINDING_CATEGORICAL, v),
                       F.when(F.col("minority") != F.col("majority"), X.fill(X.FINDING_MINORITY, v))
                       .otherwise(F.lit("")))
        return b.select(*group_by, F.when(F.col("majority").isNotNull(), cat)
                        .otherwise(X.fill(X.FINDING_NEUTRAL, base)).alias("finding"))
    s = n_rows.join(stats.drop("n_rows"), list(group_by), "left")
    v = {**base, **{k: _num_text(F.col(k)) for k in ("media", "mediana", "min", "max")}}
    return s.select(*group_by, X.fill(X.FINDING_CONTINUOUS, v).alias("finding"))


_REC = T.StructType([T.StructField(f, T.StringType()) for f in REC_FIELDS])
REPORT_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in REPORT_KEYS if k != "recomendaciones"]
    + [T.StructField("recomendaciones", T.ArrayType(_REC))])


def validate_report_json(c: Column) -> Column:
    """The five keys are present, exactly three recommendations, each with the four
    fields. Parsed with an explicit schema (no inference), JVM only."""
    keys_ok = F.lit(True)
    keys = F.json_object_keys(c)
    for k in REPORT_KEYS:
        keys_ok = keys_ok & F.coalesce(F.array_contains(keys, F.lit(k)), F.lit(False))
    recs_raw = F.from_json(F.get_json_object(c, "$.recomendaciones"),
                           T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    recs_ok = (F.size(recs_raw) == N_RECS) & F.forall(recs_raw, lambda r: _has_fields(r))
    return F.coalesce(keys_ok & recs_ok, F.lit(False))


def _has_fields(r: Column) -> Column:
    ok = r.isNotNull()
    for f in REC_FIELDS:
        ok = ok & F.map_contains_key(r, F.lit(f))
    return ok
