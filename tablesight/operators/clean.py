"""Cleaning: fit a plan with a few aggregate passes, then apply it lazily.

``CleaningPlan.fit`` runs
  1. the column profile of the raw table (one long pass),
  2. the de-duplication itself (kept for the next passes; its row count gives the
     duplicate count),
  3. one ``agg`` over the de-duplicated table: per column null count,
     adjusted skewness, mean, exact median, deterministic mode,
  4. one ``agg`` of quartiles and clip counts over the imputed table.
Every fitted number lives on the driver as a handful of scalars per column
(bounded by the number of columns, never by rows). ``transform`` is a
``dropDuplicates`` (hash shuffle on all columns with map-side combine) plus a
narrow projection, and an ordered fill only for datetime columns with gaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import adjusted_skew, col, normalize_missing
from ..functions.ordered import fill_forward_backward
from ..functions.quantiles import mode_map, quantile_map
from ..functions.repeats import distinct_rows
from . import texts as X
from .profile import missing_counts, profile_columns, quartile_map

# Fixed values of the reference's cleaning rules.
DROP_PCT = 60.0            # drop a column with at least this % missing
SKEW_FOR_MEDIAN = 1.0      # |adjusted skew| above this => median, else mean
TEXT_FILL = "desconocido"  # constant for free-text columns
IQR_K = 1.5
METHOD_MEAN, METHOD_MEDIAN, METHOD_MODE = "media", "mediana", "moda"
METHOD_FFILL, METHOD_CONST = "ffill", "etiqueta 'desconocido'"


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (nulls equal, NaN equal); whole rows are shuffled only
    where their hash repeats."""
    return distinct_rows(normalize_missing(df))


def drop_sparse_columns(df: DataFrame, threshold_pct: float = DROP_PCT,
                        profile: DataFrame | None = None) -> DataFrame:
    """Drop columns whose missing share is at least ``threshold_pct``."""
    prof = profile if profile is not None else missing_counts(df)
    drop = [r["column_name"] for r in prof.filter(F.col("pct_missing") >= threshold_pct)
            .select("column_name").collect()]
    return df.drop(*drop)


def coerce_numeric(df: DataFrame, column: str, alias: str | None = None,
                   drop_invalid: bool = True) -> DataFrame:
    """``try_cast`` to double; invalid text becomes null and (optionally) the row goes."""
    out = df.withColumn(alias or column, F.expr(f"try_cast({_q(column)} AS DOUBLE)"))
    return out.filter(F.col(_q(alias or column)).isNotNull()) if drop_invalid else out


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class CleaningPlan:
    columns: list[str]
    kinds: dict[str, str]
    pct_missing: dict[str, float]
    n_rows_before: int
    n_duplicates: int
    drop_columns: list[str]
    impute: dict[str, tuple[str, Any]] = field(default_factory=dict)
    skew: dict[str, float] = field(default_factory=dict)
    clip: dict[str, tuple[float, float, int]] = field(default_factory=dict)
    order_by: list[str] | None = None
    text_fill: str = TEXT_FILL
    n_missing_before: int = 0

    # ------------------------------------------------------------------ fit
    @classmethod
    def fit(cls, df: DataFrame, order_by: Sequence[str] | None = None,
            drop_pct: float = DROP_PCT, text_fill: str = TEXT_FILL,
            exclude_from_clip: Sequence[str] = (), quantile_accuracy: int | None = None,
            profile_rsd: float | None = None) -> CleaningPlan:
        """``quantile_accuracy`` / ``profile_rsd`` switch the quartiles and the distinct
        counts of the profile to their approximate forms for very large tables."""
        raw = normalize_missing(df)
        prof = profile_columns(raw, with_samples=False, approx_rsd=profile_rsd).select(
            "column_name", "kind", "pct_missing", "n_missing", "n_non_null").collect()
        kinds = {r["column_name"]: r["kind"] for r in prof}
        pct = {r["column_name"]: float(r["pct_missing"]) for r in prof}
        n_before = int(prof[0]["n_missing"] + prof[0]["n_non_null"]) if prof else 0
        drop = [c for c in raw.columns if pct.get(c, 0.0) >= drop_pct]
        keep = [c for c in raw.columns if c not in drop]
        # De-duplicate on all columns (before dropping any), keep it for the fitting
        # passes; its row count gives the duplicate count without another shuffle.
        dedup = raw.dropDuplicates().select(*[col(c) for c in keep])
        dedup = dedup.persist(StorageLevel.MEMORY_AND_DISK)
        n_dups = n_before - dedup.count()
        plan = cls(columns=list(raw.columns), kinds=kinds, pct_missing=pct,
                   n_rows_before=n_before, n_duplicates=n_dups, drop_columns=drop,
                   order_by=list(order_by) if order_by else None, text_fill=text_fill,
                   n_missing_before=sum(int(r["n_missing"]) for r in prof))
        try:
            plan._fit_impute(dedup, keep)
            imputed = plan._apply_impute(dedup)
            numeric = [c for c in keep if kinds.get(c) == "numeric" and c not in set(exclude_from_clip)]
            plan._fit_clip(imputed, numeric, quantile_accuracy)
        finally:
            dedup.unpersist()
        return plan

    def _fit_impute(self, dedup: DataFrame, keep: list[str]) -> None:
        aggs: list[Column] = []
        for c in keep:
            aggs.append(F.sum(F.when(col(c).isNull(), 1).otherwise(0)).alias(f"{c}__nulls"))
            kind = self.kinds.get(c)
            if kind == "numeric":
                x = col(c).cast("double")
                aggs += [adjusted_skew(x).alias(f"{c}__skew"), F.avg(x).alias(f"{c}__mean")]
        row = dedup.agg(*aggs).first().asDict() if aggs else {}
        gaps = [c for c in keep if row.get(f"{c}__nulls")]
        skewed = [c for c in gaps if self.kinds.get(c) == "numeric" and abs(float(row[f"{c}__skew"] or 0.0)) > SKEW_FOR_MEDIAN]
        medians = quantile_map(dedup, skewed, [0.5])
        modes = mode_map(dedup, [c for c in gaps if self.kinds.get(c) in ("categorical", "boolean")])
        for c in keep:
            if not row.get(f"{c}__nulls"):
                continue
            kind = self.kinds.get(c)
            if kind == "numeric":
                skew = abs(float(row[f"{c}__skew"] or 0.0))
                self.skew[c] = skew
                if skew > SKEW_FOR_MEDIAN:
                    self.impute[c] = (METHOD_MEDIAN, medians[c][0] if c in medians else None)
                else:
                    self.impute[c] = (METHOD_MEAN, row[f"{c}__mean"])
            elif kind in ("categorical", "boolean"):
                if c in modes:
                    self.impute[c] = (METHOD_MODE, modes[c])
            elif kind == "datetime":
                self.impute[c] = (METHOD_FFILL, None)
            else:
                self.impute[c] = (METHOD_CONST, self.text_fill)

    def _fit_clip(self, imputed: DataFrame, numeric: list[str], accuracy: int | None) -> None:
        if not numeric:
            return
        found = quartile_map(imputed, numeric, accuracy)
        bounds = {}
        for c in numeric:
            q = found.get(c)
            if q is None:
                continue
            q1, q3 = float(q[0]), float(q[1])
            iqr = q3 - q1
            if iqr == 0:
                continue
            bounds[c] = (q1 - IQR_K * iqr, q3 + IQR_K * iqr)
        if not bounds:
            return
        counts = imputed.agg(*[
            F.sum(F.when((col(c) < lo) | (col(c) > hi), 1).otherwise(0)).alias(c)
            for c, (lo, hi) in bounds.items()]).first()
        for c, (lo, hi) in bounds.items():
            n = int(counts[c] or 0)
            if n:
                self.clip[c] = (lo, hi, n)

    # ------------------------------------------------------------ transform
    def _impute_expr(self, c: str, dt: T.DataType) -> Column:
        method, value = self.impute[c]
        if method in (METHOD_MEAN, METHOD_MEDIAN):
            return F.coalesce(col(c).cast("double"), F.lit(value).cast("double")).alias(c)
        if method == METHOD_MODE:
            return F.coalesce(col(c), F.lit(value).cast(dt)).alias(c)
        if method == METHOD_CONST:
            return F.coalesce(col(c).cast("string"), F.lit(value)).alias(c)
        return col(c)

    def _apply_impute(self, df: DataFrame) -> DataFrame:
        fields = {f.name: f.dataType for f in df.schema.fields}
        exprs = []
        ffill = []
        for c in df.columns:
            # a string column of dates becomes a timestamp with or without gaps
            dates = self.kinds.get(c) == "datetime" and isinstance(fields[c], T.StringType)
            if c in self.impute and self.impute[c][0] == METHOD_FFILL:
                exprs.append(F.try_to_timestamp(col(c)).alias(c) if dates else col(c))
                ffill.append(c)
            elif dates:
                exprs.append(F.try_to_timestamp(col(c)).alias(c))
            elif c in self.impute:
                exprs.append(self._impute_expr(c, fields[c]))
            else:
                exprs.append(col(c))
        out = df.select(*exprs)
        if ffill:
            if not self.order_by:
                raise ValueError(f"order_by is needed to fill the gaps of {', '.join(ffill)}: rows have no order of their own")
            out = fill_forward_backward(out, ffill, self.order_by)
            out = out.select(*[col(c) for c in df.columns])
        return out

    def _apply_clip(self, df: DataFrame) -> DataFrame:
        if not self.clip:
            return df
        exprs = []
        for c in df.columns:
            if c in self.clip:
                lo, hi, _ = self.clip[c]
                exprs.append(F.least(F.greatest(col(c).cast("double"), F.lit(lo)), F.lit(hi)).alias(c))
            else:
                exprs.append(col(c))
        return df.select(*exprs)

    def transform(self, df: DataFrame, dedupe: bool = True) -> DataFrame:
        out = normalize_missing(df)
        if dedupe:
            out = out.dropDuplicates()
        out = out.drop(*self.drop_columns)
        out = self._apply_impute(out)
        return self._apply_clip(out)

    def transform_stream(self, df: DataFrame) -> DataFrame:
        """Row-local part of the plan (drop, constant imputation, clip) for a stream."""
        out = normalize_missing(df).drop(*self.drop_columns)
        saved = dict(self.impute)
        try:
            self.impute = {c: v for c, v in saved.items() if v[0] != METHOD_FFILL}
            out = self._apply_impute(out)
        finally:
            self.impute = saved
        return self._apply_clip(out)

    # --------------------------------------------------------------- tables
    def plan_table(self, spark) -> DataFrame:
        """One row per planned action (step, column, action, num_value, str_value)."""
        rows = []
        step = 0
        for c in self.columns:
            if self.pct_missing.get(c, 0) <= 0 or c in self.drop_columns:
                continue
            kind = self.kinds.get(c)
            if c in self.impute:
                method, value = self.impute[c]
                num = float(value) if method in (METHOD_MEAN, METHOD_MEDIAN) and value is not None else None
                sval = None if num is not None or value is None else str(value)
                rows.append((step, c, kind, method, num, sval))
            else:
                rows.append((step, c, kind, "sin nulos tras deduplicar", None, None))
            step += 1
        for c in self.drop_columns:
            rows.append((step, c, self.kinds.get(c), "eliminar columna", self.pct_missing[c], None))
            step += 1
        rows.append((step, None, None, "eliminar duplicados", float(self.n_duplicates), None))
        step += 1
        for c in self.columns:
            if c in self.clip:
                rows.append((step, c, "numeric", "winsorizar", float(self.clip[c][2]), None))
                step += 1
        return spark.createDataFrame(
            rows, "step int, column_name string, kind string, action string, num_value double, str_value string")

    def report_table(self, spark, cleaned: DataFrame) -> DataFrame:
        """Long (section, key, num_value, str_value) report before/after cleaning."""
        from .profile import overview
        after = overview(cleaned).first()
        rows = [
            ("overview_before", "n_rows", float(self.n_rows_before), None),
            ("overview_before", "n_cols", float(len(self.columns)), None),
            ("overview_before", "n_duplicates", float(self.n_duplicates), None),
            ("overview_before", "total_missing", float(self.n_missing_before), None),
            ("overview_after", "n_rows", float(after["n_rows"]), None),
            ("overview_after", "n_cols", float(after["n_cols"]), None),
            ("overview_after", "n_duplicates", float(after["n_duplicates"]), None),
            ("overview_after", "total_missing", float(after["total_missing"]), None),
            ("duplicates_removed", "rows", float(self.n_rows_before - after["n_rows"]), None),
        ]
        for c in self.columns:
            if c in self.impute:
                rows.append(("imputed", c, None, self.impute[c][0]))
            if c in self.clip:
                rows.append(("winsorized", c, float(self.clip[c][2]), None))
            if c in self.drop_columns:
                rows.append(("dropped_columns", c, self.pct_missing[c], None))
        return spark.createDataFrame(rows, "section string, key string, num_value double, str_value string")


def cleaning_sentences(facts: DataFrame, words: DataFrame) -> DataFrame:
    """The sentences before and after cleaning in the words of each domain. ``facts`` has
    one row (``n_rows, n_cols, n_duplicates, total_missing, total_outliers, n_rows_after,
    n_cols_after, n_imputed, n_clipped, total_missing_after``), ``words`` one row per domain."""
    both = words.crossJoin(F.broadcast(facts))  # one row of facts
    numbers = ("n_rows", "n_cols", "n_duplicates", "total_missing", "total_outliers", "n_rows_after", "n_cols_after", "n_imputed", "n_clipped")
    values = {**{c: F.col(c).cast("long").cast("string") for c in numbers}, **{c: F.col(c) for c in words.columns if c != "domain"},
              "none_missing": F.when(F.col("total_missing_after") == 0, "True").otherwise("False")}
    return both.select("domain", X.fill(X.CLEAN_BEFORE, values).alias("before"), X.fill(X.CLEAN_AFTER, values).alias("after"))


def clean_table(df: DataFrame, order_by: Sequence[str] | None = None, **kw) -> tuple[DataFrame, CleaningPlan]:
    """C11: fit the plan on ``df`` and return (cleaned DataFrame, plan)."""
    plan = CleaningPlan.fit(df, order_by=order_by, **kw)
    return plan.transform(df), plan
