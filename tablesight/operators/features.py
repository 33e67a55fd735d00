"""Feature engineering (E1-E15): a fitted encoder that turns a table into numeric
feature columns (and an MLlib vector), plus target encoders and scalers.

Fitting is two aggregate passes: (1) means of numeric columns, null flags and
approximate (HyperLogLog) distinct counts of string columns, which screen out
columns far above the one-hot limit without expanding rows; (2) exact distinct
values of the remaining candidates only - so what reaches the driver is bounded
by a few times ``max_ohe`` per column. Transform is a single narrow projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_datetime, is_numeric, normalize_missing
from ..functions.quantiles import quantile_map

MAX_OHE = 15
SCREEN_FACTOR = 4  # approximate-count screen: exact check only below 4 x MAX_OHE
NO_FEATURES = "(sin_features)"
NAN_CATEGORY = "nan"
DISCRETE_MAX_UNIQUE = 20
DISCRETE_MIN_CAP = 10
DISCRETE_SHARE = 0.05
BIN_LABELS = ("bajo", "medio", "alto")
BROADCAST_LABELS_MAX = 10_000


def sanitize(c: Column) -> Column:
    """NaN and +/-inf become 0."""
    x = c.cast("double")
    bad = F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


@dataclass
class FeatureEncoder:
    inputs: list[tuple[str, str]] = field(default_factory=list)   # (column, role)
    means: dict[str, float | None] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    feature_names: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, exclude: Sequence[str] = (), max_ohe: int = MAX_OHE) -> FeatureEncoder:
        df = normalize_missing(df)
        excl = set(exclude)
        enc = cls()
        num, strs = [], []
        for f in df.schema.fields:
            if f.name in excl:
                continue
            if isinstance(f.dataType, T.BooleanType):
                enc.inputs.append((f.name, "bool"))
            elif is_numeric(f.dataType):
                enc.inputs.append((f.name, "numeric"))
                num.append(f.name)
            elif is_datetime(f.dataType):
                enc.inputs.append((f.name, "datetime"))
            elif isinstance(f.dataType, T.StringType):
                enc.inputs.append((f.name, "string"))
                strs.append(f.name)
        # Pass 1: means, null flags and an approximate distinct count (HyperLogLog, no
        # row expansion) that screens out columns far above the one-hot limit.
        aggs = [F.avg(col(c).cast("double")).alias(f"m__{c}") for c in num]
        aggs += [F.approx_count_distinct(col(c)).alias(f"d__{c}") for c in strs]
        aggs += [F.max(F.when(col(c).isNull(), 1).otherwise(0)).alias(f"n__{c}") for c in strs]
        row = df.agg(*aggs).first().asDict() if aggs else {}
        for c in num:
            enc.means[c] = row[f"m__{c}"]
        cands = [c for c in strs if row[f"d__{c}"] <= SCREEN_FACTOR * max_ohe]
        if cands:
            # Pass 2: exact distinct values of the candidates only; each set is bounded
            # (a few times max_ohe values), so this is what reaches the driver.
            vals = df.agg(*[F.collect_set(col(c)).alias(c) for c in cands]).first()
            for c in cands:
                distinct = sorted({str(v) for v in vals[c]})
                if not 1 < len(distinct) <= max_ohe:
                    continue
                if row[f"n__{c}"]:
                    distinct = sorted(set(distinct) | {NAN_CATEGORY})
                enc.categories[c] = distinct
        for c, role in enc.inputs:
            if role in ("bool", "numeric"):
                enc.feature_names.append(c)
            elif role == "datetime":
                enc.feature_names += [f"{c}_anio", f"{c}_mes", f"{c}_dia"]
            elif c in enc.categories:
                enc.feature_names += [f"{c}_{v}" for v in enc.categories[c]]
        return enc

    def feature_exprs(self, df: DataFrame) -> list[Column]:
        present = set(df.columns)
        exprs: list[Column] = []
        for c, role in self.inputs:
            if role == "bool":
                e = [col(c).cast("int").cast("double").alias(c)] if c in present else [F.lit(0.0).alias(c)]
            elif role == "numeric":
                m = self.means.get(c)
                e = [F.coalesce(col(c).cast("double"), F.lit(m).cast("double")).alias(c)] if c in present \
                    else [F.lit(0.0).alias(c)]
            elif role == "datetime":
                if c in present:
                    e = [F.coalesce(F.year(col(c)), F.lit(0)).cast("double").alias(f"{c}_anio"),
                         F.coalesce(F.month(col(c)), F.lit(0)).cast("double").alias(f"{c}_mes"),
                         F.coalesce(F.dayofmonth(col(c)), F.lit(0)).cast("double").alias(f"{c}_dia")]
                else:
                    e = [F.lit(0.0).alias(f"{c}_{s}") for s in ("anio", "mes", "dia")]
            elif c in self.categories:
                s = F.coalesce(col(c).cast("string"), F.lit(NAN_CATEGORY)) if c in present else None
                e = [((s == F.lit(v)).cast("double") if s is not None else F.lit(0.0)).alias(f"{c}_{v}")
                     for v in self.categories[c]]
            else:
                e = []
            exprs += e
        return [sanitize(x).alias(n) for x, n in zip(exprs, self.feature_names)]

    def transform(self, df: DataFrame, keep: Sequence[str] = (), vector_col: str | None = None) -> DataFrame:
        """Feature columns (named as ``feature_names``), plus ``keep`` columns; unknown
        input columns are ignored and missing ones give 0 (E15)."""
        df = normalize_missing(df)
        feats = self.feature_exprs(df)
        names = list(self.feature_names)
        if not feats:
            feats, names = [F.lit(0.0).alias(NO_FEATURES)], [NO_FEATURES]
        out = df.select(*[col(k) for k in keep], *feats)
        if vector_col:
            out = VectorAssembler(inputCols=names, outputCol=vector_col, handleInvalid="keep").transform(out)
        return out

    def names(self) -> list[str]:
        return list(self.feature_names) or [NO_FEATURES]


def is_discrete(n_unique: int, n_rows: int) -> bool:
    return n_unique <= max(DISCRETE_MIN_CAP, int(DISCRETE_SHARE * n_rows)) and n_unique <= DISCRETE_MAX_UNIQUE


@dataclass
class TargetEncoding:
    kind: str                       # "continuous" or "discrete"
    labels: list | None = None      # sorted distinct labels (discrete)
    fill: float | None = None       # mean (continuous) or majority code (discrete)


def fit_target(df: DataFrame, target: str) -> TargetEncoding:
    """Continuous numeric target -> mean fill; else codes of sorted labels with the
    majority class (lowest code on ties) for missing labels."""
    df = normalize_missing(df)
    dt = df.schema[target].dataType
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(target)).alias("d"),
                   F.avg(col(target).cast("double")).alias("m") if is_numeric(dt) else F.lit(None).alias("m")
                   ).first()
    if is_numeric(dt) and not is_discrete(stats["d"], stats["n"]):
        return TargetEncoding("continuous", None, stats["m"])
    counts = df.filter(col(target).isNotNull()).groupBy(col(target).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # one row per class, as many as a classifier keeps anyway
    labels = sorted((r["label"] for r in rows), key=lambda v: (v is None, v))
    code = {v: i for i, v in enumerate(labels)}
    best = max(rows, key=lambda r: (r["n"], -code[r["label"]])) if rows else None
    return TargetEncoding("discrete", labels, float(code[best["label"]]) if best else 0.0)


def encode_target(df: DataFrame, target: str, enc: TargetEncoding, out: str = "label") -> DataFrame:
    """Adds ``out`` (double): filled continuous value or the class code."""
    if enc.kind == "continuous":
        return df.withColumn(out, F.coalesce(col(target).cast("double"), F.lit(enc.fill).cast("double")))
    spark = df.sparkSession
    dt = df.schema[target].dataType
    lab = spark.createDataFrame([(v, float(i)) for i, v in enumerate(enc.labels)],
                                T.StructType([T.StructField("__lab", dt), T.StructField("__code", T.DoubleType())]))
    lab = F.broadcast(lab) if len(enc.labels) <= BROADCAST_LABELS_MAX else lab
    j = df.join(lab, col(target) == F.col("__lab"), "left")
    return j.withColumn(out, F.coalesce(F.col("__code"), F.lit(enc.fill))).drop("__lab", "__code")


def quantile_bins(df: DataFrame, column: str, n_bins: int = 3, out: str = "bin",
                  accuracy: int | None = None) -> DataFrame:
    """Bins at the linear quantiles 1/n..(n-1)/n; bin i holds edge_i <= y < edge_{i+1}."""
    probs = [i / n_bins for i in range(1, n_bins)]
    x = col(column).cast("double")
    if accuracy is None:
        edges = quantile_map(df, [column], probs).get(column, [])
    else:
        edges = df.agg(F.percentile_approx(x, probs, accuracy).alias("e")).first()["e"] or []
    b = F.lit(0)
    for e in edges:
        b = b + F.when(x >= F.lit(float(e)), 1).otherwise(0)
    names = list(BIN_LABELS) if n_bins <= 3 else [f"rango {i + 1}" for i in range(n_bins)]
    lab = F.element_at(F.array(*[F.lit(n) for n in names[:n_bins]]), b + 1)
    return df.withColumn(out, b).withColumn(out + "_label", lab)


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "",
                stats: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict]:
    """(x - mean) / population std; a zero std scales by 1 (sklearn's rule).
    Returns the frame and the fitted (mean, std) per column for reuse on other data."""
    if stats is None:
        row = df.agg(*[x for c in columns for x in (
            F.avg(col(c).cast("double")).alias(f"m__{c}"),
            F.stddev_pop(col(c).cast("double")).alias(f"s__{c}"))]).first()
        stats = {c: (row[f"m__{c}"], row[f"s__{c}"]) for c in columns}
    out = df
    for c in columns:
        m, s = stats[c]
        scale = s if s not in (None, 0.0) else 1.0
        out = out.withColumn(c + suffix, (col(c).cast("double") - F.lit(m)) / F.lit(scale))
    return out, stats
