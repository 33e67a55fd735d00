"""Checked queries for supervised learning and metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import metrics as M
from ..operators import supervised as S
from ..operators.boosting import SoftmaxBoosting
from ..operators.features import encode_target, fit_target
from .registry import register
from .tables import load, sql

# A predictions table derived from events: actual event type vs a value-band rule.
_PRED_SQL = ("SELECT event_id, event_type AS y, CASE WHEN value < 100 THEN 'click' WHEN value < 200 THEN 'view' "
             "WHEN value < 300 THEN 'purchase' ELSE 'error' END AS p FROM events")
_AUC_SQL = "SELECT l.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@register("classification_metrics", f"""
WITH pr AS ({_PRED_SQL}), pc AS (SELECT y, p, count(*) AS n FROM pr GROUP BY y, p),
cls AS (SELECT y AS c FROM pc UNION SELECT p FROM pc),
st AS (SELECT c, coalesce((SELECT sum(n) FROM pc WHERE y = c AND p = c), 0) AS tp,
              coalesce((SELECT sum(n) FROM pc WHERE p = c AND y <> c), 0) AS fp,
              coalesce((SELECT sum(n) FROM pc WHERE y = c AND p <> c), 0) AS fn FROM cls)
SELECT CAST((SELECT sum(n) FROM pc) AS BIGINT) AS n,
       round((SELECT sum(n) FROM pc WHERE y = p) / (SELECT sum(n) FROM pc), 6) AS accuracy,
       round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1_macro
FROM st""")
def q_classification_metrics(spark, sf):
    return round_doubles(M.classification_metrics(sql(spark, sf, _PRED_SQL, ("events",)), "y", "p"))


@register("confusion_matrix", f"""
WITH pr AS ({_PRED_SQL}), pc AS (SELECT y, p, count(*) AS n FROM pr GROUP BY y, p),
cls AS (SELECT y AS c FROM pc UNION SELECT p FROM pc)
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(pc.n, 0) AS BIGINT) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN pc ON pc.y = a.c AND pc.p = b.c""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(sql(spark, sf, _PRED_SQL, ("events",)), "y", "p")


@register("roc_auc", f"""
WITH d AS ({_AUC_SQL}),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM d)
SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
       round((sum(CASE WHEN y = 1 THEN ar ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
             / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def q_roc_auc(spark, sf):
    return round_doubles(M.roc_auc(sql(spark, sf, _AUC_SQL, ("labels", "documents")), "y", "s"))


@register("ols_simple", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag""")
def q_ols_simple(spark, sf):
    li = load(spark, sf, "lineitem")
    return round_doubles(li.groupBy("l_returnflag").agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("slope"),
        F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"),
        F.regr_r2("l_extendedprice", "l_quantity").alias("r2"),
        F.count(F.lit(1)).cast("long").alias("n")))


def _ols_predictions(li, x: str, y: str = "l_extendedprice"):
    coef = li.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")).first()
    return li.withColumn("pred", F.lit(coef["a"]) + F.lit(coef["b"]) * F.col(x))


def _ols_sql(x: str) -> str:
    return (f"(SELECT l_orderkey, l_linenumber, l_extendedprice AS y, a + b * {x} AS pred FROM lineitem, "
            f"(SELECT regr_slope(l_extendedprice, {x}) AS b, regr_intercept(l_extendedprice, {x}) AS a FROM lineitem))")


def _reg_metrics_sql(src: str) -> str:
    return (f"SELECT CAST(count(*) AS BIGINT) AS n, "
            f"round(1 - sum((y - pred) * (y - pred)) / sum((y - m) * (y - m)), 6) AS r2, "
            f"round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse "
            f"FROM {src} t, (SELECT avg(l_extendedprice) AS m FROM lineitem)")


@register("regression_metrics", _reg_metrics_sql(_ols_sql("l_quantity")))
def q_regression_metrics(spark, sf):
    pred = _ols_predictions(load(spark, sf, "lineitem"), "l_quantity")
    return round_doubles(M.regression_metrics(pred, "l_extendedprice", "pred"))


@register("actual_vs_predicted", f"""
WITH p AS {_ols_sql('l_quantity')}
SELECT l_orderkey, l_linenumber, round(y, 6) AS actual, round(pred, 6) AS predicted,
       round((SELECT least(min(y), min(pred)) FROM p), 6) AS line_lo,
       round((SELECT greatest(max(y), max(pred)) FROM p), 6) AS line_hi FROM p""")
def q_actual_vs_predicted(spark, sf):
    pred = _ols_predictions(load(spark, sf, "lineitem"), "l_quantity")
    return round_doubles(M.actual_vs_predicted(pred, "l_extendedprice", "pred", keep=["l_orderkey", "l_linenumber"]))


@register("stratified_split", """
WITH d AS (SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR) || ':42') AS h FROM events),
s AS (SELECT event_type, count(*) AS n FROM d GROUP BY event_type)
SELECT event_id, row_number() OVER (PARTITION BY d.event_type ORDER BY h) <= round(s.n * 0.25) AS is_test
FROM d JOIN s ON d.event_type = s.event_type""")
def q_stratified_split(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "event_type")
    return S.stratified_split(ev, "event_type", "event_id").select("event_id", "is_test")


_CANDS = [("ols_quantity", "l_quantity"), ("ols_discount", "l_discount"), ("ols_tax", "l_tax")]


def _comparison(spark, sf):
    li = load(spark, sf, "lineitem")
    parts = []
    for i, (name, x) in enumerate(_CANDS):
        m = M.regression_metrics(_ols_predictions(li, x), "l_extendedprice", "pred")
        parts.append(m.select(F.lit(name).alias("model"), F.lit(i).alias("ordinal"),
                              *[F.round(c, 4).alias(c) for c in ("r2", "mae", "rmse")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CMP_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS model, {i} AS ordinal, round(r2, 4) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse "
    f"FROM ({_reg_metrics_sql(_ols_sql(x))})" for i, (n, x) in enumerate(_CANDS))


@register("model_comparison", _CMP_SQL)
def q_model_comparison(spark, sf):
    return _comparison(spark, sf)


@register("best_model", f"SELECT model, r2 FROM ({_CMP_SQL}) ORDER BY r2 DESC, ordinal LIMIT 1")
def q_best_model(spark, sf):
    return S.best_by_score(_comparison(spark, sf), "r2").select("model", "r2")


_IMP_FROM = ("lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
             "JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
_IMP_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "o_totalprice",
              "o_custkey", "c_acctbal", "c_nationkey", "p_size", "p_retailprice", "s_acctbal", "s_nationkey"]
_IMP_SQL = ("WITH c AS (SELECT " + ", ".join(
    f"abs(corr(CAST({f} AS DOUBLE), l_extendedprice)) AS {f}" for f in _IMP_FEATS) + f" FROM {_IMP_FROM}), "
    "u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM c" for f in _IMP_FEATS) + "), "
    "imp AS (SELECT feature, v / (SELECT sum(v) FROM u) AS importance FROM u) ")


def _importance(spark, sf):
    j = sql(spark, sf, f"SELECT * FROM {_IMP_FROM}", ("lineitem", "orders", "customer", "part", "supplier"))
    row = j.agg(*[F.abs(F.corr(F.col(f).cast("double"), "l_extendedprice")).alias(f) for f in _IMP_FEATS])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"))
                                          for f in _IMP_FEATS])))
    return S.normalise_importance(long)


@register("top_features", _IMP_SQL + """
SELECT feature, round(importance, 6) AS importance,
       row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp
QUALIFY rank <= 12""")
def q_top_features(spark, sf):
    out = S.top_features(_importance(spark, sf), 12)
    return round_doubles(out).withColumn("rank", F.col("rank").cast("long"))


@register("top_numeric_features", _IMP_SQL + """
SELECT feature, round(importance, 6) AS importance,
       row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp
WHERE feature IN (SELECT column_name FROM information_schema.columns
                  WHERE table_name = 'lineitem' AND data_type IN ('BIGINT', 'INTEGER', 'DOUBLE'))
QUALIFY rank <= 6""")
def q_top_numeric_features(spark, sf):
    li = load(spark, sf, "lineitem")
    from ..operators.profile import numeric_columns
    nums = spark.createDataFrame([(c,) for c in numeric_columns(li)], "column_name string")
    out = S.top_numeric_features(_importance(spark, sf), nums, 6)
    return round_doubles(out).withColumn("rank", F.col("rank").cast("long"))


_CLS_SQL = ("SELECT l.doc_id, l.quality, d.n_chars, d.lang, d.source FROM labels l "
            "JOIN documents d ON l.doc_id = d.doc_id")


def _fit_cls(spark, sf):
    df = sql(spark, sf, _CLS_SQL, ("labels", "documents"))
    return S.train_and_select(df, "quality", "doc_id")


@register("fit_classifiers")
def q_fit_classifiers(spark, sf):
    return _fit_cls(spark, sf).comparison(spark)


@register("feature_importance")
def q_feature_importance(spark, sf):
    return _fit_cls(spark, sf).importance_table(spark)


_REG_SQL = "SELECT p_partkey, p_retailprice, p_size, p_brand FROM part"


@register("fit_regressors")
def q_fit_regressors(spark, sf):
    df = sql(spark, sf, _REG_SQL, ("part",))
    return S.train_and_select(df, "p_retailprice", "p_partkey").comparison(spark)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    df = sql(spark, sf, "SELECT p_partkey, p_retailprice, p_size, p_brand, CAST(p_partkey % 97 AS DOUBLE) AS shelf FROM part",
             ("part",))
    res = S.train_and_select(df, "p_retailprice", "p_partkey", candidates=["Regresion Lineal"])
    data = encode_target(df, "p_retailprice", fit_target(df, "p_retailprice"))
    test = S.stratified_split(data, "label", "p_partkey", stratify=False).filter("is_test")

    def assemble(d, keep):
        return res.encoder.transform(d, keep=["p_partkey", *keep], vector_col="raw_features")

    return S.permutation_importance(res.model, test, ["p_size", "p_brand", "shelf"], "p_partkey", is_cls=False, assemble=assemble)


@register("softmax_boosting")
def q_softmax_boosting(spark, sf):
    """Order status (three classes) from price, month and customer: per class the orders, how
    many are predicted so, the mean probability, and the largest error of a probability sum."""
    orders = load(spark, sf, "orders").select(
        "o_orderstatus", F.array(F.col("o_totalprice").cast("double"), F.months_between(F.col("o_orderdate").cast("date"), F.lit("1992-01-01")),
                                 F.col("o_custkey").cast("double")).alias("x"))
    classes = [r[0] for r in orders.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]  # the statuses
    rows = orders.withColumn("label", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("o_orderstatus")) - 1).withColumn(
        "features", array_to_vector("x"))
    pred = SoftmaxBoosting(rounds=20, rate=0.3).fit(rows).transform(rows).withColumn("p", vector_to_array("probability"))
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    out = pred.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("prediction") == F.col("label"), 1)).alias("n_hit"),
        F.avg(F.element_at("p", (F.col("label") + 1).cast("int"))).alias("mean_probability"), F.max(F.abs(total - 1)).alias("sum_error"))
    return round_doubles(out)
