"""Checked queries for the per-segment cash-flow projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import cashflow as CF
from .registry import register
from .tables import derived, derived_duck, load

PROJ = CF.Projection(capital=100_000.0, horizon=12, discount_rate=0.01, seed=42)


def _params(spark, sf):
    cust = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment")
    flows = CF.split_flows(cust, "c_acctbal", ["segment"])
    fin = derived(spark, sf, "finanzas").withColumnRenamed("segmento_cliente", "segment")
    rates = CF.binary_rate(fin, "churn", ["segment"])
    return CF.projection_params(flows, rates, ["segment"])


def _paths(spark, sf):
    """Monthly flows of every customer as recorded: finished orders come in, open orders go out."""
    price = F.col("o_totalprice").cast("double")
    by = lambda status: F.when(F.col("o_orderstatus") == status, price).otherwise(0.0)
    return CF.observed_flows(load(spark, sf, "customer"), load(spark, sf, "orders"), "c_mktsegment", "c_custkey", "o_custkey",
                             F.month("o_orderdate"), by("F"), by("O"), PROJ.horizon)


def _r4(df):
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_CTES = f"""
WITH fl AS (SELECT c_mktsegment AS segment, c_acctbal AS x FROM customer WHERE c_acctbal IS NOT NULL),
sp AS (SELECT segment, count(*) FILTER (WHERE x > 0) AS np, count(*) FILTER (WHERE x < 0) AS nn, count(*) AS n,
       avg(x) FILTER (WHERE x > 0) AS pm, stddev_samp(x) FILTER (WHERE x > 0) AS ps,
       avg(-x) FILTER (WHERE x < 0) AS nm, stddev_samp(-x) FILTER (WHERE x < 0) AS ns,
       avg(abs(x)) AS am, stddev_samp(abs(x)) AS sa FROM fl GROUP BY segment),
fs AS (SELECT segment, CASE WHEN np > 0 AND nn > 0 THEN 'split_por_signo' ELSE 'solo_entradas' END AS mode,
       CASE WHEN np > 0 AND nn > 0 THEN pm ELSE coalesce(am, 0) END AS inflow_mean,
       CASE WHEN np > 0 AND nn > 0 THEN (CASE WHEN np > 1 THEN ps ELSE 0 END)
            ELSE (CASE WHEN n > 1 THEN sa ELSE 0 END) END AS inflow_std,
       CAST(CASE WHEN np > 0 AND nn > 0 THEN np ELSE n END AS BIGINT) AS inflow_n,
       CASE WHEN np > 0 AND nn > 0 THEN nm ELSE 0 END AS outflow_mean,
       CASE WHEN np > 0 AND nn > 0 THEN (CASE WHEN nn > 1 THEN ns ELSE 0 END) ELSE 0 END AS outflow_std,
       CAST(CASE WHEN np > 0 AND nn > 0 THEN nn ELSE 0 END AS BIGINT) AS outflow_n FROM sp),
vc AS (SELECT segmento_cliente AS segment, churn AS v, count(*) AS c FROM ({derived_duck('finanzas')})
       WHERE churn IS NOT NULL GROUP BY segmento_cliente, churn),
rt AS (SELECT segment, CASE WHEN count(*) <> 2 THEN NULL
              WHEN max(CASE WHEN v = 1 THEN 1 END) IS NOT NULL THEN sum(CASE WHEN v = 1 THEN c ELSE 0 END) / sum(c)
              ELSE arg_max(c, v) / sum(c) END AS rate FROM vc GROUP BY segment),
params AS (SELECT fs.*, rt.rate, CASE WHEN coalesce(rt.rate, 0) <> 0 THEN inflow_mean * (1 - rt.rate)
                  ELSE inflow_mean END AS inflow_mean_adj FROM fs LEFT JOIN rt ON fs.segment = rt.segment),
mon AS (SELECT o_custkey, month(o_orderdate) AS period, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DOUBLE) ELSE 0 END) AS inflow,
        sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DOUBLE) ELSE 0 END) AS outflow FROM orders GROUP BY 1, 2),
flows AS (SELECT c.c_mktsegment AS segment, c.c_custkey AS path_id, t.period, coalesce(m.inflow, 0.0::DOUBLE) AS inflow,
          coalesce(m.outflow, 0.0::DOUBLE) AS outflow
        FROM customer c CROSS JOIN (SELECT unnest(range(1, {PROJ.horizon + 1})) AS period) t
        LEFT JOIN mon m ON m.o_custkey = c.c_custkey AND m.period = t.period),
net AS (SELECT *, inflow - outflow AS net FROM flows),
npv AS (SELECT segment, path_id, -{PROJ.capital} + sum(net / pow(1.01, period)) AS npv,
        {PROJ.capital} + sum(net) AS final_balance FROM net GROUP BY segment, path_id),
bal AS (SELECT segment, path_id, period, {PROJ.capital} + sum(net) OVER (PARTITION BY segment, path_id ORDER BY period
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM net
        UNION ALL SELECT segment, path_id, 0, {PROJ.capital} FROM net WHERE period = 1)
"""


@register("derive_distribution", """
SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS mean,
       round(CASE WHEN count(c_acctbal) > 1 THEN stddev_samp(c_acctbal) ELSE 0 END, 4) AS std,
       CAST(count(c_acctbal) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment""")
def q_derive_distribution(spark, sf):
    cust = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment")
    return _r4(CF.derive_distribution(cust, "c_acctbal", ["segment"]))


@register("split_inflow_outflow", _CTES + """
SELECT segment, mode, round(inflow_mean, 4) AS inflow_mean, round(inflow_std, 4) AS inflow_std, inflow_n,
       round(outflow_mean, 4) AS outflow_mean, round(outflow_std, 4) AS outflow_std, outflow_n FROM fs""")
def q_split_inflow_outflow(spark, sf):
    cust = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment")
    return _r4(CF.split_flows(cust, "c_acctbal", ["segment"]))


@register("binary_rate", _CTES + "SELECT segment, round(rate, 6) AS rate FROM rt")
def q_binary_rate(spark, sf):
    fin = derived(spark, sf, "finanzas").withColumnRenamed("segmento_cliente", "segment")
    return round_doubles(CF.binary_rate(fin, "churn", ["segment"]))


@register("rate_adjusted_inflow", _CTES + """
SELECT segment, round(rate, 6) AS rate, round(inflow_mean, 4) AS inflow_mean,
       round(inflow_mean_adj, 4) AS inflow_mean_adj FROM params""")
def q_rate_adjusted_inflow(spark, sf):
    p = _params(spark, sf)
    return p.select("segment", F.round("rate", 6).alias("rate"), F.round("inflow_mean", 4).alias("inflow_mean"),
                    F.round("inflow_mean_adj", 4).alias("inflow_mean_adj"))


@register("cashflow_paths", _CTES + """
SELECT segment, path_id, CAST(period AS INTEGER) AS period, round(inflow, 4) AS inflow, round(outflow, 4) AS outflow,
       round(net, 4) AS net FROM net""")
def q_cashflow_paths(spark, sf):
    return _r4(_paths(spark, sf))


@register("running_balance", _CTES + """
SELECT segment, path_id, CAST(period AS INTEGER) AS period, round(balance, 4) AS balance FROM bal""")
def q_running_balance(spark, sf):
    return _r4(CF.running_balance(_paths(spark, sf), PROJ))


@register("npv_by_group", _CTES + "SELECT segment, path_id, round(npv, 4) AS npv FROM npv")
def q_npv_by_group(spark, sf):
    return _r4(CF.npv_by_path(_paths(spark, sf), PROJ).select("segment", "path_id", "npv"))


@register("npv_percentiles", _CTES + """
SELECT segment, round(quantile_cont(npv, 0.1), 4) AS p10, round(quantile_cont(npv, 0.5), 4) AS p50,
       round(quantile_cont(npv, 0.9), 4) AS p90 FROM npv GROUP BY segment""")
def q_npv_percentiles(spark, sf):
    return _r4(CF.npv_percentiles(CF.npv_by_path(_paths(spark, sf), PROJ)))


@register("prob_negative", _CTES + """
SELECT segment, round(avg(CASE WHEN final_balance < 0 THEN 1.0 ELSE 0.0 END), 6) AS prob_negative
FROM npv GROUP BY segment""")
def q_prob_negative(spark, sf):
    return round_doubles(CF.prob_negative(CF.npv_by_path(_paths(spark, sf), PROJ)))


@register("mean_net_by_period", _CTES + """
SELECT segment, CAST(period AS INTEGER) AS period, round(avg(net), 4) AS mean_net FROM net GROUP BY segment, period""")
def q_mean_net_by_period(spark, sf):
    return _r4(CF.mean_net_by_period(_paths(spark, sf)))


@register("balance_bands", _CTES + """
SELECT segment, CAST(period AS INTEGER) AS period, round(quantile_cont(balance, 0.1), 4) AS p10,
       round(quantile_cont(balance, 0.5), 4) AS p50, round(quantile_cont(balance, 0.9), 4) AS p90
FROM bal GROUP BY segment, period""")
def q_balance_bands(spark, sf):
    return _r4(CF.balance_bands(CF.running_balance(_paths(spark, sf), PROJ)))


@register("sample_paths", _CTES + """,
ids AS (SELECT DISTINCT segment, path_id FROM net),
chosen AS (SELECT segment, path_id FROM ids
           QUALIFY row_number() OVER (PARTITION BY segment ORDER BY md5(CAST(path_id AS VARCHAR) || ':7'), path_id) <= 40)
SELECT n.segment, n.path_id, CAST(n.period AS INTEGER) AS period, round(n.net, 4) AS net
FROM net n JOIN chosen c ON n.segment = c.segment AND n.path_id = c.path_id""")
def q_sample_paths(spark, sf):
    return _r4(CF.sample_paths(_paths(spark, sf)).select("segment", "path_id", "period", "net"))


@register("npv_histogram", _CTES + """,
rng AS (SELECT segment, min(npv) AS lo, max(npv) AS hi FROM npv GROUP BY segment),
cnt AS (SELECT n.segment, CAST(CASE WHEN hi > lo THEN least(59, floor((npv - lo) / (hi - lo) * 60)) ELSE 0 END AS INTEGER)
               AS bin, count(*) AS c FROM npv n JOIN rng r ON n.segment = r.segment GROUP BY 1, 2),
grid AS (SELECT segment, lo, hi, CAST(unnest(range(0, 60)) AS INTEGER) AS bin FROM rng)
SELECT g.segment, g.bin, round(lo + g.bin * (hi - lo) / 60, 4) AS bin_lo, round(lo + (g.bin + 1) * (hi - lo) / 60, 4)
       AS bin_hi, CAST(coalesce(c, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt ON g.segment = cnt.segment AND g.bin = cnt.bin""")
def q_npv_histogram(spark, sf):
    return _r4(CF.npv_histogram(CF.npv_by_path(_paths(spark, sf), PROJ)))


@register("irr_by_group")
def q_irr_by_group(spark, sf):
    irr = CF.irr_by_group(CF.mean_net_by_period(_paths(spark, sf)), PROJ)
    return irr.select("segment", "irr", CF.npv_at(F.col("cashflows"), F.col("irr")).alias("npv_at_irr"))


@register("provenance_note", _CTES + """
SELECT segment, printf('Entradas/salidas derivadas de ''%s'' (%s): media entrada %.2f, desv %.2f; media salida %.2f, desv %.2f%s',
  'c_acctbal', mode, inflow_mean, inflow_std, outflow_mean, outflow_std,
  CASE WHEN coalesce(rate, 0) <> 0 THEN printf('; ajuste por tasa observada de ''%s'' = %.4f', 'churn', rate) ELSE '' END) AS note
FROM params""")
def q_provenance_note(spark, sf):
    return CF.provenance_note(_params(spark, sf), "c_acctbal", "churn")
