"""Cash-flow projection per segment.

The reference runs one Monte Carlo over a single column. Here the inputs are
grouped statistics (per segment), every *entity* of the table is one simulated
path of its segment (so the work grows with the data), and every output -
balances, NPV, percentiles, bands, histogram, IRR - is a grouped aggregate or a
window partitioned by (segment, path) whose partitions hold ``horizon`` rows.

Normal draws are Box-Muller on md5-derived uniforms keyed by
(segment, path, period, flow, seed): independent of partitioning, reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, fixed_text
from ..functions.quantiles import group_quantiles
from ..functions.random import hash_normal

MIN_STD = 1e-9
POSITIVE_WORDS = ("1", "true", "si", "sí", "yes", "fraude", "mora")  # fixed values of the reference
IRR_LO, IRR_HI, IRR_STEPS = -0.99, 10.0, 100
HIST_BINS = 60
SAMPLE_PATHS, SAMPLE_SEED = 40, 7


@dataclass
class Projection:
    capital: float = 100_000.0
    horizon: int = 12
    discount_rate: float = 0.01
    seed: int = 42


def _num(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS DOUBLE)")


def derive_distribution(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """L1: mean, sample std (0 when n <= 1) and n of the numeric values per group."""
    x = _num(value)
    return df.groupBy(*[col(g) for g in group_by]).agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(F.lit(0.0)).alias("std"),
        F.count(x).cast("long").alias("n"))


def split_flows(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """L2: with both signs present, inflow = positives and outflow = |negatives|;
    otherwise every |x| is inflow and the outflow is zero."""
    x = _num(value)
    pos, neg = F.when(x > 0, x), F.when(x < 0, -x)
    a = df.groupBy(*[col(g) for g in group_by]).agg(
        F.count(pos).alias("np"), F.count(neg).alias("nn"), F.count(x).alias("n"),
        F.avg(pos).alias("pm"), F.stddev_samp(pos).alias("ps"),
        F.avg(neg).alias("nm"), F.stddev_samp(neg).alias("ns"),
        F.avg(F.abs(x)).alias("am"), F.stddev_samp(F.abs(x)).alias("as"))
    split = (F.col("np") > 0) & (F.col("nn") > 0)

    def sd(s, n):
        return F.when(F.col(n) > 1, F.col(s)).otherwise(F.lit(0.0))

    return a.select(
        *group_by,
        F.when(split, F.lit("split_por_signo")).otherwise(F.lit("solo_entradas")).alias("mode"),
        F.when(split, F.col("pm")).otherwise(F.coalesce(F.col("am"), F.lit(0.0))).alias("inflow_mean"),
        F.when(split, sd("ps", "np")).otherwise(sd("as", "n")).alias("inflow_std"),
        F.when(split, F.col("np")).otherwise(F.col("n")).cast("long").alias("inflow_n"),
        F.when(split, F.col("nm")).otherwise(F.lit(0.0)).alias("outflow_mean"),
        F.when(split, sd("ns", "nn")).otherwise(F.lit(0.0)).alias("outflow_std"),
        F.when(split, F.col("nn")).otherwise(F.lit(0)).cast("long").alias("outflow_n"))


def binary_rate(df: DataFrame, target: str, group_by: Sequence[str] = ()) -> DataFrame:
    """L3: share of the positive class when the target has exactly two distinct values.
    Numeric (or numeric-looking) targets: positive = 1 if present, else the max;
    other strings: share of the positive words; null when not binary / no match.

    Two aggregates: value counts per group (map-side combined), then one row per group.
    """
    t = col(target)
    vc = df.filter(t.isNotNull()).groupBy(*[col(g) for g in group_by], t.alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"))
    xv = F.expr("try_cast(`__v` AS DOUBLE)")
    word = F.lower(F.col("__v").cast("string")).isin(*POSITIVE_WORDS)
    a = vc.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("d"), F.sum("__c").alias("n"),
        F.min(xv.isNotNull().cast("int")).alias("numeric"),
        F.sum(F.when(xv == 1, F.col("__c")).otherwise(0)).alias("c1"),
        F.max(F.when(xv == 1, 1)).alias("has1"),
        F.max_by("__c", xv).alias("cmx"),
        F.sum(F.when(word, F.col("__c")).otherwise(0)).alias("cw"))
    rate = (F.when(F.col("d") != 2, F.lit(None))
            .when((F.col("numeric") == 1) & F.col("has1").isNotNull(), F.col("c1") / F.col("n"))
            .when(F.col("numeric") == 1, F.col("cmx") / F.col("n"))
            .when(F.col("cw") > 0, F.col("cw") / F.col("n")))
    return a.select(*group_by, rate.cast("double").alias("rate"))


def projection_params(flows: DataFrame, rates: DataFrame | None, group_by: Sequence[str]) -> DataFrame:
    """Split flows joined with the observed rate; the inflow mean is reduced by the
    rate (a null or zero rate means no adjustment)."""
    p = flows
    if rates is not None:
        p = p.join(rates, list(group_by), "left")
    else:
        p = p.withColumn("rate", F.lit(None).cast("double"))
    adj = F.when(F.coalesce(F.col("rate"), F.lit(0.0)) != 0, F.col("inflow_mean") * (1 - F.col("rate"))) \
        .otherwise(F.col("inflow_mean"))
    return p.withColumn("inflow_mean_adj", adj)


def observed_flows(entities: DataFrame, events: DataFrame, segment: str, path: str, event_path: str, period: Column,
                   inflow: Column, outflow: Column, horizon: int) -> DataFrame:
    """(segment, path_id, period, inflow, outflow, net): the recorded flows of every entity
    per period 1..horizon, zero where nothing was recorded."""
    sums = events.groupBy(col(event_path).alias("__path"), period.cast("int").alias("__period")).agg(
        F.sum(inflow).alias("__in"), F.sum(outflow).alias("__out"))
    base = entities.select(col(segment).alias("segment"), col(path).alias("path_id")).withColumn(
        "period", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    j = base.join(sums, (F.col("path_id") == F.col("__path")) & (F.col("period") == F.col("__period")), "left")
    got_in, got_out = F.coalesce("__in", F.lit(0.0)), F.coalesce("__out", F.lit(0.0))
    return j.select("segment", "path_id", "period", got_in.alias("inflow"), got_out.alias("outflow"), (got_in - got_out).alias("net"))


def simulate_paths(params: DataFrame, entities: DataFrame, segment: str, path: str,
                   proj: Projection) -> DataFrame:
    """(segment, path_id, period, inflow, outflow, net) for periods 1..horizon.
    Flows ~ Normal(mean, max(std, 1e-9)) clipped at 0; one path per entity row."""
    base = entities.select(col(segment).alias("segment"), col(path).alias("path_id")).join(
        params.withColumnRenamed(segment, "segment"), "segment")
    per = base.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(proj.horizon))))
    key = [F.col("segment"), F.col("path_id"), F.col("period")]
    seed = F.lit(str(proj.seed))
    z_in = hash_normal(*key, seed, salt="i")
    z_out = hash_normal(*key, seed, salt="o")
    inflow = F.greatest(F.lit(0.0), F.col("inflow_mean_adj") + F.greatest(F.col("inflow_std"), F.lit(MIN_STD)) * z_in)
    outflow = F.greatest(F.lit(0.0), F.col("outflow_mean") + F.greatest(F.col("outflow_std"), F.lit(MIN_STD)) * z_out)
    return per.select("segment", "path_id", "period", inflow.alias("inflow"), outflow.alias("outflow")) \
              .withColumn("net", F.col("inflow") - F.col("outflow"))


def running_balance(paths: DataFrame, proj: Projection) -> DataFrame:
    """balance = capital + cumulative net per (segment, path); period 0 = capital."""
    w = Window.partitionBy("segment", "path_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    bal = paths.select("segment", "path_id", "period",
                       (F.lit(proj.capital) + F.sum("net").over(w)).alias("balance"))
    start = paths.filter(F.col("period") == 1).select(
        "segment", "path_id", F.lit(0).alias("period"), F.lit(proj.capital).alias("balance"))
    return bal.unionByName(start)


def npv_by_path(paths: DataFrame, proj: Projection) -> DataFrame:
    """L8 (+ final balance for L10): npv = -capital + sum(net_t / (1+r)^t)."""
    disc = F.col("net") / F.pow(F.lit(1.0 + proj.discount_rate), F.col("period").cast("double"))
    return paths.groupBy("segment", "path_id").agg(
        (F.lit(-proj.capital) + F.sum(disc)).alias("npv"),
        (F.lit(proj.capital) + F.sum("net")).alias("final_balance"))


def npv_percentiles(npv: DataFrame, accuracy: int | None = None) -> DataFrame:
    """P10/P50/P90 of the NPV per segment (exact, or approximate with ``accuracy``)."""
    if accuracy is None:
        found = group_quantiles(npv, ["npv"], [0.1, 0.5, 0.9], ["segment"]).withColumnRenamed("__q0", "q")
    else:
        found = npv.groupBy("segment").agg(F.percentile_approx("npv", [0.1, 0.5, 0.9], accuracy).alias("q"))
    return found.select(
        "segment", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def prob_negative(npv: DataFrame) -> DataFrame:
    """Share of paths whose final balance is below zero."""
    return npv.groupBy("segment").agg(F.avg((F.col("final_balance") < 0).cast("double")).alias("prob_negative"))


def mean_net_by_period(paths: DataFrame) -> DataFrame:
    """Mean net flow per (segment, period)."""
    return paths.groupBy("segment", "period").agg(F.avg("net").alias("mean_net"))


def _npv_at(flows: Column, r: Column) -> Column:
    # Horner: sum_t cf_t v^t with v = 1/(1+r), evaluated from the last flow back.
    v = 1.0 / (1.0 + r)
    return F.aggregate(F.reverse(flows), F.lit(0.0), lambda acc, x: acc * v + x)


def irr_by_group(mean_net: DataFrame, proj: Projection) -> DataFrame:
    """IRR of [-capital, mean net flows] per segment by bisection on
    [-0.99, 10]; null without a sign change or with fewer than two flows.
    The per-segment flow array has ``horizon`` entries."""
    flows = mean_net.groupBy("segment").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("period", "mean_net"))), lambda s: s["mean_net"])
        .alias("m"))
    cf = F.concat(F.array(F.lit(-proj.capital)), F.col("m"))
    lo, hi = F.lit(IRR_LO), F.lit(IRR_HI)
    f_lo, f_hi = _npv_at(cf, lo), _npv_at(cf, hi)

    def step(s, _i):
        mid = (s["lo"] + s["hi"]) / 2
        same = F.signum(_npv_at(cf, s["lo"])) == F.signum(_npv_at(cf, mid))
        return F.when(same, F.struct(mid.alias("lo"), s["hi"].alias("hi"))) \
                .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(IRR_STEPS)), F.struct(lo.alias("lo"), hi.alias("hi")), step)
    irr = (root["lo"] + root["hi"]) / 2
    ok = (F.size(cf) >= 2) & (f_lo * f_hi <= 0)
    return flows.select("segment", F.when(ok, irr).alias("irr"), cf.alias("cashflows"))


def npv_at(cashflows: Column, rate: Column) -> Column:
    return _npv_at(cashflows, rate)


def balance_bands(balances: DataFrame, accuracy: int | None = None) -> DataFrame:
    """P10/P50/P90 of the balance per (segment, period)."""
    g = ["segment", "period"]
    if accuracy is None:
        found = group_quantiles(balances, ["balance"], [0.1, 0.5, 0.9], g).withColumnRenamed("__q0", "q")
    else:
        found = balances.groupBy(*g).agg(F.percentile_approx("balance", [0.1, 0.5, 0.9], accuracy).alias("q"))
    return found.select(
        "segment", "period", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def sample_paths(paths: DataFrame, k: int = SAMPLE_PATHS, seed: int = SAMPLE_SEED) -> DataFrame:
    """L14 (a sampling operator): up to ``k`` paths per segment, chosen by md5(path:seed);
    the ``row_number() <= k`` filter is applied map-side by Spark's group limit."""
    ids = paths.select("segment", "path_id").distinct()
    h = F.md5(F.concat_ws(":", F.col("path_id").cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("segment").orderBy(h, F.col("path_id"))
    chosen = ids.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
    return paths.join(chosen, ["segment", "path_id"], "left_semi")


def npv_histogram(npv: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of the NPV per segment, empty bins kept, the maximum
    in the last bin."""
    rng = npv.groupBy("segment").agg(F.min("npv").alias("lo"), F.max("npv").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.lit(bins - 1), F.floor((F.col("npv") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
               ).otherwise(F.lit(0)).cast("int")
    counts = npv.join(rng, "segment").groupBy("segment", b.alias("bin")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    grid = rng.select("segment", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["segment", "bin"], "left")
            .select("segment", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def provenance_note(params: DataFrame, value_col: str, rate_col: str | None) -> DataFrame:
    """Where each segment's parameters come from, as text."""
    return params.select("segment", F.format_string(
        "Entradas/salidas derivadas de '%s' (%s): media entrada %s, desv %s; media salida %s, desv %s%s",
        F.lit(value_col), F.col("mode"), *[fixed_text(F.col(c), 2) for c in ("inflow_mean", "inflow_std", "outflow_mean", "outflow_std")],
        F.when(F.col("rate").isNotNull() & (F.col("rate") != 0),
               F.format_string("; ajuste por tasa observada de '%s' = %s", F.lit(rate_col or ""), fixed_text(F.col("rate"), 4)))
        .otherwise(F.lit(""))).alias("note"))
