"""Table-level entry points (O1-O5): diagnose, analyse, run everything.

Plain Python over lazy stages: each approach is its own set of Spark jobs and
a failing stage becomes a status row while the others continue (O4). Domain
vocabulary only labels text; it never changes a number (O5).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandit as H
from ..operators import cluster as C
from ..operators import recommend as R
from ..operators import report as J
from ..operators import report_text as RT
from ..operators import tags as TG
from ..operators import vocabulary as V
from ..operators.clean import CleaningPlan
from ..operators.features import FeatureEncoder, encode_target, fit_target, quantile_bins, standardize
from ..operators.profile import numeric_columns
from ..operators.supervised import train_and_select

APPROACHES = V.APPROACHES
#: Sections of the facts table and the columns of a run's summary that they hold.
FACT_SECTIONS = {"etl": ["n_rows", "n_cols"], "recomendacion": ["winner", "winner_label", "goal_label"],
                 "supervisado": ["task", "accuracy", "r2", "top_feature"], "no_supervisado": ["best_k"],
                 "refuerzo": ["final_reward", "baseline"]}


@dataclass
class Diagnosis:
    clean: DataFrame
    plan: CleaningPlan
    rows: DataFrame          # one diagnosis row for the table
    target: str | None
    applicable: list[str]


@dataclass
class Analysis:
    status: DataFrame        # approach, status, score_norm, detail
    recommendation: DataFrame
    results: dict = field(default_factory=dict)
    facts: DataFrame | None = None     # J4: section, key, num_value, str_value of this run
    report: DataFrame | None = None    # J5/J6: case_id, report (JSON)


def diagnose(df: DataFrame, name: str = "tabla", order_by: Sequence[str] | None = None,
             target: str | None = None) -> Diagnosis:
    """O1: fit and apply the cleaning plan, then the router rules on the clean table. The
    clean table is persisted: whoever is done with it may unpersist it."""
    plan = CleaningPlan.fit(df, order_by=order_by)
    clean = plan.transform(df).persist(StorageLevel.MEMORY_AND_DISK)
    catalog = TG.column_catalog({name: clean})
    rules = V.rules_frame(df.sparkSession)
    targets = TG.suggest_target(catalog, rules)
    if target:
        targets = targets.withColumn("target_column", F.lit(target))
    rows = TG.applicable_analyses(catalog, targets)
    first = rows.first()
    applicable = [a for a in (first["applicable"] or "").split(",") if a]
    return Diagnosis(clean, plan, rows, first["target_column"], applicable)


def _supervised(clean, key, target):
    res = train_and_select(clean, target, key)
    if res.status != "ok":
        return res.status, 0.0, res.reason or "", res
    return "ok", res.score_norm, f"{res.best_model} ({res.primary_metric})", res


def _unsupervised(clean, key, target):
    enc = FeatureEncoder.fit(clean, exclude=[key, target] if target else [key])
    names = enc.names()
    if len(names) < C.MIN_FEATURES:
        return "skipped", 0.0, "datos insuficientes", None
    feats = enc.transform(clean, keep=[key])
    z, _ = standardize(feats, names, suffix="__z")
    vec = C.as_vector(z, [n + "__z" for n in names])
    res = C.kmeans_sweep(vec, key, "features")
    if res.status != "ok":
        return res.status, 0.0, res.reason or "", res
    return "ok", res.score_norm, f"{res.best_k} clusters (silhouette={res.silhouette:.2f})", res


def _reinforcement(clean, key, target):
    tenc = fit_target(clean, target)
    if tenc.kind == "continuous":
        labelled = quantile_bins(clean, target, out="label")
        n_arms = int(labelled.agg(F.count_distinct("label")).first()[0])
    else:
        labelled = encode_target(clean, target, tenc)
        n_arms = len(tenc.labels)
    if n_arms < 2:
        return "skipped", 0.0, "acciones insuficientes", None
    enc = FeatureEncoder.fit(clean, exclude=[key, target])
    names = enc.names()
    feats = enc.transform(labelled, keep=[key, "label"])
    z, _ = standardize(feats, names, suffix="__z")
    ctx = z.select(key, F.col("label").cast("int").alias("label"),
                   H.with_intercept(F.array(*[F.col(f"`{n}__z`") for n in names])).alias("x"))
    run = H.run_rounds(ctx, key, "x", "label", n_arms, dim=len(names) + 1)
    fw = H.final_window_reward(H.with_steps(run.rewards, ["round", "u"]), n_arms).first()
    run.final = fw
    return "ok", float(min(1.0, max(0.0, fw["final_reward"]))), \
        f"acierto {fw['final_reward'] * 100:.0f}% vs azar {fw['baseline'] * 100:.0f}%", run


_RUNNERS = {"supervised": _supervised, "unsupervised": _unsupervised, "reinforcement": _reinforcement}


def analyze(clean: DataFrame, key: str, target: str | None, approaches: Sequence[str],
            goal: str = V.DEFAULT_GOAL, case_id: str = "tabla", domain: str | None = None) -> Analysis:
    """Run the chosen approaches (each isolated), recommend for the goal, and build
    the facts and the report from the results."""
    spark: SparkSession = clean.sparkSession
    rows, results = [], {}

    def run(a):
        if a != "unsupervised" and (not target or target not in clean.columns):
            return "skipped", 0.0, "sin objetivo", None
        return _RUNNERS[a](clean, key, target)

    chosen = [a for a in APPROACHES if a in approaches]
    # The approaches are independent: their Spark jobs run concurrently from a small
    # driver thread pool; each stays isolated (a failure becomes its status row).
    with ThreadPoolExecutor(max_workers=len(chosen) or 1) as pool:
        futures = [(a, pool.submit(run, a)) for a in chosen]
        for a, fut in futures:
            try:
                status, score, detail, res = fut.result()
                results[a] = res
                rows.append((case_id, a, status, float(score), detail))
            except Exception as exc:  # noqa: BLE001 - O4: a failing stage becomes a status row
                rows.append((case_id, a, "failed", 0.0, f"{type(exc).__name__}: {exc}"))
    status = spark.createDataFrame(rows, "case_id string, approach string, status string, score_norm double, "
                                         "detail string")
    req = spark.createDataFrame([(case_id, goal)], "case_id string, goal string")
    rec = R.recommendation(R.weighted_scores(status, req), req)
    out = Analysis(status, rec, results)
    try:
        out.facts, out.report = _report(clean, key, target, goal, case_id, rec, results, domain)
    except Exception as exc:  # noqa: BLE001 - O4: a failing report leaves the results
        failed = spark.createDataFrame([(case_id, "report", "failed", 0.0, f"{type(exc).__name__}: {exc}")], status.schema)
        out.status = status.unionByName(failed)
    return out


def _traits(clean, key, target, uns) -> str:
    """What distinguishes the clusters of this run: the numeric columns but key and target."""
    if uns is None or uns.assignments is None:
        return ""
    columns = numeric_columns(clean, exclude=[key, *([target] if target else [])])
    return C.traits_text(C.cluster_profile(clean.join(uns.assignments, key), "cluster", columns), columns)


def _report(clean, key, target, goal, case_id, rec, results, domain):
    """J4-J6 from what this run measured: the fact sections, the key finding, the report."""
    spark = clean.sparkSession
    sup, uns, rl = (results.get(a) for a in APPROACHES)
    n_rows, win = clean.count(), rec.first()
    metrics = sup.metrics.get(sup.best_model, {}) if sup is not None and sup.best_model else {}
    top = sup.importance_table(spark).orderBy(F.col("importance").desc(), "feature").first() if metrics and sup.feature_names else None
    final = rl.final if rl is not None else None
    task = sup.task if sup is not None else None
    wide = spark.createDataFrame([(
        case_id, win["winner"], target, task, metrics.get("accuracy"), metrics.get("r2"), top["feature"] if top else None,
        uns.best_k if uns is not None else None, _traits(clean, key, target, uns), float(final["final_reward"]) if final else None,
        float(final["baseline"]) if final else None, n_rows, len(clean.columns),
        V.GOAL_LABELS.get(domain or "general", V.GOAL_LABELS["general"]).get(goal), win["winner_label"], V.DOMAIN_LABELS.get(domain))],
        "case_id string, winner string, target string, task string, accuracy double, r2 double, top_feature string, best_k int, "
        "distinctive string, final_reward double, baseline double, n_rows long, n_cols int, goal_label string, "
        "winner_label string, domain_label string")
    facts = None
    for name, keys in FACT_SECTIONS.items():
        part = J.facts_long(wide, name, keys, ["case_id"])
        facts = part if facts is None else facts.unionByName(part)
    n = spark.createDataFrame([(1, n_rows)], "one int, n_rows long")
    if target and target in clean.columns:
        one = clean.withColumn("one", F.lit(1))
        balance = J.class_balance(one, target, ["one"]) if task != "regresion" else None
        stats = J.target_stats(one, target, ["one"]) if task == "regresion" else None
        extra = (J.facts_long(balance, "clase", ["majority", "majority_pct", "minority", "minority_pct"]) if balance is not None
                 else J.facts_long(stats, "distribucion", ["media", "mediana", "min", "max"]))
        facts = facts.unionByName(extra.select(F.lit(case_id).alias("case_id"), "section", "key", "num_value", "str_value"))
        finding = J.findings(balance, stats, target, None, n, ["one"])
    else:
        finding = n.select(F.lit(None).cast("string").alias("finding"))
    finding = finding.select(F.lit(case_id).alias("case_id"), "finding")
    return facts.filter(F.col("num_value").isNotNull() | F.col("str_value").isNotNull()), RT.report_json(wide, finding)


def run_all(df: DataFrame, key: str, goal: str = V.DEFAULT_GOAL, name: str = "tabla",
            target: str | None = None, domain: str | None = None) -> tuple[Diagnosis, Analysis]:
    """O3: diagnose, then run every applicable approach, recommend and report. ``domain``
    only labels texts."""
    d = diagnose(df, name=name, order_by=[key], target=target)
    try:
        a = analyze(d.clean, key, d.target, d.applicable, goal, case_id=name, domain=domain)
    finally:
        d.clean.unpersist()
    return d, a
