"""Diagnosis rules and column tagging over a catalogue of many tables.

The catalogue is one row per (table, column) with profile statistics, built
from the tables themselves (``column_catalog``). Every name rule of the
reference - target keywords, domain keywords, target frames, money / lat / lon /
location / stock / delay detectors - is a row of one small rules table, and
every rule is answered by the same substring theta join of catalogue x rules
with the rules side broadcast (its size is fixed by the vocabulary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary as V
from ..functions.columns import schema_kind
from .profile import profile_columns

MIN_ROWS_SUPERVISED = 20
MIN_ROWS_CLUSTER = 20
MIN_ROWS_BANDIT = 40
MIN_NUMERIC_CLUSTER = 2
CATEGORICAL_MAX_UNIQUE = 20
CATEGORICAL_MIN_CAP = 10
CATEGORICAL_SHARE = 0.05


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, kind, type_class, n_rows, n_unique) for all tables."""
    parts = []
    for name, df in tables.items():
        prof = profile_columns(df, with_samples=False)
        types = {f.name: f.dataType for f in df.schema.fields}
        tc = F.create_map(*[F.lit(x) for c in df.columns for x in (c, schema_kind(types[c]))])
        parts.append(prof.select(
            F.lit(name).alias("table_name"), F.col("ordinal").cast("int").alias("ordinal"), "column_name",
            "kind", tc[F.col("column_name")].alias("type_class"), (F.col("n_missing") + F.col("n_non_null")).alias("n_rows"), "n_unique"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def name_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, type_class) from the schemas alone: the rules on
    names and types (D1, D7, D8, D10-D15) need no scan of the data."""
    rows = [(name, i, f.name, schema_kind(f.dataType)) for name, df in tables.items() for i, f in enumerate(df.schema)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type_class string")


def _name_match(name: Column, keyword: Column, exact_short: bool) -> Column:
    lname = F.lower(F.trim(name))
    sub = F.contains(F.lower(name), keyword)
    if not exact_short:
        return sub | (lname == keyword)
    # Keywords of one or two letters ("y") only match the whole name.
    return F.when(F.length(keyword) <= 2, lname == keyword).otherwise(sub | (lname == keyword))


def rule_matches(catalog: DataFrame, rules: DataFrame, rule: str,
                 exact_short: bool = True) -> DataFrame:
    """Catalogue rows that match any keyword of ``rule`` (with keyword columns)."""
    r = F.broadcast(rules.filter(F.col("rule") == rule).select(
        F.col("domain").alias("r_domain"), "keyword", "priority", "frame"))
    return catalog.join(r, _name_match(F.col("column_name"), F.col("keyword"), exact_short))


def suggest_target(catalog: DataFrame, rules: DataFrame, exact_short: bool = True) -> DataFrame:
    """(table_name, target_column): first column (by ordinal) matching a target keyword,
    else the last column."""
    first = (rule_matches(catalog, rules, "target", exact_short)
             .groupBy("table_name").agg(F.min_by("column_name", "ordinal").alias("kw_target")))
    last = catalog.groupBy("table_name").agg(F.max_by("column_name", "ordinal").alias("last_column"))
    return (last.join(first, "table_name", "left")
            .select("table_name", F.coalesce("kw_target", "last_column").alias("target_column")))


def categorical_like(catalog: DataFrame) -> DataFrame:
    """Adds ``looks_categorical``: string/boolean type, or few distinct values."""
    cap = F.greatest(F.lit(CATEGORICAL_MIN_CAP), F.floor(F.col("n_rows") * CATEGORICAL_SHARE))
    few = (F.col("n_unique") <= cap) & (F.col("n_unique") <= CATEGORICAL_MAX_UNIQUE)
    return catalog.withColumn(
        "looks_categorical", F.col("type_class").isin("string", "boolean") | few)


def applicable_analyses(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """Per table, which analyses apply and why (one diagnosis row per table)."""
    cat = categorical_like(catalog)
    # the few columns of a table go along with it, so that the catalogue is computed once
    per_table = cat.groupBy("table_name").agg(
        F.max("n_rows").alias("n_rows"),
        F.sum(F.when(F.col("kind") == "numeric", 1).otherwise(0)).alias("n_numeric"),
        F.sum(F.when(F.col("kind") == "datetime", 1).otherwise(0)).alias("n_datetime"),
        F.collect_list(F.struct("column_name", "looks_categorical", "type_class")).alias("columns"))
    d = per_table.join(targets.select("table_name", "target_column"), "table_name", "left")
    d = d.select("*", F.inline_outer(F.filter("columns", lambda c: c["column_name"] == F.col("target_column"))))
    enough = F.col("target_column").isNotNull() & (F.col("n_rows") >= MIN_ROWS_SUPERVISED)
    task = (F.when(enough & F.col("looks_categorical"), F.lit("clasificacion"))
            .when(enough & (F.col("type_class") == "numeric"), F.lit("regresion")))
    sup = task.isNotNull()
    uns = (F.col("n_numeric") >= MIN_NUMERIC_CLUSTER) & (F.col("n_rows") >= MIN_ROWS_CLUSTER)
    rl = sup & (F.col("n_rows") >= MIN_ROWS_BANDIT)
    applicable = F.concat_ws(",", F.when(sup, F.lit("supervised")), F.when(uns, F.lit("unsupervised")),
                             F.when(rl, F.lit("reinforcement")))
    return d.select("table_name", "target_column", F.col("n_rows").cast("long").alias("n_rows"),
                    F.coalesce(sup, F.lit(False)).alias("supervised_ok"), task.alias("task"),
                    uns.alias("unsupervised_ok"), F.coalesce(rl, F.lit(False)).alias("reinforcement_ok"),
                    (F.col("n_datetime") >= 1).alias("has_temporal"), applicable.alias("applicable"))


def domain_match(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """(table_name, domain, domain_match): any column name contains a domain keyword;
    a domain without keywords always matches."""
    tables = catalog.select("table_name").distinct()
    grid = tables.withColumn("domain", F.explode(F.array(*[F.lit(d) for d in V.DOMAIN_KEYWORDS])))
    hits = (rule_matches(catalog, rules, "domain", exact_short=False)
            .select("table_name", F.col("r_domain").alias("domain")).distinct()
            .withColumn("hit", F.lit(True)))
    has_kw = (rules.filter(F.col("rule") == "domain").select("domain").distinct()
              .withColumn("has_keywords", F.lit(True)))
    return (grid.join(hits, ["table_name", "domain"], "left").join(F.broadcast(has_kw), "domain", "left")
            .select("table_name", "domain",
                    (F.col("hit").isNotNull() | F.col("has_keywords").isNull()).alias("domain_match")))


def target_frame(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(table_name, domain, target_frame): first frame whose keyword is in the target name,
    else the domain's default target phrase."""
    grid = targets.select("*", F.inline(F.array(*[
        F.struct(F.lit(d).alias("domain"), F.lit(ph).alias("phrase")) for d, ph in V.TARGET_PHRASE.items()])))
    fr = F.broadcast(rules.filter(F.col("rule") == "frame").select(
        F.col("domain"), "keyword", "priority", "frame"))
    hits = (grid.join(fr, ["domain"]).filter(F.contains(F.lower("target_column"), F.col("keyword")))
            .groupBy("table_name", "domain").agg(F.min_by("frame", "priority").alias("hit_frame")))
    return (grid.join(hits, ["table_name", "domain"], "left")
            .select("table_name", "domain", "target_column",
                    F.coalesce("hit_frame", "phrase").alias("target_frame")))


def column_tags(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """(table_name, tag, column_name): money (every numeric match), lat/lon/stock (first
    numeric match), location (first non-numeric match), delay (first match of any type)."""
    numeric = F.col("type_class") == "numeric"
    fits = {"money": numeric, "lat": numeric, "lon": numeric, "stock": numeric, "location": ~numeric, "delay": F.lit(True)}
    words = F.broadcast(rules.filter(F.col("rule").isin(*fits)).select(F.col("rule").alias("tag"), "keyword"))
    hits = catalog.join(words, _name_match(F.col("column_name"), F.col("keyword"), False))
    wanted = F.lit(False)
    for tag, cond in fits.items():
        wanted = wanted | ((F.col("tag") == tag) & cond)
    hits = hits.filter(wanted).select("table_name", "tag", "ordinal", "column_name").distinct()
    first = F.min("ordinal").over(Window.partitionBy("table_name", "tag"))  # columns of one table
    return (hits.withColumn("__first", first).filter((F.col("tag") == "money") | (F.col("ordinal") == F.col("__first")))
            .select("table_name", "tag", "column_name"))


def logistics_availability(catalog: DataFrame, tags: DataFrame) -> DataFrame:
    """Which logistics outputs are possible per table (pivot of the tag table)."""
    t = tags.groupBy("table_name").agg(*[
        F.max(F.when(F.col("tag") == k, F.col("column_name"))).alias(f"{k}_col")
        for k in ("lat", "lon", "location", "stock", "delay")])
    tables = catalog.select("table_name").distinct()
    d = tables.join(t, "table_name", "left")
    coords = F.col("lat_col").isNotNull() & F.col("lon_col").isNotNull()
    return d.select("table_name", coords.alias("has_real_coords"), "lat_col", "lon_col",
                    F.col("location_col").alias("categorical_location_col"), "stock_col", "delay_col",
                    (coords | F.col("location_col").isNotNull()).alias("map_possible"),
                    F.col("stock_col").isNotNull().alias("inventory_possible"))


def goal_labels(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """(domain, goal) -> label, unknown domain falls back to 'general', unknown goal
    to the default goal."""
    req = requests.select(
        F.lower(F.trim(F.col("domain"))).alias("req_domain"), F.lower(F.col("goal")).alias("req_goal"),
        *[c for c in requests.columns if c not in ("domain", "goal")])
    known_d = labels.select(F.col("domain").alias("kd")).distinct()
    known_g = labels.select(F.col("goal").alias("kg")).distinct()
    r = (req.join(F.broadcast(known_d), F.col("req_domain") == F.col("kd"), "left")
         .join(F.broadcast(known_g), F.col("req_goal") == F.col("kg"), "left")
         .withColumn("eff_domain", F.coalesce("kd", F.lit("general")))
         .withColumn("eff_goal", F.coalesce("kg", F.lit(V.DEFAULT_GOAL))))
    lab = labels.select(F.col("domain").alias("eff_domain"), F.col("goal").alias("eff_goal"), "goal_label")
    return r.join(F.broadcast(lab), ["eff_domain", "eff_goal"], "left").drop("kd", "kg")


def vocab_for(requests: DataFrame, vocab: DataFrame) -> DataFrame:
    """``requests`` (with a ``domain``) and the words of that domain; an unknown, missing
    or differently written domain (case, spaces) falls back to 'general' or its own words."""
    known = vocab.select(F.col("domain").alias("__known"))
    words = vocab.withColumnRenamed("domain", "eff_domain")
    r = requests.join(F.broadcast(known), F.lower(F.trim(F.col("domain"))) == F.col("__known"), "left").withColumn(
        "eff_domain", F.coalesce("__known", F.lit("general"))).drop("__known")
    return r.join(F.broadcast(words), "eff_domain")  # one row per domain
