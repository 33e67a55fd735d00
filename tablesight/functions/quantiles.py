"""Exact linear-interpolated quantiles by sketch-bracketed selection.

Spark's exact ``percentile`` keeps a value -> count map per group and merges it in one
task per group; ranking all values sorts the table. Here a value is only looked at again
if it can be an answer:

1. One pass makes a mergeable quantile sketch per (group, column) (``percentile_approx``).
   Its values a little below and above each probability bracket the wanted order
   statistics: the margin is three times the sketch's rank error.
2. A second pass counts the values below each bracket and keeps those inside it, counted
   per distinct value: about ``6 / ACCURACY`` of the values, or all of a (group, column)
   with at most ``SMALL`` of them. Nothing else is shuffled.
3. The counts prove the bracket (wanted positions lie inside) and rank its values. Were a
   bracket wrong, the pass would be repeated with open brackets, so the result is exact
   whatever the sketch does.

Interpolation is q = v[lo] * (hi - pos) + v[hi] * (pos - lo) with pos = p (n - 1), the
rule of ``percentile``. Nulls are ignored; NaN is larger than any other value.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .columns import col
from .ordered import running_sums

#: Accuracy of the sketch: its rank error is 1 / ACCURACY of the values.
ACCURACY = 1_000
#: All values of a (group, column) with at most this many are inside the bracket.
SMALL = 10_000
#: Distinct values inside a bracket that one task ranks; more are ranked over ranges.
RANKED = 1_000_000
#: Parts of a group's bracket, ranked apart.
PARTS = 64


def _margins(probs: Sequence[float]) -> list[float]:
    wide = 3.0 / ACCURACY
    return [x for p in probs for x in (max(0.0, p - wide), min(1.0, p + wide))]


def _between(n: Column, p: float, low: Column, high: Column) -> Column:
    """The quantile from the values at the positions around it."""
    pos = F.lit(float(p)) * (n - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    return F.when(lo == hi, low).otherwise((hi - pos) * low + (pos - lo) * high)


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Column name -> exact quantiles; columns without values are left out. What comes to the
    driver are a sketch's values, counts and order statistics per column and probability."""
    if not columns:
        return {}
    x = [col(c).cast("double") for c in columns]
    margins = _margins(probs)
    row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x)],
                 *[F.percentile_approx(v, margins, ACCURACY).alias(f"b{i}") for i, v in enumerate(x)]).first()
    sizes = {i: row[f"n{i}"] for i in range(len(columns)) if row[f"n{i}"]}
    # a bracket (column, low, high) and the positions wanted from it; all values are inside an open one
    wanted: dict[tuple, set[int]] = {}
    for i, n in sizes.items():
        for j, p in enumerate(probs):
            pos = p * (n - 1)
            bracket = (i, None, None) if n <= SMALL else (i, row[f"b{i}"][2 * j], row[f"b{i}"][2 * j + 1])
            wanted.setdefault(bracket, set()).update((math.floor(pos), math.ceil(pos)))
    at, wrong = _selected(df, x, sizes, wanted)
    if wrong:
        more, _ = _selected(df, x, sizes, {(i, None, None): set().union(*(w for b, w in wrong.items() if b[0] == i)) for i, _, _ in wrong})
        at.update(more)
    out = {}
    for i, n in sizes.items():
        out[columns[i]] = q = []
        for p in probs:
            pos = p * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            q.append(at[i, lo] if lo == hi else (hi - pos) * at[i, lo] + (pos - lo) * at[i, hi])
    return out


def _selected(df: DataFrame, x: list[Column], sizes: dict[int, int], wanted: dict[tuple, set[int]]) -> tuple[dict, dict]:
    """Values at the wanted positions by (column, position), and the brackets that do not hold theirs."""
    closed = [b for b in wanted if b[1] is not None]
    below, inside = dict.fromkeys(wanted, 0), {b: sizes[b[0]] for b in wanted}
    if closed:
        row = df.agg(*[F.count(F.when(x[i] < F.lit(lo), 1)) for i, lo, _ in closed],
                     *[F.count(F.when(x[i] <= F.lit(hi), 1)) for i, _, hi in closed]).first()
        for k, b in enumerate(closed):
            below[b], inside[b] = row[k], row[k + len(closed)] - row[k]
    wrong = {b: w for b, w in wanted.items() if min(w) < below[b] or max(w) >= below[b] + inside[b]}
    at = {(b[0], p): b[1] for b, w in wanted.items() if b not in wrong and b[1] is not None and b[1] == b[2] for p in w}
    open_ = [b for b in wanted if b not in wrong and (b[1] is None or b[1] != b[2])]
    if open_:
        held = [x[i].isNotNull() if lo is None else (x[i] >= F.lit(lo)) & (x[i] <= F.lit(hi)) for i, lo, hi in open_]
        any_held = held[0]
        for h in held[1:]:
            any_held = any_held | h
        cells = df.filter(any_held).select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("k"), F.when(h, x[b[0]]).alias("v")) for k, (b, h) in enumerate(zip(open_, held))])))
        counts = cells.filter(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
        if max(inside[b] for b in open_) <= RANKED:
            ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("v")))
        else:
            ranked = running_sums(counts, ["v"], {"upto": F.col("c")}, partition_by=["k"])
        places = df.sparkSession.createDataFrame([(k, p - below[b], p) for k, b in enumerate(open_) for p in wanted[b]],
                                                 "pk int, place long, position long")
        hit = ranked.join(F.broadcast(places), (F.col("k") == F.col("pk")) & (F.col("place") < F.col("upto"))
                          & (F.col("place") >= F.col("upto") - F.col("c")))  # a row per wanted position: bounded by the parameters
        at.update({(open_[r["k"]][0], r["position"]): r["v"] for r in hit.select("k", "position", "v").collect()})
    return at, wrong


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back: later steps neither compute it
    again nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quantiles-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     group_by: Sequence[str] = ()) -> DataFrame:
    """(group..., column_name, n, q): exact linear quantiles of several columns at once, ``q``
    an array aligned with ``probs``. A group with a null key is a group too; a (group,
    column) without values has no row."""
    g = list(group_by)
    if not g:
        found = quantile_map(df, columns, probs)
        sizes = df.agg(*[F.count(col(c).cast("double")).alias(c) for c in found]).first() if found else {}
        return df.sparkSession.createDataFrame([(c, sizes[c], q) for c, q in found.items()], "column_name string, n long, q array<double>")
    wide = group_quantiles(df, columns, probs, g)
    cells = wide.select(*[col(c) for c in g], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"__n{i}").alias("n"), F.col(f"__q{i}").alias("q")) for i, c in enumerate(columns)])))
    return cells.filter(F.col("n") > 0)


def group_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_by: Sequence[str],
                    also: Sequence[Column] = ()) -> DataFrame:
    """One row per group: the group columns, ``__n0, __q0, __n1, ...`` (number of values and
    exact quantiles of each column; null without values), and the aggregates ``also``, which
    are computed in the sketch's pass."""
    g = [col(c) for c in group_by]
    # the keys as one JSON text, so that null keys compare equal
    key = F.to_json(F.struct(*g), {"ignoreNullFields": "false"})
    x = [col(c).cast("double") for c in columns]
    margins = _margins(probs)
    sketch = _stored(df.groupBy(*g).agg(
        *[F.count(v).alias(f"__n{i}") for i, v in enumerate(x)],
        *[F.percentile_approx(v, margins, ACCURACY).alias(f"__b{i}") for i, v in enumerate(x)], *also).withColumn("__k", key))
    base = df.select(key.alias("__key"), *[v.alias(f"__x{i}") for i, v in enumerate(x)])
    joined = base.join(sketch.select("__k", *[f"__{s}{i}" for s in "nb" for i in range(len(x))]), F.col("__key") == F.col("__k"))
    for small in (SMALL, None):
        counts = _stored(_inside_counts(joined, len(x), len(probs), small))
        picks = _stored(_group_picks(counts, sketch, len(columns), probs, small))  # a row per group, read twice
        # brackets hold their positions unless the sketch broke its bound
        bad = picks.filter(" or ".join(f"(__n{i} > 0 and exists(__q{i}, q -> q is null))" for i in range(len(x))))
        if small is None or bad.isEmpty():
            break
    kept = [c for c in sketch.columns if not c.startswith(("__b", "__n")) and c != "__k"]
    return picks.select(*[col(c) for c in kept], *[f"__{s}{i}" for i in range(len(x)) for s in "nq"])


def _inside_counts(joined: DataFrame, n_columns: int, n_probs: int, small: int | None) -> DataFrame:
    """(k, i, j, part, v, c): counted values inside bracket j of column i, in ``PARTS`` parts of
    equal width, and a row with part -1 for the values below. Small groups have bracket 0 alone."""
    cells = []
    for i in range(n_columns):
        x, n, b = F.col(f"__x{i}"), F.col(f"__n{i}"), F.col(f"__b{i}")
        is_open = F.lit(True) if small is None else n <= small
        for j in range(n_probs):
            lo, hi = F.get(b, F.lit(2 * j)), F.get(b, F.lit(2 * j + 1))
            part = F.floor(F.try_divide(x - lo, hi - lo) * PARTS)
            part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.coalesce(F.nanvl(part.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int")))
            place = F.when(is_open, F.lit(0) if j == 0 else None).when(x < lo, F.lit(-1)).when(x <= hi, part)
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(x.isNotNull(), place).alias("part"), x.alias("x")))
    rows = joined.select("__k", F.inline(F.array(*cells))).filter(F.col("part").isNotNull())
    return rows.groupBy("__k", "i", "j", "part", F.when(F.col("part") >= 0, F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def _group_picks(counts: DataFrame, sketch: DataFrame, n_columns: int, probs: Sequence[float], small: int | None) -> DataFrame:
    """``sketch`` with ``__q{i}``. Only the parts that hold a wanted position are ranked."""
    sizes = sketch.select(F.col("__k").alias("__gk"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("gi"), F.col(f"__n{i}").alias("n")) for i in range(n_columns)])))
    totals = counts.groupBy("__k", "i", "j", "part").agg(F.sum("c").alias("t"))
    totals = totals.withColumn("before", F.sum("t").over(Window.partitionBy("__k", "i", "j").orderBy("part")) - F.col("t"))
    totals = totals.join(sizes, (F.col("__k") == F.col("__gk")) & (F.col("i") == F.col("gi"))).drop("__gk", "gi")
    # of a small group, bracket 0 serves all probabilities
    is_open = F.lit(True) if small is None else F.col("n") <= small
    ends = []
    for j, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        ends += [F.when(is_open | (F.col("j") == j), at) for at in (F.floor(pos), F.ceil(pos))]
    # one array: Spark's inferred constraints double with every alias of an expression that is filtered on
    wanted = F.filter("ends", lambda a: (a >= F.col("before")) & (a < F.col("before") + F.col("t")))
    parts = totals.withColumn("ends", F.array(*ends)).filter((F.col("part") >= 0) & (F.size(wanted) > 0)).select(
        *[F.col(c).alias(f"p_{c}") for c in ("__k", "i", "j", "part")], "before", "ends")
    same = [F.col(c) == F.col(f"p_{c}") for c in ("__k", "i", "j", "part")]
    ranked = counts.join(parts, same[0] & same[1] & same[2] & same[3]).withColumn(
        "upto", F.col("before") + F.sum("c").over(Window.partitionBy("__k", "i", "j", "part").orderBy("v")))

    def at(m: int) -> Column:
        end = F.get("ends", F.lit(m))
        return F.when((end < F.col("upto")) & (end >= F.col("upto") - F.col("c")), F.col("v"))

    found = ranked.groupBy(F.col("__k").alias("__pk"), "i").agg(*[F.max(at(m)).alias(f"v{m}") for m in range(2 * len(probs))])
    row = found.groupBy("__pk").agg(*[F.max(F.when(F.col("i") == i, F.struct(*[f"v{m}" for m in range(2 * len(probs))]))).alias(f"__v{i}")
                                      for i in range(n_columns)])
    out = sketch.join(row, F.col("__k") == F.col("__pk"), "left")
    for i in range(n_columns):
        n, v = F.col(f"__n{i}"), F.col(f"__v{i}")
        q = F.array(*[_between(n, p, v[f"v{2 * j}"], v[f"v{2 * j + 1}"]) for j, p in enumerate(probs)])
        out = out.withColumn(f"__q{i}", F.when(n > 0, q))
    return out


def mode_map(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Column name -> most frequent non-null value, the smallest on ties. Values are counted
    by a grouped aggregate per column; one row per column comes to the driver."""
    out = {}
    for c in columns:
        counts = df.filter(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).first()
        if row["v"] is not None:
            out[c] = row["v"]
    return out
