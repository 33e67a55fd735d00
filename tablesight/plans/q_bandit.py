"""Checked queries for the contextual bandit (H1-H8).

The logged table comes from events: context = standardised value and hour plus
an intercept, arms = event types (sorted codes), the logged arm is the variant that
the event's user belongs to (user_id mod 5), reward = logged arm equals the event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import bandit as H
from ..operators.features import encode_target, fit_target, standardize
from .registry import register
from .tables import load

N_ARMS = 5


def _context(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "user_id", "value", F.hour("ts").cast("double").alias("hour"),
                                          "event_type")
    z, _ = standardize(ev, ["value", "hour"], suffix="_z")
    enc = fit_target(z, "event_type")
    z = encode_target(z, "event_type", enc)
    return z.select("event_id", "user_id", H.with_intercept(F.array("value_z", "hour_z")).alias("x"), "label"), len(enc.labels)


def _logged(spark, sf):
    ctx, n_arms = _context(spark, sf)
    arm = F.pmod(F.col("user_id"), F.lit(n_arms)).cast("int")
    return ctx.withColumn("arm", arm).withColumn("reward", (F.col("arm") == F.col("label")).cast("double")), n_arms


_LOG = f"""WITH e AS (SELECT event_id, user_id, value, CAST(hour(ts) AS DOUBLE) AS hour, event_type FROM events),
s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(hour) AS mh, stddev_pop(hour) AS sh FROM e),
lab AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code
        FROM (SELECT DISTINCT event_type FROM e)),
lg AS (SELECT e.event_id, [(value - mv) / sv, (hour - mh) / sh, 1.0] AS x,
              CAST(user_id % {N_ARMS} AS INTEGER) AS arm, lab.code AS label
       FROM e CROSS JOIN s JOIN lab ON e.event_type = lab.event_type),
lr AS (SELECT *, CAST(arm = label AS DOUBLE) AS reward FROM lg),
st AS (SELECT *, row_number() OVER (ORDER BY event_id) AS step FROM lr)"""


@register("bandit_reward", _LOG + " SELECT event_id, arm, reward FROM lr")
def q_bandit_reward(spark, sf):
    lg, _ = _logged(spark, sf)
    return lg.select("event_id", "arm", "reward")


@register("bandit_sufficient_stats", _LOG + """
SELECT arm, 'A' AS kind, CAST(i * 3 + j AS INTEGER) AS idx, round(sum(x[i + 1] * x[j + 1]), 6) AS value
FROM lr, range(0, 3) a(i), range(0, 3) b(j) GROUP BY arm, i, j
UNION ALL
SELECT arm, 'b', CAST(i AS INTEGER), round(sum(reward * x[i + 1]), 6) FROM lr, range(0, 3) a(i) GROUP BY arm, i""")
def q_bandit_sufficient_stats(spark, sf):
    lg, _ = _logged(spark, sf)
    return round_doubles(H.sufficient_stats(lg, "arm", "x", "reward", 3))


@register("final_window_reward", _LOG + f""",
nn AS (SELECT count(*) AS n, greatest(50, floor(count(*) / 5)) AS w FROM st)
SELECT CAST(n AS BIGINT) AS n_steps, CAST(w AS BIGINT) AS "window", round(avg(reward), 6) AS final_reward,
       round(1.0 / {N_ARMS}, 6) AS baseline, round(avg(reward) - 1.0 / {N_ARMS}, 6) AS lift,
       CASE WHEN avg(reward) - 1.0 / {N_ARMS} > 0.3 THEN 'fuerte' WHEN avg(reward) - 1.0 / {N_ARMS} > 0.1
            THEN 'moderada' ELSE 'leve' END AS quality
FROM st, nn WHERE step > n - w GROUP BY n, w""")
def q_final_window_reward(spark, sf):
    lg, n_arms = _logged(spark, sf)
    return round_doubles(H.final_window_reward(H.with_steps(lg.select("event_id", "reward"), ["event_id"]), n_arms))


@register("reward_curve", _LOG + """
SELECT CAST(step AS BIGINT) AS step, round(avg(reward) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING
       AND CURRENT ROW), 6) AS cum_mean FROM st""")
def q_reward_curve(spark, sf):
    lg, _ = _logged(spark, sf)
    return round_doubles(H.reward_curve(H.with_steps(lg.select("event_id", "reward"), ["event_id"])))


def _run(spark, sf):
    ctx, n_arms = _context(spark, sf)
    return H.run_rounds(ctx, "event_id", "x", "label", n_arms, dim=3)


@register("bandit_rounds")
def q_bandit_rounds(spark, sf):
    run = _run(spark, sf)
    return run.rewards.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))


@register("bandit_score")
def q_bandit_score(spark, sf):
    run = _run(spark, sf)
    inv, theta = run.state.solve()
    ctx, _ = _context(spark, sf)
    return ctx.select("event_id", H.choose_arm(F.col("x"), inv, theta).alias("arm"), "label")
