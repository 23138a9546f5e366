"""Decisions (DEC), strategy evaluation (EV) and blends (part of ML) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.operators import decisions as D, metrics as M, strategies as S
from duelframe.operators.entity import impact_with_fallback
from duelframe.plans.link_queries import impact_list, members, slot_diff
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.plans.windows_queries import picks
from duelframe.session import cut_lineage
from duelframe.sources import adapters as A

_FAIR = "(1 / h2h_home) / (1 / h2h_home + 1 / h2h_away)"


@query(
    "dec01_implied_margin",
    f"SELECT match_id, hp AS home_prob, ap AS away_prob, CAST(round_even(abs(hp - ap) * 25, 1) AS DOUBLE) AS implied_margin FROM (SELECT match_id, {_FAIR} AS hp, (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away) AS ap FROM odds)",
    "home_prob away_prob implied_margin",
)
def dec01(spark, sf):
    return A.odds(spark, sf).select("match_id", *[c.alias(n) for n, c in D.implied("h2h_home", "h2h_away").items()])


@query(
    "dec02_category",
    "SELECT match_id, CASE WHEN p >= 0.65 THEN 'LOCK' WHEN p >= 0.55 THEN 'LEAN' ELSE 'TOSS-UP' END AS category FROM (SELECT match_id, greatest(odds_prob, 1 - odds_prob) AS p FROM predictions WHERE odds_prob IS NOT NULL)",
)
def dec02(spark, sf):
    p = A.predictions(spark, sf).filter("odds_prob is not null")
    return p.select("match_id", D.category(F.greatest(F.col("odds_prob"), 1 - F.col("odds_prob"))).alias("category"))


define(
    "decision_base",
    """
SELECT p.*, o.h2h_home, o.h2h_away, CASE WHEN p.match_id % 3 <> 0 THEN p.line_home_open END AS spread_home, CASE WHEN p.match_id % 10 <> 0 THEN p.model_prob END AS model_known
FROM predictions p JOIN odds o USING (match_id)""",
)
define(
    "decided",
    f"""
SELECT *, CASE WHEN category = 'LEAN' AND dis AND against > 0.52 THEN other WHEN category = 'TOSS-UP' AND model_known IS NOT NULL THEN CASE WHEN model_known > 0.5 THEN home_id ELSE away_id END ELSE fav END AS tip,
       CASE WHEN category = 'LOCK' THEN CASE WHEN fav_prob >= 0.75 THEN 4 ELSE 3 END WHEN category = 'LEAN' THEN CASE WHEN model_known IS NOT NULL AND NOT dis THEN 3 ELSE 2 END
            WHEN model_known IS NOT NULL THEN 2 ELSE 1 END AS confidence,
       CASE WHEN category = 'LEAN' AND dis AND against > 0.52 THEN 'MODEL FLIP' WHEN category = 'TOSS-UP' AND model_known IS NOT NULL THEN 'MODEL' ELSE 'ODDS' END AS source,
       CASE WHEN spread_home IS NOT NULL THEN abs(round_even(spread_home, 0)) ELSE round_even(abs(hp - (1 - hp)) * 25, 1) END AS margin
FROM (SELECT *, CASE WHEN fav_prob >= 0.65 THEN 'LOCK' WHEN fav_prob >= 0.55 THEN 'LEAN' ELSE 'TOSS-UP' END AS category,
             coalesce((model_known > 0.5) <> fav_home, false) AS dis, CASE WHEN fav_home THEN 1 - model_known ELSE model_known END AS against
      FROM (SELECT *, {_FAIR} AS hp, {_FAIR} > (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away) AS fav_home,
                   greatest({_FAIR}, (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away)) AS fav_prob,
                   CASE WHEN {_FAIR} > (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away) THEN home_id ELSE away_id END AS fav,
                   CASE WHEN {_FAIR} > (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away) THEN away_id ELSE home_id END AS other
            FROM decision_base))""",
)


def decision_base(spark, sf):
    o = A.odds(spark, sf).select("match_id", "h2h_home", "h2h_away")
    return A.predictions(spark, sf).join(o, "match_id").withColumns(
        {
            "spread_home": F.when(F.col("match_id") % 3 != 0, F.col("line_home_open")),
            "model_known": F.when(F.col("match_id") % 10 != 0, F.col("model_prob")),
        }
    )


@query(
    "dec03_decision_rule",
    "SELECT match_id, tip, category, confidence, source, CAST(margin AS DOUBLE) AS margin, fav AS favourite, fav_prob AS favourite_prob FROM decided",
    "margin favourite_prob",
)
def dec03(spark, sf):
    d = D.decide("h2h_home", "h2h_away", "model_known", "spread_home")
    return decision_base(spark, sf).withColumn("_d", d).select("match_id", "_d.*")


@query(
    "dec04_winning_margin",
    """
SELECT match_id, CASE WHEN s IS NULL THEN 12.0::DOUBLE ELSE greatest(2, round_even((s * 0.54::DOUBLE + 12.3::DOUBLE) / 2, 0) * 2) END AS margin
FROM (SELECT match_id, coalesce(abs(CASE WHEN match_id % 3 <> 0 THEN line_home_open END), abs(odds_prob - 0.5) * 2 * 20) AS s FROM predictions)""",
    "margin",
)
def dec04(spark, sf):
    p = A.predictions(spark, sf)
    spread = F.when(F.col("match_id") % 3 != 0, F.col("line_home_open"))
    return p.select("match_id", D.winning_margin(spread, "odds_prob").alias("margin"))


define(
    "missing_raw",
    """
SELECT d.match_id, coalesce(sum(-coalesce(w.impact, 0)) FILTER (WHERE l.side = 'home'), 0) AS home_raw, coalesce(sum(-coalesce(w.impact, 0)) FILTER (WHERE l.side = 'away'), 0) AS away_raw, count(*) AS changes
FROM slot_diff d JOIN log l USING (match_id, entity_id) LEFT JOIN wanted_impact w ON w.entity_id = d.entity_id AND w.member_name = d.expected GROUP BY 1""",
)
_SHIFT = "greatest(-0.15::DOUBLE, least(0.15::DOUBLE, greatest(-0.15::DOUBLE, least(0.15::DOUBLE, home_raw)) - greatest(-0.15::DOUBLE, least(0.15::DOUBLE, away_raw))))"


def missing_raw(spark, sf):
    changes = slot_diff(spark, sf)
    known = cut_lineage(members(spark, sf))  # read by both sides of the lookup
    wanted = known.select("entity_id", "member_name").distinct()
    impact = impact_with_fallback(wanted, impact_list(spark, sf, known))
    m = A.matches(spark, sf)
    sides = m.select("match_id", F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_id").alias("entity_id")),
        F.struct(F.lit("away").alias("side"), F.col("away_id").alias("entity_id")),
    )).alias("s")).select("match_id", "s.*")
    return D.missing_impact(changes, impact, sides)


@query(
    "dec05_lineup_adjustment",
    f"""
SELECT match_id, prob, np AS new_prob, np >= 0.5 AS tip_home, abs(np - 0.5) * 2 AS confidence FROM (
 SELECT match_id, prob, CASE WHEN abs(s) > 0.001 THEN greatest(0.05, least(0.95, prob + s)) ELSE prob END AS np
 FROM (SELECT p.match_id, p.odds_prob AS prob, coalesce({_SHIFT}, 0) AS s FROM predictions p LEFT JOIN missing_raw USING (match_id) WHERE p.odds_prob IS NOT NULL))""",
    "prob new_prob confidence",
)
def dec05(spark, sf):
    p = A.predictions(spark, sf).filter("odds_prob is not null").select("match_id", F.col("odds_prob").alias("prob"))
    return D.adjust_for_lineups(p, missing_raw(spark, sf)).select("match_id", "prob", "new_prob", "tip_home", "confidence")


@query(
    "dec06_late_refresh",
    """
SELECT match_id, old_prob, np AS new_prob, close_prob - open_prob AS market_move, (np >= 0.5) <> (old_prob >= 0.5) AS is_flip FROM (
 SELECT *, greatest(0.01, least(0.99, 0.25::DOUBLE * coalesce(CASE WHEN match_id % 10 <> 0 THEN model_prob END, greatest(0.01, least(0.99, (old_prob - 0.75::DOUBLE * open_prob) / 0.25::DOUBLE))) + 0.75::DOUBLE * close_prob)) AS np
 FROM (SELECT *, 0.25::DOUBLE * model_prob + 0.75::DOUBLE * open_prob AS old_prob FROM predictions) WHERE abs(old_prob - 0.5) * 2 <= 0.2::DOUBLE AND close_prob IS NOT NULL)""",
    "old_prob new_prob market_move",
)
def dec06(spark, sf):
    p = A.predictions(spark, sf)
    blend = 0.25 * F.col("model_prob") + 0.75 * F.col("open_prob")
    old = p.select(
        "match_id", blend.alias("old_prob"), F.col("open_prob").alias("old_market"),
        F.when(F.col("match_id") % 10 != 0, F.col("model_prob")).alias("model_prob"),
    )
    fresh = p.filter("close_prob is not null").select("match_id", F.col("close_prob").alias("fresh_market"))
    return D.refresh_close_calls(old, fresh)


@query(
    "dec07_decision_payload",
    """
SELECT 'E' || match_id AS event_id, CAST(tip + 1000 AS BIGINT) AS external_id, CASE WHEN match_id % 2 = 0 THEN greatest(3, least(15, margin)) END AS margin
FROM decided JOIN orders ON o_orderkey = match_id WHERE o_orderstatus = 'O'""",
    "margin",
)
def dec07(spark, sf):
    decided = dec03(spark, sf).select("match_id", "tip", "margin")
    events = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.when(F.col("o_orderstatus") == "O", "PRE").otherwise("post").alias("status"),
        (F.col("o_orderkey") % 2 == 0).alias("margin_required"),
        F.lit(3).alias("margin_min"),
        F.lit(15).alias("margin_max"),
    )
    ids = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("tip"), (F.col("n_nationkey") + 1000).cast("long").alias("external_id"))
    return D.payload(decided, events, ids)


@query(
    "dec08_day_schedule",
    """
SELECT CAST(ts AS DATE) AS day, count(*) AS games, min(ts) - INTERVAL 3 HOUR AS deadline, min(ts) - INTERVAL 2 HOUR AS check_start, max(ts) + INTERVAL 30 MINUTE AS check_end,
       min(ts) - INTERVAL 90 MINUTE AS repredict_at FROM events GROUP BY 1""",
)
def dec08(spark, sf):
    return D.day_schedule(A.table(spark, sf, "events").select("ts"), "ts")


@query(
    "dec09_pre_start_check",
    f"""
SELECT match_id, changes, np - prob AS prob_shift, np AS new_prob, CASE WHEN (np >= 0.5) <> (prob >= 0.5) AND abs(prob - 0.5) * 2 > 0.2::DOUBLE THEN prob >= 0.5 ELSE np >= 0.5 END AS tip_home,
       (np >= 0.5) <> (prob >= 0.5) AND NOT (abs(prob - 0.5) * 2 > 0.2::DOUBLE) AS is_swing
FROM (SELECT p.match_id, changes, odds_prob AS prob, greatest(0.05, least(0.95, odds_prob + {_SHIFT} * CASE WHEN round <= 1 THEN 0.25 ELSE 1 END)) AS np
      FROM predictions p JOIN missing_raw USING (match_id) WHERE odds_prob IS NOT NULL)""",
    "prob_shift new_prob",
)
def dec09(spark, sf):
    p = A.predictions(spark, sf).filter("odds_prob is not null").select("match_id", "round", F.col("odds_prob").alias("prob"))
    return D.pre_start_check(p, missing_raw(spark, sf), auto=True)


# ---- strategies ------------------------------------------------------------------------------

_STRATEGIES = {"favourite": "odds_prob", "model": "model_prob"}
for _w in (0.10, 0.20, 0.30, 0.40, 0.495, 0.60, 0.70):
    _STRATEGIES[f"blend_{_w}"] = f"{_w!r}::DOUBLE * model_prob + {1.0 - _w!r}::DOUBLE * odds_prob"
for _l in (0.60, 0.65, 0.70):
    _STRATEGIES[f"tiered_{_l}"] = f"CASE WHEN abs(odds_prob - 0.5) * 2 >= {(_l - 0.5) * 2!r}::DOUBLE THEN odds_prob ELSE 0.7::DOUBLE * model_prob + 0.3::DOUBLE * odds_prob END"
_START = "(0.495::DOUBLE * model_prob + 0.505::DOUBLE * open_prob)"
_STRATEGIES["open_blend"] = f"CASE WHEN close_prob IS NOT NULL THEN {_START} END"
for _l in (0.55, 0.60, 0.65):
    _STRATEGIES[f"late_{_l}"] = (
        f"CASE WHEN close_prob IS NOT NULL THEN CASE WHEN abs({_START} - 0.5) * 2 < {(_l - 0.5) * 2!r}::DOUBLE THEN 0.495::DOUBLE * model_prob + 0.505::DOUBLE * close_prob ELSE {_START} END END"
    )
for _b, _c in ((0.30, 0.70), (0.20, 0.60), (0.10, 0.80)):
    _wt = f"({_c}::DOUBLE - {_c - _b!r}::DOUBLE * (abs(odds_prob - 0.5) * 2))"
    _STRATEGIES[f"adaptive_{_b}_{_c}"] = f"{_wt} * model_prob + (1 - {_wt}) * odds_prob"


@query(
    "ev01_strategy_backtest",
    " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, count(*) FILTER (WHERE (p >= 0.5) = (home_win = 1)) AS correct, count(*) AS games FROM (SELECT home_win, {e} AS p FROM picks) WHERE p IS NOT NULL"
        for n, e in _STRATEGIES.items()
    ),
)
def ev01(spark, sf):
    return S.strategy_record(picks(spark, sf), S.strategy_probabilities())


@query(
    "ev01_best_fixed_weight",
    """
SELECT arg_max(step, correct * 1000 - step) AS best_step, max(correct) AS correct FROM (
 SELECT w AS step, count(*) FILTER (WHERE (w * 0.01::DOUBLE * model_prob + (1 - w * 0.01::DOUBLE) * odds_prob >= 0.5) = (home_win = 1)) AS correct FROM picks CROSS JOIN range(0, 101) g(w) GROUP BY 1)""",
)
def ev01b(spark, sf):
    grid = D.weight_grid(picks(spark, sf), 100)
    return grid.agg(
        F.max_by("step", F.struct("correct", (-F.col("step")).alias("s"))).alias("best_step"), F.max("correct").alias("correct")
    )


@query(
    "ev03_tier_record",
    "SELECT category AS tier, count(*) AS games, CAST(sum(odds_correct) AS BIGINT) AS odds_correct, CAST(sum(model_correct) AS BIGINT) AS model_correct, CAST(sum(tip_correct) AS BIGINT) AS tip_correct FROM categorised GROUP BY 1",
)
def ev03(spark, sf):
    return S.tier_record(picks(spark, sf))


@query(
    "ev03_disagreements",
    """
SELECT CASE WHEN abs(model_prob - odds_prob) < 0.05 THEN 'slight' WHEN abs(model_prob - odds_prob) < 0.10 THEN 'moderate' ELSE 'strong' END AS size,
       count(*) AS games, CAST(sum(odds_correct) AS BIGINT) AS odds_right, CAST(sum(model_correct) AS BIGINT) AS model_right FROM categorised WHERE odds_pick <> model_pick GROUP BY 1""",
)
def ev03b(spark, sf):
    return S.disagreements(picks(spark, sf))


@query(
    "ev04_late_prices",
    """
SELECT year, threshold, count(*) AS games, count(*) FILTER (WHERE oh = won) AS open_correct, count(*) FILTER (WHERE ch = won) AS close_correct,
       count(*) FILTER (WHERE CASE WHEN near THEN ch ELSE oh END = won) AS selective_correct, count(*) FILTER (WHERE near AND ch <> oh) AS flips, count(*) FILTER (WHERE near AND ch <> oh AND ch = won) AS right_flips,
       count(*) FILTER (WHERE CASE WHEN sign(open_prob - 0.5) <> sign(close_prob - 0.5) THEN ch ELSE oh END = won) AS drift_correct,
       count(*) FILTER (WHERE abs(close_prob - open_prob) > 0.02) AS moved, count(*) FILTER (WHERE abs(close_prob - open_prob) > 0.02 AND (close_prob > open_prob) = won) AS moved_to_winner,
       count(*) FILTER (WHERE near) AS close_games
FROM (SELECT year, t AS threshold, open_prob, close_prob, home_win = 1 AS won, open_prob >= 0.5 AS oh, close_prob >= 0.5 AS ch, open_prob BETWEEN 1 - t AND t AS near
      FROM picks CROSS JOIN (SELECT unnest([0.52::DOUBLE, 0.53::DOUBLE, 0.54::DOUBLE, 0.55::DOUBLE, 0.57::DOUBLE, 0.60::DOUBLE, 0.65::DOUBLE]) AS t) WHERE open_prob IS NOT NULL AND close_prob IS NOT NULL) GROUP BY 1, 2""",
)
def ev04(spark, sf):
    return S.late_prices(picks(spark, sf))


@query(
    "ev05_lineup_grid",
    """
SELECT cap, guard, count(*) AS games, count(*) FILTER (WHERE bh = won) AS base_correct, count(*) FILTER (WHERE CASE WHEN nh <> bh AND sure > guard THEN bh ELSE nh END = won) AS adjusted_correct,
       count(*) FILTER (WHERE nh <> bh AND sure <= guard) AS swings, count(*) FILTER (WHERE nh <> bh AND sure <= guard AND nh = won) AS right_swings,
       count(*) FILTER (WHERE abs(s) > 0.001) AS moved, count(*) FILTER (WHERE abs(s) > 0.001 AND (s > 0) = won) AS right_direction
FROM (SELECT *, greatest(0.05, least(0.95, odds_prob + s)) >= 0.5 AS nh FROM (
  SELECT p.match_id, odds_prob, odds_prob >= 0.5 AS bh, home_win = 1 AS won, abs(odds_prob - 0.5) * 2 AS sure, cap, guard,
         greatest(-cap, least(cap, greatest(-0.15::DOUBLE, least(0.15::DOUBLE, home_raw)) - greatest(-0.15::DOUBLE, least(0.15::DOUBLE, away_raw)))) AS s
  FROM picks p JOIN missing_raw USING (match_id) CROSS JOIN (SELECT unnest([0.03::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE, 0.15::DOUBLE]) AS cap) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.10::DOUBLE, 0.20::DOUBLE, 0.30::DOUBLE]) AS guard)))
GROUP BY 1, 2""",
)
def ev05(spark, sf):
    games = picks(spark, sf).select("match_id", F.col("odds_prob").alias("base_prob"), "home_win").join(missing_raw(spark, sf), "match_id")
    return S.lineup_grid(games, (0.03, 0.05, 0.10, 0.15), (0.0, 0.10, 0.20, 0.30))


define(
    "round_log",
    """
SELECT year AS season, round, match_id, category, tip, home_score, away_score, w AS winner, CAST(coalesce(tip = w, false) AS INTEGER) AS tip_correct,
       CAST(coalesce(CASE WHEN model_known > 0.5 THEN home_id ELSE away_id END = w, false) AS INTEGER) AS model_correct,
       CAST(coalesce(CASE WHEN odds_prob > 0.5 THEN home_id ELSE away_id END = w, false) AS INTEGER) AS fav_correct,
       CAST(CASE WHEN model_known > 0.5 THEN home_id ELSE away_id END = CASE WHEN odds_prob > 0.5 THEN home_id ELSE away_id END AS INTEGER) AS model_agreed_odds
FROM (SELECT *, CASE WHEN home_score > away_score THEN home_id WHEN home_score < away_score THEN away_id END AS w FROM decided) WHERE home_score IS NOT NULL""",
)


@query("ev06_round_log", "SELECT * FROM round_log")
def ev06(spark, sf):
    base = decision_base(spark, sf).withColumn("model_prob", F.col("model_known"))
    return D.record_round(base)


@query(
    "ev07_drift_alarm",
    """
SELECT year, avg(tip_correct) AS recent_accuracy, avg(odds_correct) AS recent_odds_accuracy, avg(odds_correct) - avg(tip_correct) > 0.05::DOUBLE AS alarm
FROM (SELECT *, dense_rank() OVER (PARTITION BY year ORDER BY round DESC) AS k FROM picks) WHERE k <= 3 GROUP BY 1""",
    "recent_accuracy recent_odds_accuracy",
)
def ev07(spark, sf):
    p = picks(spark, sf)
    return D.drift_alarm(M.season_metrics(p).select("year"), M.recent_form(p))


# ---- blends ----------------------------------------------------------------------------------

define(
    "oof",
    """
SELECT match_id, year AS fold, home_win AS label, odds_prob AS market, 'a' AS model, model_prob AS prob FROM picks UNION ALL
SELECT p.match_id, p.year, p.home_win, p.odds_prob, 'b', (m.cents % 499 + 1) / 500.0::DOUBLE FROM picks p JOIN matches m USING (match_id)""",
)


def oof(spark, sf):
    """Two models' probabilities beside the market, by season."""
    cents = A.matches(spark, sf).select("match_id", ((F.col("cents") % 499 + 1) / F.lit(500.0)).alias("b"))
    wide = picks(spark, sf).join(cents, "match_id").select(
        "match_id", F.col("year").alias("fold"), F.col("home_win").alias("label"), F.col("odds_prob").alias("market"), F.col("model_prob").alias("a"), "b"
    )
    return wide.unpivot(["match_id", "fold", "label", "market"], ["a", "b"], "model", "prob")


def _ll(p: str) -> str:
    return f"-(label * ln(greatest(1e-7, least(1 - 1e-7, {p}))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, {p}))))"


_BLEND = "(w / 1000.0::DOUBLE * prob + (1 - w / 1000.0::DOUBLE) * market)"
define(
    "blend_loss",
    f"SELECT model, fold, CAST(w AS INTEGER) AS w, avg({_ll(_BLEND)}) AS log_loss FROM oof CROSS JOIN range(0, 505, 5) g(w) GROUP BY 1, 2, 3",
)


@query(
    "ml05_market_baseline",
    "SELECT match_id, coalesce(odds_prob, 0.55) AS prob FROM predictions",
    "prob",
)
def ml05(spark, sf):
    from duelframe.plans.backtest import market_model

    return market_model(A.predictions(spark, sf), "odds_prob").select("match_id", "prob")


@query(
    "ml08_blend_weight",
    "SELECT model, arg_min(w, ll) AS weight, min(ll) AS log_loss FROM (SELECT model, w, avg(log_loss) AS ll FROM blend_loss WHERE w BETWEEN 5 AND 495 GROUP BY 1, 2) GROUP BY 1",
    "log_loss",
)
def ml08(spark, sf):
    return S.best_blend(S.blend_losses(oof(spark, sf)))


define(
    "wf_weight",
    """
SELECT model, fold, CASE WHEN nth <= 2 THEN 150 ELSE w END AS weight FROM (
 SELECT model, fold, min(nth) AS nth, arg_min(w, sofar) AS w FROM (
  SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY fold) AS nth, avg(log_loss) OVER (PARTITION BY model, w ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sofar FROM blend_loss) GROUP BY 1, 2)""",
)


@query(
    "ml09_walk_forward_blend",
    f"SELECT model, fold, CAST(weight AS INTEGER) AS weight, avg({_ll('p')}) AS log_loss, count(*) AS games FROM (SELECT *, weight / 1000.0::DOUBLE * prob + (1 - weight / 1000.0::DOUBLE) * market AS p FROM oof JOIN wf_weight USING (model, fold)) GROUP BY 1, 2, 3",
    "log_loss",
)
def ml09(spark, sf):
    long = oof(spark, sf)
    blended = S.walk_forward_blend(long, S.walk_forward_weights(S.blend_losses(long, 0, 500)))
    return blended.groupBy("model", "fold", "weight").agg(
        F.avg(M.log_loss_of(F.col("prob"), F.col("label"))).alias("log_loss"), F.count(F.lit(1)).alias("games")
    )


define("oof_avg", "SELECT 'a+b' AS model, match_id, fold, min(label) AS label, min(market) AS market, avg(prob) AS prob FROM oof GROUP BY 2, 3")


@query(
    "ml10_model_average_blend",
    f"""
SELECT model, arg_min(w, ll) AS weight, min(ll) AS log_loss FROM (SELECT model, w, avg(l) AS ll FROM (
 SELECT model, fold, CAST(w AS INTEGER) AS w, avg({_ll(_BLEND)}) AS l FROM oof_avg CROSS JOIN range(5, 500, 5) g(w) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
    "log_loss",
)
def ml10(spark, sf):
    return S.best_blend(S.blend_losses(S.model_averages(oof(spark, sf), {"a+b": ["a", "b"]})))


@query(
    "ml11_multi_blend",
    f"""
SELECT wa / 50.0::DOUBLE AS weight_a, wb / 50.0::DOUBLE AS weight_b, ll AS log_loss FROM (
 SELECT wa, wb, avg(l) AS ll FROM (
  SELECT fold, wa, wb, avg({_ll('p')}) AS l FROM (
   SELECT *, (50 - wa - wb) / 50.0::DOUBLE * market + wa / 50.0::DOUBLE * a + wb / 50.0::DOUBLE * b AS p FROM
    (SELECT match_id, fold, label, market, max(CASE WHEN model = 'a' THEN prob END) AS a, max(CASE WHEN model = 'b' THEN prob END) AS b FROM oof GROUP BY 1, 2, 3, 4)
    CROSS JOIN range(0, 51) x(wa) CROSS JOIN range(0, 51) y(wb) WHERE wa + wb <= 50) GROUP BY 1, 2, 3) GROUP BY 1, 2)
ORDER BY ll, wa, wb LIMIT 1""",
    "weight_a weight_b log_loss",
)
def ml11(spark, sf):
    wide = oof(spark, sf).groupBy("match_id", "fold", "label", "market").pivot("model", ["a", "b"]).agg(F.max("prob"))
    return S.multi_blend(wide, ["a", "b"])
