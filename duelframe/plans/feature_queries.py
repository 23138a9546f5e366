"""Ratings (RT) and feature composites (FE) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.functions import numbers as N
from duelframe.operators import entity as E, features as X, groups as G, imputation as I, link as L, metrics as M, ratings as R, tables as T, windows as W
from duelframe.operators.sides import from_sides
from duelframe.plans import feature_table as FT
from duelframe.plans.aggregate_queries import expected_log
from duelframe.plans.common import log, member_games
from duelframe.plans.link_queries import PLACES, ground_name
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.plans.windows_queries import wide_sql
from duelframe.sources import adapters as A


@query(
    "rt02_margin_multiplier",
    "SELECT match_id, ln(greatest(abs(home_score - away_score), 1) + 1) AS log_weight, 1 + abs(home_score - away_score) / 10 AS linear_weight, CASE WHEN home_score IS NOT NULL THEN 1.0::DOUBLE END AS no_weight FROM matches WHERE home_score IS NOT NULL",
    "log_weight linear_weight no_weight",
)
def rt02(spark, sf):
    gap = F.col("home_score") - F.col("away_score")
    return A.matches(spark, sf).filter("home_score is not null").select(
        "match_id",
        R.margin_multiplier(gap, "log").alias("log_weight"),
        R.margin_multiplier(gap, "linear").alias("linear_weight"),
        R.margin_multiplier(gap, "none").cast("double").alias("no_weight"),
    )


# the fold as recursive SQL: one step per game and league, the state a list of 25 ratings
_REG = "CASE WHEN played AND last_season IS NOT NULL AND season > last_season THEN 1500 + 0.75::DOUBLE * (r - 1500) ELSE r END"
define(
    "chain",
    "SELECT league, match_id, year AS season, home_id, away_id, home_score, away_score, home_score IS NOT NULL AS played, "
    "row_number() OVER (PARTITION BY league ORDER BY event_date, match_id) AS n FROM matches",
)


def fold_sql(name: str, weight: str, k: str = "20.0::DOUBLE", bonus: str = "50", chain: str = "chain", keys: str = "league", late: bool = True) -> str:
    """One step per game and chain; ``weight`` is the margin multiplier, ``keys`` identify a chain.
    With ``late`` the ratings are read before a new season's regression, else after it."""
    read = "home_elo, away_elo, home_elo_prob" if late else f"h, a, 1 / (1 + power(10::DOUBLE, (a - h - {bonus}) / 400))"
    start = ", ".join(["1500.0::DOUBLE"] * 25)
    on = " AND ".join(f"c.{key} = f.{key}" for key in keys.split(", "))
    return f"""
  SELECT {keys}, 0::BIGINT AS n, NULL::BIGINT AS match_id, list_value({start}) AS state, NULL::INTEGER AS last_season,
         NULL::DOUBLE AS home_elo, NULL::DOUBLE AS away_elo, NULL::DOUBLE AS home_elo_prob, NULL::DOUBLE AS home_after, NULL::DOUBLE AS away_after
  FROM (SELECT DISTINCT {keys} FROM {chain}) l
  UNION ALL
  SELECT {keys}, n, match_id,
         CASE WHEN played THEN list_concat(list_concat(list_concat(list_concat(reg[1:lo], [CASE WHEN lo = home_id THEN h + d ELSE a - d END]),
              reg[lo + 2:hi]), [CASE WHEN hi = home_id THEN h + d ELSE a - d END]), reg[hi + 2:25]) ELSE state END,
         CASE WHEN played THEN season ELSE last_season END, {read},
         CASE WHEN played THEN h + d END, CASE WHEN played THEN a - d END
  FROM (
    SELECT *, {k} * {weight} * (CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END
              - 1 / (1 + power(10::DOUBLE, (a - h - {bonus}) / 400))) AS d
    FROM (SELECT *, reg[home_id + 1] AS h, reg[away_id + 1] AS a FROM (
      SELECT c.*, f.state, f.last_season, f.state[c.home_id + 1] AS home_elo, f.state[c.away_id + 1] AS away_elo,
             least(c.home_id, c.away_id) AS lo, greatest(c.home_id, c.away_id) AS hi,
             1 / (1 + power(10::DOUBLE, (f.state[c.away_id + 1] - f.state[c.home_id + 1] - {bonus}) / 400)) AS home_elo_prob,
             [{_REG} FOR r IN f.state] AS reg
      FROM {name} f JOIN {chain} c ON {on} AND c.n = f.n + 1)))"""


define(
    "chain_grid",
    """
SELECT c.*, CAST(ki * 4 + hi * 2 + mi AS INTEGER) AS config, [10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE][ki + 1] AS kf, hi * 50.0::DOUBLE AS ha, mi
FROM chain c CROSS JOIN range(0, 3) a(ki) CROSS JOIN range(0, 2) b(hi) CROSS JOIN range(0, 2) e(mi)""",
)
define(
    "fold_grid",
    fold_sql("fold_grid", "CASE WHEN mi = 1 THEN ln(greatest(abs(home_score - away_score), 1) + 1) ELSE 1 END", "kf", "ha", "chain_grid", "config, league"),
)
define(
    "grid_loss",
    """
SELECT config, avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))) AS log_loss, count(*) AS games
FROM (SELECT f.config, f.home_elo_prob AS p, CASE WHEN c.home_score > c.away_score THEN 1 WHEN c.home_score < c.away_score THEN 0 END AS y
      FROM fold_grid f JOIN chain c USING (match_id) WHERE c.season BETWEEN 1997 AND 2000) WHERE y IS NOT NULL GROUP BY 1""",
)
define("fold", fold_sql("fold", "1"))
define("fold_log", fold_sql("fold_log", "ln(greatest(abs(home_score - away_score), 1) + 1)"))
define("fold_reset", fold_sql("fold_reset", "1", late=False))
_RATING = "home_elo away_elo home_elo_prob elo_diff"


@query(
    "rt01_expected_score",
    "SELECT match_id, 1 / (1 + power(10::DOUBLE, (away_elo - home_elo - 50) / 400)) AS expected FROM fold WHERE n > 0",
    "expected",
)
def rt01(spark, sf):
    rated = R.rating_features(R.rate(A.matches(spark, sf)))
    return rated.select("match_id", R.expected_score("home_elo", "away_elo", 50.0).alias("expected"))


@query(
    "rt03_season_regression",
    "SELECT match_id, home_elo, away_elo, home_elo_prob, home_elo - away_elo AS elo_diff FROM fold_reset WHERE n > 0",
    _RATING,
)
def rt03(spark, sf):
    """All participants regress at once; here the regression is read before the season's first game."""
    return R.rating_features(R.rate(A.matches(spark, sf), [R.RatingParams(reset_before_read=True)]))


@query("rt04_rating_update", "SELECT match_id, home_after, away_after FROM fold WHERE home_after IS NOT NULL", "home_after away_after")
def rt04(spark, sf):
    return R.rate(A.matches(spark, sf)).filter("home_after is not null").select("match_id", "home_after", "away_after")


@query(
    "rt05_rating_backfill",
    "SELECT match_id, home_elo, away_elo, home_elo_prob, home_elo - away_elo AS elo_diff FROM fold WHERE n > 0",
    _RATING,
)
def rt05(spark, sf):
    return R.rating_features(R.rate(A.matches(spark, sf)))


@query(
    "rt06_rating_history",
    """
SELECT c.league, c.match_id, c.season AS year, true AS is_home, c.home_id AS entity_id, c.away_id AS opponent_id, f.home_elo AS rating_before, f.home_after AS rating_after
FROM fold_log f JOIN chain c USING (match_id) WHERE f.home_after IS NOT NULL UNION ALL
SELECT c.league, c.match_id, c.season, false, c.away_id, c.home_id, f.away_elo, f.away_after FROM fold_log f JOIN chain c USING (match_id) WHERE f.home_after IS NOT NULL""",
    "rating_before rating_after",
)
def rt06(spark, sf):
    return R.rating_history(R.rate(A.matches(spark, sf), [R.RatingParams(margin="log")])).drop("config")


GRID = [R.RatingParams(k=k, home_advantage=h, margin=m) for k in (10.0, 20.0, 40.0) for h in (0.0, 50.0) for m in ("none", "log")]


@query("rt07_parameter_search", "SELECT * FROM grid_loss", "log_loss")
def rt07(spark, sf):
    return R.parameter_losses(A.matches(spark, sf), GRID, 1997, 2000)


@query(
    "rt08_expected_log",
    """
SELECT l.match_id, l.side, l.entity_id, l.result, l.margin, CASE WHEN l.side = 'home' THEN f.home_elo_prob ELSE 1 - f.home_elo_prob END AS expected
FROM log l JOIN fold f USING (match_id)""",
    "expected",
)
def rt08(spark, sf):
    rated = R.rate(A.matches(spark, sf))
    return R.expected_log(log(spark, sf), rated).select("match_id", "side", "entity_id", "result", "margin", "expected")


@query(
    "rt09_best_parameters",
    """
SELECT g.config, g.log_loss, c.kf AS k, c.ha AS home_advantage, CASE WHEN c.mi = 1 THEN 'log' ELSE 'none' END AS margin, 1500.0::DOUBLE AS initial, 0.75::DOUBLE AS keep,
       10.0::DOUBLE AS margin_divisor, false AS reset_before_read
FROM (SELECT * FROM grid_loss ORDER BY log_loss, config LIMIT 1) g JOIN (SELECT DISTINCT config, kf, ha, mi FROM chain_grid) c USING (config)""",
    "log_loss",
)
def rt09(spark, sf):
    return R.best_parameters(R.parameter_losses(A.matches(spark, sf), GRID, 1997, 2000), GRID)


# ---- composites ------------------------------------------------------------------------------

define(
    "prices",
    """
SELECT *, (1 / h2h_home) / (1 / h2h_home + 1 / h2h_away) AS odds_home_prob, (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away) AS odds_away_prob,
       1 / h2h_home + 1 / h2h_away AS odds_overround, (1 / h2h_home_open) / (1 / h2h_home_open + 1 / h2h_away_open) AS odds_home_open_prob,
       (1 / h2h_away_open) / (1 / h2h_home_open + 1 / h2h_away_open) AS odds_away_open_prob,
       (1 / h2h_home_close) / (1 / h2h_home_close + 1 / h2h_away_close) AS odds_home_close_prob, line_home_open AS spread_home_open
FROM odds_filled""",
)
_FE01 = ["odds_home_prob", "odds_away_prob", "odds_overround", "odds_home_open_prob", "odds_away_open_prob", "odds_home_close_prob", "odds_movement", "odds_movement_abs", "spread_home_open", "odds_home_range", "odds_away_range"]


@query(
    "fe01_price_features",
    """
SELECT match_id, odds_home_prob, odds_away_prob, CASE WHEN odds_home_prob > 0.5 THEN 1 ELSE 0 END AS odds_home_favourite, odds_overround, odds_home_open_prob,
       odds_away_open_prob, odds_home_close_prob, odds_home_close_prob - odds_home_open_prob AS odds_movement,
       abs(odds_home_close_prob - odds_home_open_prob) AS odds_movement_abs, spread_home_open, h2h_home_max - h2h_home_min AS odds_home_range, h2h_away_max - h2h_away_min AS odds_away_range
FROM prices""",
    " ".join(_FE01),
)
def fe01(spark, sf):
    return X.price_features(I.backfill_close(A.odds(spark, sf))).select("match_id", "odds_home_favourite", *_FE01)


@query(
    "fe02_context",
    """
SELECT match_id, 1 AS is_home, TRY_CAST(round_label AS INTEGER) AS round_number, CASE WHEN round_label LIKE '%Final%' THEN 1 ELSE 0 END AS is_finals,
       CAST(isodow(event_date) - 1 AS INTEGER) AS day_of_week, CAST(month(event_date) AS INTEGER) AS month, year AS season_year FROM matches""",
)
def fe02(spark, sf):
    return X.context(A.matches(spark, sf)).select("match_id", "is_home", "round_number", "is_finals", "day_of_week", "month", "season_year")


define(
    "composed",
    f"""
SELECT m.match_id, m.round_label, TRY_CAST(m.round_label AS INTEGER) AS round_number, CASE WHEN m.round_label LIKE '%Final%' THEN 1 ELSE 0 END AS is_finals,
       f.* EXCLUDE (match_id), c.* EXCLUDE (match_id), d.home_days_rest, d.away_days_rest, d.home_days_rest - d.away_days_rest AS rest_diff,
       s.home_streak, s.away_streak, l.* EXCLUDE (match_id), v.home_venue_win_rate, v.away_venue_win_rate, p.* EXCLUDE (match_id), g.is_home_ground, r.elo_diff, r.home_elo_prob
FROM matches m JOIN ({wide_sql('form', FT.FORM)}) f USING (match_id) JOIN ({wide_sql('consistency', FT.CONSISTENCY)}) c USING (match_id)
JOIN opener_base d USING (match_id) JOIN ({wide_sql('streaks', ['streak'])}) s USING (match_id) JOIN ladder_lookup l USING (match_id)
JOIN ({wide_sql('venue_record', ['venue_win_rate'])}) v USING (match_id) LEFT JOIN prices p USING (match_id) JOIN ground g USING (match_id)
LEFT JOIN (SELECT match_id, home_elo - away_elo AS elo_diff, home_elo_prob FROM fold WHERE n > 0) r USING (match_id)""",
)


def composed(spark, sf):
    from duelframe.plans.windows_queries import wn07

    rated = R.rating_features(R.rate(A.matches(spark, sf)))
    return FT.base_features(spark, sf).join(wn07(spark, sf), "match_id").join(rated, "match_id", "left")


_FE03 = {
    "elo_diff_sq": "elo_diff ** 2 * sign(elo_diff)",
    "elo_diff_abs": "abs(elo_diff)",
    "odds_elo_diff": "odds_home_prob - home_elo_prob",
    "odds_elo_abs_diff": "abs(odds_home_prob - home_elo_prob)",
    "attack_defense_diff_3": "(home_avg_pf_3 - home_avg_pa_3) - (away_avg_pf_3 - away_avg_pa_3)",
    "season_progress": "CASE WHEN round_number IS NOT NULL THEN least(round_number, 26) END / 26",
    "elo_diff_x_progress": "elo_diff * (CASE WHEN round_number IS NOT NULL THEN least(round_number, 26) END / 26)",
    "comp_points_ratio": "CASE WHEN home_competition_points + away_competition_points > 0 THEN home_competition_points / (home_competition_points + away_competition_points) ELSE 0.5 END",
    "home_strength": "0.4::DOUBLE * home_elo_prob + 0.3::DOUBLE * coalesce(home_win_rate_5, 0.5) + 0.3::DOUBLE * (1 - coalesce(home_position, 9) / 17)",
    "away_strength": "0.4::DOUBLE * (1 - home_elo_prob) + 0.3::DOUBLE * coalesce(away_win_rate_5, 0.5) + 0.3::DOUBLE * (1 - coalesce(away_position, 9) / 17)",
    "elo_x_rest": "elo_diff * rest_diff",
    "venue_wr_diff": "home_venue_win_rate - away_venue_win_rate",
}


@query(
    "fe03_interactions",
    "SELECT match_id, " + ", ".join(f"{e} AS {n}" for n, e in _FE03.items())
    + ", CAST(ladder_pos_diff * is_finals AS INTEGER) AS ladder_x_finals, home_streak - away_streak AS streak_diff FROM composed",
    " ".join(_FE03),
)
def fe03(spark, sf):
    return X.interactions(composed(spark, sf)).select("match_id", *_FE03, "ladder_x_finals", "streak_diff")


_FE04 = {
    "spread_home_close": "line_home_close",
    "spread_movement": "CASE WHEN NOT close_estimated THEN line_home_close - line_home_open END",
    "odds_spread_agree": "CAST((odds_home_prob > 0.5) = (spread_home_open < 0) AS DOUBLE)",
    "odds_spread_disagree_mag": "abs(odds_home_prob - 0.5) + spread_home_open / 20",
    "total_movement": "total_line_close - total_line_open",
    "total_movement_abs": "abs(total_line_close - total_line_open)",
    "implied_draw_prob": "1 / h2h_draw",
    "odds_home_range_close": "CASE WHEN NOT close_estimated THEN h2h_home_max - h2h_home_min END",
    "odds_away_range_close": "CASE WHEN NOT close_estimated THEN h2h_away_max - h2h_away_min END",
    "market_confidence": "1 / odds_overround",
}


@query("fe04_market_features", "SELECT match_id, " + ", ".join(f"{e} AS {n}" for n, e in _FE04.items()) + " FROM prices", " ".join(_FE04))
def fe04(spark, sf):
    priced = X.price_features(I.backfill_close(A.odds(spark, sf)))
    return X.market_features(priced).select("match_id", *_FE04)


@query(
    "fe05_kickoff",
    """
SELECT match_id, hour AS kickoff_hour, CAST(hour >= 18 AS DOUBLE) AS is_night_game, CAST(hour >= 13 AND hour < 18 AS DOUBLE) AS is_afternoon_game, CAST(hour < 13 AS DOUBLE) AS is_day_game
FROM (SELECT match_id, coalesce(CASE WHEN kickoff_time LIKE '%PM' AND h <> 12 THEN h + 12 WHEN kickoff_time LIKE '%AM' AND h = 12 THEN 0 ELSE h END, 0) AS hour
      FROM (SELECT match_id, kickoff_time, CAST(split_part(kickoff_time, ':', 1) AS INTEGER) AS h FROM matches))""",
)
def fe05(spark, sf):
    return X.kickoff(A.matches(spark, sf)).select("match_id", "kickoff_hour", "is_night_game", "is_afternoon_game", "is_day_game")


_FE06 = {
    "is_early_season": "CAST(coalesce(round_number <= 5, false) AS DOUBLE)",
    "is_mid_season": "CAST(coalesce(round_number > 5 AND round_number <= 18, false) AS DOUBLE)",
    "is_late_season": "CAST(coalesce(round_number > 18, false) AS DOUBLE)",
    "elo_diff_x_late": "elo_diff * CAST(coalesce(round_number > 18, false) AS DOUBLE)",
    "form_x_late": "(home_win_rate_5 - away_win_rate_5) * CAST(coalesce(round_number > 18, false) AS DOUBLE)",
    "defense_trend_diff": "CASE WHEN home_pa_trend_5 IS NOT NULL THEN greatest(-home_pa_trend_5, 0) END - CASE WHEN away_pa_trend_5 IS NOT NULL THEN greatest(-away_pa_trend_5, 0) END",
    "scoring_env_ratio": "(home_avg_pf_5 + away_avg_pf_5) / CASE WHEN total_line_open IS NOT NULL THEN greatest(total_line_open, 20) END",
    "fav_consistency": "odds_home_prob * (1 - coalesce(home_pf_std_5, 10) / 20)",
    "elo_spread_agree": "CAST(coalesce((spread_home_open < 0 AND elo_diff > 0) OR (spread_home_open > 0 AND elo_diff < 0), false) AS DOUBLE)",
    "strong_team_rested": "elo_diff * CASE WHEN rest_diff IS NOT NULL THEN greatest(rest_diff, 0) END / 7",
    "home_ground_x_form": "coalesce(is_home_ground, 0) * coalesce(home_win_rate_3 - home_win_rate_8, 0)",
}


@query("fe06_season_interactions", "SELECT match_id, " + ", ".join(f"{e} AS {n}" for n, e in _FE06.items()) + " FROM composed", " ".join(_FE06), places=9)
def fe06(spark, sf):
    return X.season_interactions(X.momentum(composed(spark, sf))).select("match_id", *_FE06)


@query(
    "fe07_lineup_impact",
    """
SELECT match_id, max(CASE WHEN side = 'home' THEN sp END) AS home_spine_impact, max(CASE WHEN side = 'away' THEN sp END) AS away_spine_impact,
       max(CASE WHEN side = 'home' THEN tot END) AS home_total_impact, max(CASE WHEN side = 'away' THEN tot END) AS away_total_impact,
       max(CASE WHEN side = 'home' THEN tot END) - max(CASE WHEN side = 'away' THEN tot END) AS total_impact_diff
FROM (SELECT a.match_id, a.side, coalesce(sum(coalesce(weighted_impact, 0)) FILTER (WHERE is_spine), 0) AS sp, sum(coalesce(weighted_impact, 0)) AS tot
      FROM appearances a LEFT JOIN (SELECT * FROM impact_years WHERE min_starts = 3) i ON i.entity_id = a.entity_id AND i.member_id = a.member_id AND i.target_year = a.year
      WHERE is_starter GROUP BY 1, 2) GROUP BY 1""",
    "home_spine_impact away_spine_impact home_total_impact away_total_impact total_impact_diff",
)
def fe07(spark, sf):
    """Walk-forward impacts only: an all-time impact would leak later games into earlier rows."""
    apps = A.appearances(spark, sf)
    impact = G.with_without_by_season(apps, expected_log(spark, sf), 3, [(3, 3)]).withColumnRenamed("target_year", "year")
    keyed = impact.select(F.struct("entity_id", "year").alias("entity_id"), "member_id", "weighted_impact")
    by_year = apps.withColumn("entity_id", F.struct("entity_id", "year"))
    sums = X.lineup_impact(by_year, keyed)
    return from_sides(sums, ["spine_impact", "total_impact"], differences={"total_impact_diff": "total_impact"})


_RELY = "(" + " + ".join(f"CAST({{s}}_{c} IS NOT NULL AS INTEGER)" for c in X.FORM_COLUMNS) + ") / 5"


@query(
    "fe08_early_season",
    f"""
SELECT match_id, coalesce(CASE WHEN round_number IS NOT NULL THEN least(round_number, 8) END / 8, 0.5) AS season_data_reliability,
       elo_diff * coalesce(CASE WHEN round_number IS NOT NULL THEN least(round_number, 8) END / 8, 0.5) AS elo_confidence,
       {_RELY.format(s='home')} AS home_form_reliability, {_RELY.format(s='away')} AS away_form_reliability FROM composed""",
    "season_data_reliability elo_confidence home_form_reliability away_form_reliability",
)
def fe08(spark, sf):
    return X.early_season(composed(spark, sf)).select("match_id", "season_data_reliability", "elo_confidence", "home_form_reliability", "away_form_reliability")


@query(
    "fe09_game_context",
    """
SELECT match_id, (coalesce(home_position, 8) - 8) * (1 - greatest(0, least(1, 1 - coalesce(round_number, 1) / 27))) AS home_finals_pressure,
       (coalesce(away_position, 8) - 8) * (1 - greatest(0, least(1, 1 - coalesce(round_number, 1) / 27))) AS away_finals_pressure,
       CASE WHEN round_label IN ('Semi Final', 'Prelim Final') THEN 1.0::DOUBLE WHEN is_finals = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS is_elimination,
       CAST(abs(coalesce(home_position, 8) - coalesce(away_position, 8)) AS DOUBLE) AS nothing_to_lose_diff FROM composed""",
    "home_finals_pressure away_finals_pressure",
)
def fe09(spark, sf):
    return X.game_context(composed(spark, sf)).select("match_id", "home_finals_pressure", "away_finals_pressure", "is_elimination", "nothing_to_lose_diff")


@query(
    "fe10_price_movement",
    """
SELECT match_id, s AS prob_shift, abs(s) AS prob_shift_abs, CAST(abs(s) > 0.05 AS DOUBLE) AS sharp_money_flag, CASE WHEN 1 / h2h_home_open > 0.5 THEN s ELSE -s END AS favourite_drift,
       CASE WHEN p IS NOT NULL THEN greatest(0, least(1, p)) END AS closing_range_pct, CASE WHEN q IS NOT NULL THEN least(5, q) END AS line_overreaction
FROM (SELECT *, 1 / h2h_home_close - 1 / h2h_home_open AS s, (h2h_home_close - h2h_home_min) / nullif(h2h_home_max - h2h_home_min, 0) AS p,
             abs(line_home_close - line_home_open) / nullif(abs(line_home_open), 0) AS q FROM odds)""",
    "prob_shift prob_shift_abs favourite_drift closing_range_pct line_overreaction",
)
def fe10(spark, sf):
    return X.price_movement(A.odds(spark, sf)).select(
        "match_id", "prob_shift", "prob_shift_abs", "sharp_money_flag", "favourite_drift", "closing_range_pct", "line_overreaction"
    )


_KM = "coalesce(2 * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})), 0)"
_H = "(sin((radians(lat) - radians(-45 + {s} * 3)) / 2) ** 2 + cos(radians(-45 + {s} * 3)) * cos(radians(lat)) * sin((radians(lon) - radians(100 + {s} * 4)) / 2) ** 2)"


@query(
    "fe11_travel",
    f"""
SELECT match_id, hk AS home_travel_km, ak AS away_travel_km, ak - hk AS travel_diff_km, CAST(ov AS DOUBLE) AS away_is_overseas, CAST(ak >= 300 AND NOT ov AS DOUBLE) AS away_is_interstate, r AS venue_resolved
FROM (SELECT *, CASE WHEN r THEN lon < 100 OR lon > 160 OR away_id >= 16 ELSE ak >= 2100 END AS ov FROM (
  SELECT m.match_id, m.away_id, lat, lon, lat IS NOT NULL AS r, {_KM.format(h=_H.format(s='home_id'))} AS hk, {_KM.format(h=_H.format(s='away_id'))} AS ak
  FROM (SELECT *, CASE venue_id % 4 WHEN 0 THEN 'NATION_' || home_id WHEN 1 THEN 'nation ' || home_id
       WHEN 2 THEN 'Park of NATION-' || home_id || ' (north)' ELSE CASE WHEN venue_id % 8 = 3 THEN 'elsewhere' ELSE 'Nation_' || home_id || ' Oval' END END AS ground FROM matches) m
  LEFT JOIN ground_place USING (ground)))""",
    "home_travel_km away_travel_km travel_diff_km",
)
def fe11(spark, sf):
    m = A.matches(spark, sf).select("match_id", "home_id", "away_id", ground_name().alias("ground"))
    places = m.select("ground").distinct().withColumn("_p", E.fuzzy_lookup("ground", PLACES)).select(
        "ground", F.col("_p.lat").alias("venue_lat"), F.col("_p.lon").alias("venue_lon")
    )
    based = {f"{s}_lat": F.col(f"{s}_id") * 3 - F.lit(45.0) for s in ("home", "away")} | {
        f"{s}_lon": F.col(f"{s}_id") * 4 + F.lit(100.0) for s in ("home", "away")
    }
    df = m.join(places, "ground", "left").withColumns(based).withColumn("away_is_abroad", F.col("away_id") >= 16)
    return X.travel(df).select("match_id", "home_travel_km", "away_travel_km", "travel_diff_km", "away_is_overseas", "away_is_interstate", "venue_resolved")


_WEATHER = f"""
SELECT match_id, temperature_c + 0.0 AS temperature_c, precipitation_mm + 0.0 AS precipitation_mm, wind_speed_kmh + 0.0 AS wind_speed_kmh, rainy AS is_rainy, windy AS is_windy,
       CAST(temperature_c < 12 AS DOUBLE) AS is_cold_actual, CAST(ground_conditions IN ('Fair', 'Heavy') AS DOUBLE) AS ground_not_good, severity AS ground_severity,
       precipitation_mm * wind_speed_kmh + 0.0 AS rain_x_wind,
       CASE WHEN severity IS NOT NULL OR rainy IS NOT NULL OR windy IS NOT NULL THEN coalesce(severity, 0) + coalesce(rainy, 0) + coalesce(windy, 0) END AS bad_conditions_score
FROM (SELECT m.match_id, w.* EXCLUDE (match_id), CAST(precipitation_mm > 1 AS DOUBLE) AS rainy, CAST(wind_speed_kmh > 30 AS DOUBLE) AS windy,
             CASE ground_conditions WHEN 'Good' THEN 0.0::DOUBLE WHEN '' THEN 0.0::DOUBLE WHEN 'Fair' THEN 1.0::DOUBLE WHEN 'Heavy' THEN 4.0::DOUBLE END AS severity
      FROM matches m LEFT JOIN weather w USING (match_id))"""


@query("fe12_weather", _WEATHER)
def fe12(spark, sf):
    joined = A.matches(spark, sf).select("match_id").join(T.weather(spark, sf), "match_id", "left")
    return X.weather_features(joined).drop("ground_conditions")


@query("fe13_weather_alias", _WEATHER)
def fe13(spark, sf):
    joined = A.matches(spark, sf).select("match_id").join(T.weather(spark, sf), "match_id", "left")
    return X.weather_proxy_features(joined).drop("ground_conditions")


@query(
    "fe14_workload",
    """
SELECT m.match_id, h.starter_load_3 AS home_starter_load_3, a.starter_load_3 AS away_starter_load_3, h.spine_load_3 AS home_spine_load_3, a.spine_load_3 AS away_spine_load_3,
       h.heavy_load_3 AS home_heavy_load_3, a.heavy_load_3 AS away_heavy_load_3, h.starter_load_3 - a.starter_load_3 AS workload_diff_3, h.spine_load_3 - a.spine_load_3 AS spine_workload_diff_3
FROM matches m LEFT JOIN workload_roll h ON h.year = m.year AND h.round = m.round AND h.entity_id = m.home_id
               LEFT JOIN workload_roll a ON a.year = m.year AND a.round = m.round AND a.entity_id = m.away_id""",
    "home_starter_load_3 away_starter_load_3 home_spine_load_3 away_spine_load_3 home_heavy_load_3 away_heavy_load_3 workload_diff_3 spine_workload_diff_3",
)
def fe14(spark, sf):
    rolled = W.rolling_workload(W.workload(member_games(spark, sf)))
    m = A.matches(spark, sf).select("match_id", "year", "round", "home_id", "away_id")
    out = L.two_role_lookup(m, rolled, ["starter_load_3", "spine_load_3", "heavy_load_3"], ["year", "round"])
    return out.withColumns(
        {
            "workload_diff_3": F.col("home_starter_load_3") - F.col("away_starter_load_3"),
            "spine_workload_diff_3": F.col("home_spine_load_3") - F.col("away_spine_load_3"),
        }
    ).drop("year", "round", "home_id", "away_id")


@query("fe15_season_period", "SELECT m.match_id, p.is_period, p.period_round_number FROM matches m JOIN period p USING (year, round)")
def fe15(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "year", "round")
    return m.join(W.season_period(m), ["year", "round"]).select("match_id", "is_period", "period_round_number")


define(
    "continuity",
    """
SELECT c.entity_id, c.year + 1 AS year, count(s.member_id) / count(*)::DOUBLE AS roster,
       count(s.member_id) FILTER (WHERE k.member_id IS NOT NULL) / nullif(count(k.member_id), 0)::DOUBLE AS spine
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, year ORDER BY n DESC, member_id) AS rk
      FROM (SELECT entity_id, year, member_id, count(*) AS n FROM appearances WHERE is_starter GROUP BY 1, 2, 3)) WHERE rk <= 17) c
LEFT JOIN (SELECT DISTINCT entity_id, year, member_id FROM appearances WHERE is_starter AND round = 1) s ON s.entity_id = c.entity_id AND s.year = c.year + 1 AND s.member_id = c.member_id
LEFT JOIN (SELECT DISTINCT entity_id, year, member_id FROM appearances WHERE is_spine) k ON k.entity_id = c.entity_id AND k.year = c.year AND k.member_id = c.member_id
WHERE EXISTS (SELECT 1 FROM appearances x WHERE x.is_starter AND x.round = 1 AND x.entity_id = c.entity_id AND x.year = c.year + 1)
GROUP BY 1, 2""",
)


@query(
    "fe16_roster_continuity",
    """
SELECT m.match_id, h.roster AS home_roster_continuity, coalesce(h.spine, h.roster) AS home_spine_continuity, a.roster AS away_roster_continuity, coalesce(a.spine, a.roster) AS away_spine_continuity,
       h.roster - a.roster AS roster_continuity_diff
FROM matches m LEFT JOIN continuity h ON h.entity_id = m.home_id AND h.year = m.year LEFT JOIN continuity a ON a.entity_id = m.away_id AND a.year = m.year""",
    "home_roster_continuity home_spine_continuity away_roster_continuity away_spine_continuity roster_continuity_diff",
)
def fe16(spark, sf):
    table = G.roster_continuity(A.appearances(spark, sf))
    m = A.matches(spark, sf).select("match_id", "year", "home_id", "away_id")
    out = L.two_role_lookup(m, table, ["roster_continuity", "spine_continuity"], ["year"])
    return out.withColumn("roster_continuity_diff", F.col("home_roster_continuity") - F.col("away_roster_continuity")).drop("year", "home_id", "away_id")
