"""Aggregation queries (AG) with their SQL checks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from duelframe.operators import groups as G, link as L, metrics as M, windows as W
from duelframe.plans.common import log, member_games, stats_log
from duelframe.plans.registry import query
from duelframe.plans.table_queries import model_probs
from duelframe.plans.views_sql import define
from duelframe.plans.windows_queries import importances, picks
from duelframe.sources import adapters as A


@query("ag01_mean_and_count", "SELECT year, round, entity_id, avg(minutes) AS mean_minutes, avg(CASE WHEN is_spine THEN minutes END) AS spine_minutes, count(*) AS members FROM member_games GROUP BY 1, 2, 3", "mean_minutes spine_minutes")
def ag01(spark, sf):
    return member_games(spark, sf).groupBy("year", "round", "entity_id").agg(
        F.avg("minutes").alias("mean_minutes"),
        F.avg(F.when(F.col("is_spine"), F.col("minutes"))).alias("spine_minutes"),
        F.count(F.lit(1)).alias("members"),
    )


@query("ag02_conditional_count", "SELECT entity_id, year, count(*) FILTER (WHERE minutes > 75) AS heavy FROM member_games GROUP BY 1, 2")
def ag02(spark, sf):
    return member_games(spark, sf).groupBy("entity_id", "year").agg(F.count_if(F.col("minutes") > 75).alias("heavy"))


@query(
    "ag03_set_aggregate",
    "SELECT match_id, side, CAST(len(list(DISTINCT member_id)) AS INTEGER) AS n, array_to_string(list_sort(list(DISTINCT member_id)), ',') AS members FROM appearances GROUP BY 1, 2",
)
def ag03(spark, sf):
    sets = A.appearances(spark, sf).groupBy("match_id", "side").agg(F.sort_array(F.collect_set("member_id")).alias("s"))
    return sets.select("match_id", "side", F.size("s").alias("n"), F.concat_ws(",", F.col("s").cast("array<string>")).alias("members"))


define("expected_log", "SELECT l.*, CASE WHEN l.side = 'home' THEN (m.cents % 997 + 1) / 998.0::DOUBLE ELSE 1 - (m.cents % 997 + 1) / 998.0::DOUBLE END AS expected FROM log l JOIN matches m USING (match_id)")


def expected_log(spark, sf):
    """The log with an expected result per side (the model probability stands for the rating's)."""
    cents = A.matches(spark, sf).select("match_id", ((F.col("cents") % 997 + 1) / F.lit(998.0)).alias("_p"))
    return log(spark, sf).join(cents, "match_id").withColumn(
        "expected", F.when(F.col("side") == "home", F.col("_p")).otherwise(1 - F.col("_p"))
    ).drop("_p")


define(
    "team_games",
    "SELECT entity_id, year, match_id, result, result - expected AS residual, margin FROM expected_log WHERE result IS NOT NULL",
)


@query(
    "ag04_with_without",
    """
SELECT member_id, entity_id, games_started, games_missed, i AS elo_adj_impact, mw - mo AS margin_impact, c AS confidence, i * c AS weighted_impact, ww AS win_rate_with, wo AS win_rate_without
FROM (SELECT *, rw - ro AS i, least(1, least(games_started, games_missed) / 15.0::DOUBLE) * least(1, (games_started + games_missed) / 40.0::DOUBLE) AS c FROM (
  SELECT p.member_id, p.entity_id, count(*) FILTER (WHERE s.match_id IS NOT NULL) AS games_started, count(*) FILTER (WHERE s.match_id IS NULL) AS games_missed,
         avg(residual) FILTER (WHERE s.match_id IS NOT NULL) AS rw, avg(residual) FILTER (WHERE s.match_id IS NULL) AS ro,
         avg(margin) FILTER (WHERE s.match_id IS NOT NULL) AS mw, avg(margin) FILTER (WHERE s.match_id IS NULL) AS mo,
         avg(result) FILTER (WHERE s.match_id IS NOT NULL) AS ww, avg(result) FILTER (WHERE s.match_id IS NULL) AS wo
  FROM (SELECT DISTINCT entity_id, member_id FROM appearances WHERE is_starter) p
  JOIN team_games g ON g.entity_id = p.entity_id
  LEFT JOIN (SELECT match_id, entity_id, member_id FROM appearances WHERE is_starter) s
    ON s.match_id = g.match_id AND s.entity_id = g.entity_id AND s.member_id = p.member_id
  GROUP BY 1, 2)) WHERE games_started >= 10 AND games_missed >= 3""",
    "elo_adj_impact margin_impact confidence weighted_impact win_rate_with win_rate_without",
)
def ag04(spark, sf):
    return G.with_without(A.appearances(spark, sf), expected_log(spark, sf))


define(
    "impact_years",
    """
SELECT entity_id, member_id, target_year, min_starts, min_absences, games_started, games_missed,
       (rw - ro) * least(1, least(games_started, games_missed) / 15.0::DOUBLE) * least(1, (games_started + games_missed) / 40.0::DOUBLE) AS weighted_impact
FROM (SELECT p.entity_id, p.member_id, y.target_year, count(*) FILTER (WHERE s.match_id IS NOT NULL) AS games_started, count(*) FILTER (WHERE s.match_id IS NULL) AS games_missed,
             avg(residual) FILTER (WHERE s.match_id IS NOT NULL) AS rw, avg(residual) FILTER (WHERE s.match_id IS NULL) AS ro
      FROM (SELECT DISTINCT entity_id, member_id FROM appearances WHERE is_starter) p
      CROSS JOIN (SELECT DISTINCT year AS target_year FROM matches) y
      JOIN team_games g ON g.entity_id = p.entity_id AND g.year BETWEEN y.target_year - 3 AND y.target_year - 1
      LEFT JOIN (SELECT match_id, entity_id, member_id FROM appearances WHERE is_starter) s
        ON s.match_id = g.match_id AND s.entity_id = g.entity_id AND s.member_id = p.member_id
      GROUP BY 1, 2, 3)
CROSS JOIN (VALUES (3, 3), (6, 3)) t(min_starts, min_absences)
WHERE games_started >= min_starts AND games_missed >= min_absences AND games_started > 0 AND games_missed > 0""",
)


@query("ag05_with_without_walk_forward", "SELECT * FROM impact_years", "weighted_impact")
def ag05(spark, sf):
    return G.with_without_by_season(A.appearances(spark, sf), expected_log(spark, sf), 3, [(3, 3), (6, 3)])


@query(
    "ag06_mode",
    "SELECT entity_id, member_id, slot AS usual_slot FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, member_id ORDER BY n DESC, slot) AS k FROM (SELECT entity_id, member_id, slot, count(*) AS n FROM appearances GROUP BY 1, 2, 3)) WHERE k = 1",
)
def ag06(spark, sf):
    return A.appearances(spark, sf).groupBy("entity_id", "member_id").agg(F.mode("slot", True).alias("usual_slot"))


@query("ag07_year_range", "SELECT member_id, entity_id, min(year) AS first_year, max(year) AS last_year, count(*) AS starts FROM appearances WHERE is_starter GROUP BY 1, 2")
def ag07(spark, sf):
    return A.appearances(spark, sf).filter("is_starter").groupBy("member_id", "entity_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("starts")
    )


@query("ag08_category_means", "SELECT year, entity_id, allowed_spine AS spine, allowed_forward AS forward, allowed_back AS back, allowed_total AS total FROM allowed", "spine forward back total")
def ag08(spark, sf):
    from duelframe.operators.tables import points_allowed

    return points_allowed(member_games(spark, sf), A.matches(spark, sf))


@query("ag09_season_mean", "SELECT year, avg(opponent_rating) AS mean_rating FROM rated_log GROUP BY 1", "mean_rating")
def ag09(spark, sf):
    m = A.matches(spark, sf).select("year", F.explode(F.array(F.col("cents") % 201 + 1400, F.expr("cents div 7") % 201 + 1400)).alias("rating"))
    return m.groupBy("year").agg(F.avg("rating").alias("mean_rating"))


@query("ag10_group_share", "SELECT year, round, avg(CASE WHEN month(event_date) IN (6, 7) THEN 1 ELSE 0 END) >= 0.5 AS in_period FROM matches GROUP BY 1, 2")
def ag10(spark, sf):
    return W.season_period(A.matches(spark, sf)).select("year", "round", (F.col("is_period") == 1.0).alias("in_period"))


@query("ag11_distinct_counts", "SELECT year, count(DISTINCT round) AS rounds, count(DISTINCT home_id) AS hosts, count(DISTINCT venue_id) AS venues FROM matches GROUP BY 1")
def ag11(spark, sf):
    return A.matches(spark, sf).groupBy("year").agg(
        F.count_distinct("round").alias("rounds"), F.count_distinct("home_id").alias("hosts"), F.count_distinct("venue_id").alias("venues")
    )


def _tier_sql(name: str, cond: str) -> str:
    return (
        f"count(*) FILTER (WHERE {cond}) AS {name}_games, CAST(coalesce(sum(tip_correct) FILTER (WHERE {cond}), 0) AS BIGINT) AS {name}_correct, "
        f"sum(tip_correct) FILTER (WHERE {cond}) / count(*) FILTER (WHERE {cond}) AS {name}_accuracy, "
        f"CAST(coalesce(sum(tip_correct - odds_correct) FILTER (WHERE {cond}), 0) AS BIGINT) AS {name}_edge"
    )


@query(
    "ag12_season_metrics",
    "SELECT s.*, recent_accuracy, recent_odds_accuracy FROM (SELECT year, count(*) AS games, count(DISTINCT round) AS rounds, "
    + ", ".join(f"CAST(sum({k}_correct) AS BIGINT) AS {k}_correct, sum({k}_correct) / count(*) AS {k}_accuracy" for k in ("tip", "odds", "model"))
    + ", CAST(sum(tip_correct) - sum(odds_correct) AS BIGINT) AS tip_vs_odds, CAST(sum(tip_correct) - sum(model_correct) AS BIGINT) AS tip_vs_model, "
    + ", ".join([_tier_sql("lock", "confidence >= 0.30"), _tier_sql("lean", "confidence >= 0.10 AND confidence < 0.30"), _tier_sql("tossup", "confidence < 0.10")])
    + " FROM picks GROUP BY 1) s JOIN (SELECT year, avg(tip_correct) AS recent_accuracy, avg(odds_correct) AS recent_odds_accuracy FROM "
    "(SELECT *, dense_rank() OVER (PARTITION BY year ORDER BY round DESC) AS k FROM picks) WHERE k <= 3 GROUP BY 1) USING (year)",
    "tip_accuracy odds_accuracy model_accuracy lock_accuracy lean_accuracy tossup_accuracy recent_accuracy recent_odds_accuracy",
)
def ag12(spark, sf):
    p = picks(spark, sf)
    return M.season_metrics(p).join(M.recent_form(p), "year")


define(
    "categorised",
    """
SELECT *, CASE WHEN greatest(odds_prob, 1 - odds_prob) >= 0.65 THEN 'LOCK' WHEN greatest(odds_prob, 1 - odds_prob) >= 0.55 THEN 'LEAN' ELSE 'TOSS-UP' END AS category,
       odds_prob >= 0.5 AS odds_pick, model_prob >= 0.5 AS model_pick FROM picks""",
)


def categorised(spark, sf):
    from duelframe.operators.decisions import category

    return picks(spark, sf).withColumns(
        {
            "category": category(F.greatest(F.col("odds_prob"), 1 - F.col("odds_prob"))),
            "odds_pick": F.col("odds_prob") >= 0.5,
            "model_pick": F.col("model_prob") >= 0.5,
        }
    )


@query(
    "ag13_dashboard",
    """
SELECT year, category, CAST(grouping_id(year, category) AS BIGINT) AS level, count(*) AS games, CAST(sum(tip_correct) AS BIGINT) AS tip_correct, CAST(sum(odds_correct) AS BIGINT) AS odds_correct,
       CAST(sum(model_correct) AS BIGINT) AS model_correct, count(*) FILTER (WHERE odds_pick <> model_pick) AS disagreements,
       CAST(coalesce(sum(model_correct) FILTER (WHERE odds_pick <> model_pick), 0) AS BIGINT) AS model_won,
       CAST(round_even(sum(tip_correct) * 213.0 / count(*), 0) AS DOUBLE) AS projected
FROM categorised GROUP BY ROLLUP (year, category)""",
    "projected",
)
def ag13(spark, sf):
    board = M.dashboard(categorised(spark, sf))
    return board.withColumn("projected", M.projection(F.col("tip_correct"), F.col("games"), F.lit(213)))


define(
    "aucs",
    """
SELECT model, (sum(CASE WHEN label = 1 THEN rk END) - pos * (pos + 1) / 2.0) / (pos * neg)::DOUBLE AS auc FROM (
  SELECT model, label, avg(rn) OVER (PARTITION BY model, prob) AS rk, sum(label) OVER (PARTITION BY model) AS pos, sum(1 - label) OVER (PARTITION BY model) AS neg
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prob) AS rn FROM model_probs)) GROUP BY model, pos, neg""",
)


@query(
    "ag14_probability_metrics",
    "SELECT m.*, auc FROM (SELECT model, count(*) AS games, avg(CAST((prob >= 0.5) = (label = 1) AS INTEGER)) AS accuracy, "
    "avg(-(label * ln(greatest(1e-7, least(1 - 1e-7, prob))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, prob))))) AS log_loss, avg((prob - label) ** 2) AS brier "
    "FROM model_probs GROUP BY 1) m JOIN aucs USING (model)",
    "accuracy log_loss brier auc",
)
def ag14(spark, sf):
    p = model_probs(spark, sf)
    return M.probability_metrics(p, ["model"]).join(M.auc(p, ["model"]), "model")


@query("ag15_fold_means", "SELECT model, avg(accuracy) AS accuracy, avg(log_loss) AS log_loss, avg(brier) AS brier, count(*) AS folds FROM fold_metrics GROUP BY 1", "accuracy log_loss brier")
def ag15(spark, sf):
    folds = M.probability_metrics(model_probs(spark, sf), ["model", "year"])
    return M.fold_means(folds, ["model"], ["accuracy", "log_loss", "brier"])


@query(
    "ag16_ratio_argmax",
    """
SELECT year, arg_max(step, acc) AS best_step, max(acc) AS best_accuracy FROM (
 SELECT year, w AS step, sum(CAST((w * 0.1::DOUBLE * model_prob + (1 - w * 0.1::DOUBLE) * odds_prob >= 0.5) = (home_win = 1) AS INTEGER)) / count(*) - w * 1e-12 AS acc
 FROM picks CROSS JOIN range(0, 11) g(w) GROUP BY 1, 2) GROUP BY 1""",
    "best_accuracy",
)
def ag16(spark, sf):
    from duelframe.operators.decisions import best_step

    return best_step(picks(spark, sf), 10, ["year"])


@query(
    "ag17_importance_summary",
    """
SELECT feature, avg(importance) AS mean_importance, avg(rank) AS mean_rank, min(rank) AS best_rank, max(rank) AS worst_rank,
       count(*) FILTER (WHERE rank <= 2) AS times_in_top, count(DISTINCT year) AS seasons
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM importances) GROUP BY 1""",
    "mean_importance mean_rank",
)
def ag17(spark, sf):
    return M.importance_summary(W.rank_features(importances(spark, sf)), 2)


_PROFILE = ["home_score", "attendance", "penalty_home", "kickoff_time", "referee"]


@query(
    "ag18_missing_profile",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM matches" for c in _PROFILE) + ") WHERE missing_rate > 0.05",
    "missing_rate",
)
def ag18(spark, sf):
    return M.missing_profile(A.matches(spark, sf), _PROFILE, 0.05)


@query(
    "ag19_season_counts",
    """
SELECT year, count(*) AS games, count(DISTINCT home_id) AS teams, count(*) FILTER (WHERE home_score > away_score) AS home_wins,
       count(*) FILTER (WHERE home_score < away_score) AS away_wins, count(*) FILTER (WHERE home_score = away_score) AS draws FROM matches GROUP BY 1""",
)
def ag19(spark, sf):
    h, a = F.col("home_score"), F.col("away_score")
    return A.matches(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("games"), F.count_distinct("home_id").alias("teams"), F.count_if(h > a).alias("home_wins"),
        F.count_if(h < a).alias("away_wins"), F.count_if(h == a).alias("draws"),
    )


@query(
    "ag20_fixtures_per_day",
    "SELECT CAST(ts AS DATE) AS day, min(ts) AS first_start, max(ts) AS last_start, count(*) AS games FROM events GROUP BY 1",
)
def ag20(spark, sf):
    return A.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("first_start"), F.max("ts").alias("last_start"), F.count(F.lit(1)).alias("games")
    )


define(
    "round_scores",
    """
SELECT year, round, player, CAST(points AS BIGINT) AS points FROM (SELECT year, round, sum(odds_correct) AS odds, sum(model_correct) AS model, sum(tip_correct) AS tip FROM picks GROUP BY 1, 2)
UNPIVOT (points FOR player IN (odds, model, tip))""",
)


def round_scores(spark, sf):
    wide = picks(spark, sf).groupBy("year", "round").agg(*[F.sum(f"{k}_correct").alias(k) for k in ("odds", "model", "tip")])
    return wide.unpivot(["year", "round"], ["odds", "model", "tip"], "player", "points")


@query(
    "ag21_leaderboard",
    """
SELECT player, CAST(sum(points) AS BIGINT) AS total, avg(points) AS mean_points, stddev_pop(points) AS spread, count(*) FILTER (WHERE points <= 35) AS bad_rounds,
       count(*) FILTER (WHERE points >= 50) AS great_rounds, count(*) FILTER (WHERE points = best) AS rounds_led, CAST(sum(best) AS BIGINT) AS ceiling
FROM (SELECT *, max(points) OVER (PARTITION BY year, round) AS best FROM round_scores) GROUP BY 1""",
    "mean_points spread",
)
def ag21(spark, sf):
    return M.leaderboard(round_scores(spark, sf), 35, 50)


@query(
    "ag21_round_duels",
    """
SELECT a.player, b.player AS opponent, count(*) FILTER (WHERE a.points > b.points) AS won, count(*) FILTER (WHERE a.points < b.points) AS lost, count(*) FILTER (WHERE a.points = b.points) AS tied
FROM round_scores a JOIN round_scores b USING (year, round) WHERE a.player < b.player GROUP BY 1, 2""",
)
def ag21b(spark, sf):
    return M.round_duels(round_scores(spark, sf), [("model", "odds"), ("model", "tip"), ("odds", "tip")])


@query(
    "ag22_price_consensus",
    "SELECT match_id, avg(home_ticks) / 20 AS mean_home, median(home_ticks) / 20 AS median_home, median(away_ticks) / 20 AS median_away, count(*) AS quotes FROM quotes GROUP BY 1",
    "mean_home median_home median_away",
)
def ag22(spark, sf):
    return A.quotes(spark, sf).groupBy("match_id").agg(
        (F.avg("home_ticks") / 20).alias("mean_home"), (F.median("home_ticks") / 20).alias("median_home"),
        (F.median("away_ticks") / 20).alias("median_away"), F.count(F.lit(1)).alias("quotes"),
    )


@query(
    "ag23_two_level_mean",
    "SELECT entity_id, year, avg(m) AS mean_of_means, avg(r) AS mean_ratio FROM (SELECT match_id, side, entity_id, year, avg(minutes) AS m, sum(minutes) / sum(touches) AS r FROM member_games GROUP BY 1, 2, 3, 4) GROUP BY 1, 2",
    "mean_of_means mean_ratio",
)
def ag23(spark, sf):
    per_match = member_games(spark, sf).groupBy("match_id", "side", "entity_id", "year").agg(
        F.avg("minutes").alias("m"), F.try_divide(F.sum("minutes"), F.sum("touches")).alias("r")
    )
    return per_match.groupBy("entity_id", "year").agg(F.avg("m").alias("mean_of_means"), F.avg("r").alias("mean_ratio"))


@query(
    "ag24_next_unscored_round",
    """
SELECT league, min(week) AS next_week FROM (SELECT venue_id AS league, CAST(year * 100 + round AS INTEGER) AS week, max(event_date) AS d, count(home_score) AS n FROM matches GROUP BY 1, 2)
WHERE d < DATE '2000-06-01' AND n = 0 GROUP BY 1""",
)
def ag24(spark, sf):
    m = A.matches(spark, sf).select(
        F.col("venue_id").alias("year"), (F.col("year") * 100 + F.col("round")).cast("int").alias("round"), "event_date", "home_score"
    )
    due = M.next_unscored_round(m, F.lit(datetime.date(2000, 6, 1)))
    return due.select(F.col("year").alias("league"), F.col("next_round").alias("next_week"))


@query(
    "ag25_latest_judged_round",
    "SELECT year, max(round) AS latest FROM matches m WHERE home_score IS NOT NULL AND EXISTS (SELECT 1 FROM quotes q WHERE q.match_id = m.match_id) GROUP BY 1",
)
def ag25(spark, sf):
    scored = A.matches(spark, sf).filter("home_score is not null")
    return scored.join(A.quotes(spark, sf), "match_id", "left_semi").groupBy("year").agg(F.max("round").alias("latest"))


@query(
    "ag26_coverage",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) / count(*) AS coverage FROM matches" for c in _PROFILE),
    "coverage",
)
def ag26(spark, sf):
    return M.coverage(A.matches(spark, sf), _PROFILE)


@query(
    "ag27_per_year_strategies",
    """
SELECT year, strategy, CAST(sum(c) AS BIGINT) AS correct, count(*) AS games FROM (SELECT year, odds_correct AS odds, model_correct AS model, tip_correct AS blend FROM picks)
UNPIVOT (c FOR strategy IN (odds, model, blend)) GROUP BY 1, 2""",
)
def ag27(spark, sf):
    p = picks(spark, sf).select("year", F.col("odds_correct").alias("odds"), F.col("model_correct").alias("model"), F.col("tip_correct").alias("blend"))
    return p.unpivot("year", ["odds", "model", "blend"], "strategy", "c").groupBy("year", "strategy").agg(
        F.sum("c").alias("correct"), F.count(F.lit(1)).alias("games")
    )


@query("ag28_repeated_keys", "SELECT match_id, line_no, count(*) AS rows FROM quotes GROUP BY 1, 2 HAVING count(*) > 1")
def ag28(spark, sf):
    return L.repeated_keys(A.quotes(spark, sf), ["match_id", "line_no"])
