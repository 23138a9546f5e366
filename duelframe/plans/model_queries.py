"""MLlib queries (ML) and the modelling half of EV. Rows-only: no SQL form exists for a tree fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelframe.operators import features as X, imputation as I, strategies as S
from duelframe.plans import backtest as B, feature_queries, feature_table as FT  # noqa: F401
from duelframe.plans.common import log_of
from duelframe.plans.registry import query
from duelframe.session import in_steps
from duelframe.sources import adapters as A

FEATURES = [
    "home_win_rate_5", "away_win_rate_5", "home_avg_margin_5", "away_avg_margin_5", "home_pf_std_5", "away_pf_std_5",
    "home_days_rest", "away_days_rest", "home_streak", "away_streak", "odds_home_prob", "odds_movement", "spread_home_open",
    "bookmakers_surveyed",
]
BOOSTED = B.boosted()


_GAME = [
    "match_id", "event_date", "year", "round", "round_label", "venue_id", "league", "home_id", "away_id", "home_score", "away_score",
    "halftime_home", "halftime_away", "penalty_home", "penalty_away",
]


def dataset(spark, sf, **options) -> B.Dataset:
    """The feature table, made in steps: each holds its own shuffle files only."""
    with in_steps(spark) as step:
        matches = step(A.matches(spark, sf).select(_GAME))
        prices = X.price_features(I.backfill_close(A.odds(spark, sf)))
        prices = step(prices.select("match_id", *[c for c in FEATURES if c in prices.columns]))
        form = FT.features_of(log_of(matches))
        form = step(form.select("match_id", *[c for c in FEATURES if c in form.columns]))
        table = (
            X.context(matches)
            .join(form, "match_id")
            .join(prices, "match_id", "left")
            .withColumn("home_win", X.target())
        )
        return B.Dataset.build(table, FEATURES, "odds_home_prob", **options)


@query("ml01_walk_forward")
def ml01(spark, sf):
    return B.walk_forward(dataset(spark, sf), {"logistic": B.ScaledLogistic()}).select(
        "model", "fold", "match_id", "label", "prob"
    )


@query("ml02_boosted_trees")
def ml02(spark, sf):
    members = {n: m for n, m in B.MODELS.items() if n.startswith("boosted")}
    return B.fold_scores(B.walk_forward(dataset(spark, sf), members))


@query("ml03_scaled_logistic")
def ml03(spark, sf):
    return B.fold_scores(B.walk_forward(dataset(spark, sf), {"logistic": B.ScaledLogistic(1.0)}))


@query("ml04_random_forest")
def ml04(spark, sf):
    return B.fold_scores(B.walk_forward(dataset(spark, sf), {"forest": B.forest()}))


@query("ml06_feature_selection")
def ml06(spark, sf):
    """Features by importance, from all seasons before the last."""
    data = dataset(spark, sf)
    last = data.seasons[-1]
    fitted = B._fit(data.df.filter(F.col("season") < last), data.features, BOOSTED, B.filler(data.medians_before([last])[last]))
    return B.importances(fitted, data.features, spark)


@query("ml07_isotonic_calibration")
def ml07(spark, sf):
    oof = B.walk_forward(dataset(spark, sf), {"logistic": B.ScaledLogistic()})
    return B.calibrated(oof).select("model", "fold", "match_id", "label", "prob")


@query("ml12_stacked_logistic")
def ml12(spark, sf):
    oof = B.walk_forward(dataset(spark, sf), {"logistic": B.ScaledLogistic(), "boosted": BOOSTED})
    return B.stacked(oof, ["logistic", "boosted"]).select("model", "fold", "match_id", "label", "prob")


@query("ml13_stacked_network")
def ml13(spark, sf):
    oof = B.walk_forward(dataset(spark, sf), {"logistic": B.ScaledLogistic()})
    return B.stacked(oof, ["logistic"], network=True).select("model", "fold", "match_id", "label", "prob")


@query("ml14_cross_fitted")
def ml14(spark, sf):
    inner = B.cross_fitted(dataset(spark, sf), BOOSTED)
    return B.meta_features(inner).select("match_id", "label", *B.META)


def before_last(data: B.Dataset) -> tuple[B.Dataset, DataFrame]:
    """Decided games of all seasons before the last, and the games of the last."""
    past = F.col("season") < data.seasons[-1]
    sizes = {s: data.sizes[s] for s in data.seasons[:-1]}
    return B.Dataset(data.df.filter(past & F.col("label").isNotNull()), data.features, data.seasons[:-1], sizes), data.df.filter(~past)


@query("ml15_train_and_predict")
def ml15(spark, sf):
    data = dataset(spark, sf, drop_undecided=False)
    known, upcoming = before_last(data)
    return B.score(B.train_final(known), upcoming)


@query("ml16_rescore_stored")
def ml16(spark, sf):
    """Train once, store, load, and score again with fresh prices."""
    import uuid

    from duelframe.session import shared_folder

    data = dataset(spark, sf, drop_undecided=False)
    known, last = before_last(data)
    path = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    digest = B.fingerprint(known.df, ["match_id", "label"])
    B.save_artifacts(B.train_final(known), path, digest)
    stored = B.load_artifacts(spark, path, digest)
    fresh = A.predictions(spark, sf).filter("close_prob is not null").select("match_id", F.col("close_prob").alias("_fresh"))
    upcoming = last.join(fresh, "match_id", "left")
    upcoming = upcoming.withColumn("market", F.coalesce("_fresh", "market")).drop("_fresh")
    return B.score(stored, upcoming)


_TABLE = ["home_elo", "away_elo", "elo_diff", "home_strength", "strength_diff", "season_data_reliability", "home_finals_pressure", "is_night_game", "prob_shift"]


_STRENGTH = "0.4::DOUBLE * {p} + 0.3::DOUBLE * coalesce({s}_win_rate_5, 0.5) + 0.3::DOUBLE * (1 - coalesce({s}_position, 9) / 17)"
_HOME, _AWAY = _STRENGTH.format(p="f.home_elo_prob", s="home"), _STRENGTH.format(p="(1 - f.home_elo_prob)", s="away")


@query(
    "ml17_feature_table",
    f"""
SELECT c.match_id, m.year, f.home_elo, f.away_elo, f.home_elo - f.away_elo AS elo_diff, {_HOME} AS home_strength, ({_HOME}) - ({_AWAY}) AS strength_diff,
       coalesce(CASE WHEN c.round_number IS NOT NULL THEN least(c.round_number, 8) END / 8, 0.5) AS season_data_reliability,
       (coalesce(home_position, 8) - 8) * (1 - greatest(0, least(1, 1 - coalesce(c.round_number, 1) / 27))) AS home_finals_pressure,
       CAST(m.kickoff_time LIKE '%PM' AND CAST(split_part(m.kickoff_time, ':', 1) AS INTEGER) BETWEEN 6 AND 11 AND m.kickoff_time IS NOT NULL AS DOUBLE) AS is_night_game,
       1 / h2h_home_close - 1 / h2h_home_open AS prob_shift, CASE WHEN m.home_score > m.away_score THEN 1 WHEN m.home_score < m.away_score THEN 0 END AS home_win
FROM composed c JOIN fold f USING (match_id) JOIN matches m USING (match_id)""",
    "home_elo away_elo elo_diff home_strength strength_diff season_data_reliability home_finals_pressure prob_shift",
)
def ml17(spark, sf):
    return FT.feature_table(spark, sf).select("match_id", "year", *_TABLE, "home_win")


@query("ml18_parameter_search")
def ml18(spark, sf):
    grid = {f"boosted_{d}_{r}": B.boosted(d, r) for d in (2, 4) for r in (10, 20)}
    return B.tuned(dataset(spark, sf), grid)


@query("ml19_feature_count_sweep")
def ml19(spark, sf):
    return B.feature_count_sweep(dataset(spark, sf), BOOSTED, (4, 8))


@query("ml20_ablation")
def ml20(spark, sf):
    groups = {"prices": FEATURES[10:], "rest": ["home_days_rest", "away_days_rest"]}
    return B.ablation(dataset(spark, sf), B.ScaledLogistic(), groups)


@query("ml21_side_test")
def ml21(spark, sf):
    data = dataset(spark, sf)
    return B.side_test(data.only(FEATURES[:10]), data, B.ScaledLogistic(), (0.0, 0.25, 0.5))


@query(
    "ml22_experiment_dataset",
    """
SELECT match_id, year, home_win, home_win_rate_5, home_avg_margin_5, away_win_rate_5, away_avg_margin_5 FROM (
 SELECT match_id, max(CASE WHEN side = 'home' THEN wr END) AS home_win_rate_5, max(CASE WHEN side = 'home' THEN am END) AS home_avg_margin_5,
        max(CASE WHEN side = 'away' THEN wr END) AS away_win_rate_5, max(CASE WHEN side = 'away' THEN am END) AS away_avg_margin_5
 FROM (SELECT match_id, side, avg(result) OVER w AS wr, avg(margin) OVER w AS am FROM log WHERE margin <> 0
       WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) GROUP BY 1)
JOIN (SELECT match_id, year, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win FROM matches) USING (match_id)""",
    "home_win_rate_5 home_avg_margin_5 away_win_rate_5 away_avg_margin_5",
)
def ml22(spark, sf):
    """Experiment variant: draws and unplayed games leave before the windows run."""
    from duelframe.operators.sides import from_sides, team_log
    from duelframe.operators import windows as W
    from duelframe.plans.common import per_entity

    kept = X.decided(A.matches(spark, sf))
    df = team_log(kept, ("match_id", "event_date", "year"))
    form = from_sides(W.rolling_form(df, per_entity(df)), ["win_rate_5", "avg_margin_5"])
    return kept.select("match_id", "year", X.target().alias("home_win")).join(form, "match_id")


@query("ev02_walk_forward_games")
def ev02(spark, sf):
    oof = B.walk_forward(dataset(spark, sf), {"logistic": B.ScaledLogistic()}).filter("model <> 'market'")
    p = A.predictions(spark, sf).select("match_id", "year", "open_prob", "close_prob", "odds_prob", "home_win")
    games = oof.select("match_id", F.col("prob").alias("model_prob")).join(p, "match_id").filter("odds_prob is not null")
    return S.strategy_record(games, S.strategy_probabilities(), ["year"])
