"""Feature composites: column expressions over the tables the other operators build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.functions.numbers import clipped, fair_pair, flag, haversine_km, known_share, reciprocal
from duelframe.functions.text import ELIMINATION_WORDS, FINALS_WORDS, has_any, looked_up, twelve_hour
from duelframe.schema import numeric

# fixed values: ordinal severity of a ground report; blank means good
GROUND_SEVERITY = {"Good": 0, "": 0, "Fine": 0, "Fair": 1, "Slippery": 2, "Wet": 3, "Heavy": 4, "Muddy": 4}
GROUND_NOT_GOOD = ("Fair", "Slippery", "Wet", "Heavy", "Muddy")


def momentum(df: DataFrame) -> DataFrame:
    """Short-against-long form of both sides."""
    out = {}
    for side in ("home", "away"):
        rate = {n: F.col(f"{side}_win_rate_{n}") for n in (3, 5, 8)}
        out[f"{side}_form_momentum"] = rate[3] - rate[8]
        out[f"{side}_form_momentum_3v5"] = rate[3] - rate[5]
    df = df.withColumns(out)
    return df.withColumn("form_momentum_diff", F.col("home_form_momentum") - F.col("away_form_momentum"))


def target(home: str = "home_score", away: str = "away_score") -> Column:
    """1 home win, 0 away win, NULL for a draw or an unplayed game."""
    return F.when(F.col(home) > F.col(away), 1).when(F.col(home) < F.col(away), 0)


def decided(matches: DataFrame) -> DataFrame:
    """Played games that did not end in a draw."""
    return matches.filter(target().isNotNull())


def feature_matrix(df: DataFrame, meta: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Meta columns, the wanted features that exist (once each, as numbers) and the target."""
    present = [c for c in dict.fromkeys(wanted) if c in df.columns]
    return df.select(*meta, *[numeric(c).alias(c) for c in present], target().alias("home_win"))


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str) -> DataFrame:
    """Pivot with declared names (no extra pass to find them); repeated values resolve to the smallest."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.min(value))


def completed_fixtures(fixtures: DataFrame, states: Sequence[str], state: str = "state", link: str = "link") -> DataFrame:
    """Fixtures in a final state that have a link to their details."""
    return fixtures.filter(F.col(state).isin(*states) & F.col(link).isNotNull())


def period_slice(matches: DataFrame, year: int, rnd: int) -> DataFrame:
    """Scored games of one (year, round); prunes partitions of a table laid out by them."""
    return matches.filter((F.col("year") == year) & (F.col("round") == rnd) & F.col("home_score").isNotNull())


def first_source(results: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Rows of the results table, completed by feed rows for keys the results lack."""
    missing = feed.join(results.select(key), key, "left_anti")
    return results.withColumn("source", F.lit("results")).unionByName(missing.withColumn("source", F.lit("feed")))


def first_in_horizon(events: DataFrame, date: str, days: int, n: int, tie: str = "match_id") -> DataFrame:
    """The first ``n`` events within ``days`` of the earliest one (a scalar subquery, then top-k)."""
    start = events.agg(F.min(date).alias("d")).select("d").scalar()
    return events.filter(F.col(date) <= F.date_add(start, days)).orderBy(date, tie).limit(n)


# fixed values: forms whose presence measures how much history a side has
FORM_COLUMNS = ("win_rate_3", "win_rate_5", "win_rate_8", "avg_pf_3", "avg_pf_5")


def price_features(df: DataFrame) -> DataFrame:
    """Normalised probabilities from current, opening and closing prices, movement and ranges."""
    home, away, over = fair_pair("h2h_home", "h2h_away")
    home_open, away_open, _ = fair_pair("h2h_home_open", "h2h_away_open")
    home_close, _, _ = fair_pair("h2h_home_close", "h2h_away_close")
    move = home_close - home_open
    return df.withColumns(
        {
            "odds_home_prob": home,
            "odds_away_prob": away,
            "odds_home_favourite": F.coalesce(home > 0.5, F.lit(False)).cast("int"),
            "odds_overround": over,
            "odds_home_open_prob": home_open,
            "odds_away_open_prob": away_open,
            "odds_home_close_prob": home_close,
            "odds_movement": move,
            "odds_movement_abs": F.abs(move),
            "spread_home_open": F.col("line_home_open"),
            "odds_home_range": F.col("h2h_home_max") - F.col("h2h_home_min"),
            "odds_away_range": F.col("h2h_away_max") - F.col("h2h_away_min"),
        }
    )


def market_features(df: DataFrame) -> DataFrame:
    """Spread and total movement, agreement of spread and price, draw price, ranges, confidence.

    Needs ``price_features`` and ``backfill_close``; movements and closing ranges of rows whose
    closing price is an estimate are unknown.
    """
    real = ~F.coalesce("close_estimated", F.lit(False))
    spread = F.col("line_home_close") - F.col("line_home_open")
    total = F.col("total_line_close") - F.col("total_line_open")
    favours_home = F.coalesce(F.col("odds_home_prob") > 0.5, F.lit(False))
    gives_points = F.coalesce(F.col("spread_home_open") < 0, F.lit(False))
    return df.withColumns(
        {
            "spread_home_close": F.col("line_home_close"),
            "spread_movement": F.when(real, spread),
            "spread_movement_abs": F.when(real, F.abs(spread)),
            "odds_spread_agree": (favours_home == gives_points).cast("double"),
            "odds_spread_disagree_mag": F.abs(F.col("odds_home_prob") - 0.5)
            + F.coalesce("spread_home_open", F.lit(0.0)) / 20.0,
            "total_movement": total,
            "total_movement_abs": F.abs(total),
            "implied_draw_prob": reciprocal("h2h_draw"),
            "draw_competitiveness": reciprocal("h2h_draw"),
            "odds_home_range_close": F.when(real, F.col("h2h_home_max") - F.col("h2h_home_min")),
            "odds_away_range_close": F.when(real, F.col("h2h_away_max") - F.col("h2h_away_min")),
            "market_confidence": reciprocal("odds_overround"),
        }
    )


def price_movement(df: DataFrame) -> DataFrame:
    """Movement in (raw) probability space, favourite drift, closing position, relative line move."""
    opened, closed = reciprocal("h2h_home_open"), reciprocal("h2h_home_close")
    shift = closed - opened
    span = F.nullif(F.col("h2h_home_max") - F.col("h2h_home_min"), F.lit(0.0))
    line = F.nullif(F.abs("line_home_open"), F.lit(0.0))
    return df.withColumns(
        {
            "prob_shift": shift,
            "prob_shift_abs": F.abs(shift),
            "sharp_money_flag": flag(F.abs(shift) > 0.05),
            "favourite_drift": F.when(opened > 0.5, shift).otherwise(-shift),
            "closing_range_pct": clipped((F.col("h2h_home_close") - F.col("h2h_home_min")) / span, 0.0, 1.0),
            "line_overreaction": clipped(F.abs(F.col("line_home_close") - F.col("line_home_open")) / line, high=5.0),
        }
    )


def context(df: DataFrame) -> DataFrame:
    """Round number, finals flag, weekday (Monday 0), month and season."""
    return df.withColumns(
        {
            "is_home": F.lit(1),
            "round_number": F.col("round_label").try_cast("int"),
            "is_finals": has_any("round_label", FINALS_WORDS).cast("int"),
            "day_of_week": F.weekday("event_date"),
            "month": F.month("event_date"),
            "season_year": F.col("year"),
        }
    )


def kickoff(df: DataFrame) -> DataFrame:
    """Hour of the kickoff text, else of the date, and night/afternoon/day flags (0 if unknown)."""
    hour = F.coalesce(twelve_hour("kickoff_time"), F.hour(F.col("event_date").cast("timestamp")))
    df = df.withColumn("kickoff_hour", hour)
    h = F.col("kickoff_hour")
    no = F.lit(False)
    return df.withColumns(
        {
            "is_night_game": F.coalesce(h >= 18, no).cast("double"),
            "is_afternoon_game": F.coalesce((h >= 13) & (h < 18), no).cast("double"),
            "is_day_game": F.coalesce(h < 13, no).cast("double"),
        }
    )


def interactions(df: DataFrame, ladder_size: float = 17.0, usual_position: float = 9.0) -> DataFrame:
    """Products, differences and the composite strength of rating, form and standing."""
    elo, prob = F.col("elo_diff"), F.col("home_elo_prob")
    progress = clipped("round_number", high=26) / 26.0

    def attack(side: str) -> Column:
        return F.col(f"{side}_avg_pf_3") - F.col(f"{side}_avg_pa_3")

    def strength(side: str, p: Column) -> Column:
        form = F.coalesce(f"{side}_win_rate_5", F.lit(0.5))
        place = F.coalesce(F.col(f"{side}_position").cast("double"), F.lit(usual_position))
        return 0.4 * p + 0.3 * form + 0.3 * (1 - place / ladder_size)

    points = F.col("home_competition_points") + F.col("away_competition_points")
    return df.withColumns(
        {
            "elo_diff_sq": F.pow(elo, F.lit(2.0)) * F.signum(elo),
            "elo_diff_abs": F.abs(elo),
            "odds_elo_diff": F.col("odds_home_prob") - prob,
            "odds_elo_abs_diff": F.abs(F.col("odds_home_prob") - prob),
            "attack_defense_diff_3": attack("home") - attack("away"),
            "season_progress": progress,
            "elo_diff_x_progress": elo * progress,
            "comp_points_ratio": F.when(points > 0, F.col("home_competition_points") / points).otherwise(0.5),
            "home_strength": strength("home", prob),
            "away_strength": strength("away", 1 - prob),
            "strength_diff": strength("home", prob) - strength("away", 1 - prob),
            "elo_x_rest": elo * F.col("rest_diff"),
            "ladder_x_finals": F.col("ladder_pos_diff") * F.coalesce("is_finals", F.lit(0)),
            "streak_diff": F.col("home_streak") - F.col("away_streak"),
            "venue_wr_diff": F.col("home_venue_win_rate") - F.col("away_venue_win_rate"),
        }
    )


def season_interactions(df: DataFrame) -> DataFrame:
    """Season stage, its products with rating and form, defence trend, agreement and rest strength."""
    rnd, elo = F.col("round_number"), F.col("elo_diff")
    no = F.lit(False)
    early = F.coalesce(rnd <= 5, no).cast("double")
    mid = F.coalesce((rnd > 5) & (rnd <= 18), no).cast("double")
    late = F.coalesce(rnd > 18, no).cast("double")
    better = {s: clipped(-F.col(f"{s}_pa_trend_5"), low=0.0) for s in ("home", "away")}
    spread = F.col("spread_home_open")
    agree = ((spread < 0) & (elo > 0)) | ((spread > 0) & (elo < 0))
    return df.withColumns(
        {
            "is_early_season": early,
            "is_mid_season": mid,
            "is_late_season": late,
            "elo_diff_x_late": elo * late,
            "elo_diff_x_early": elo * early,
            "form_x_late": F.col("win_rate_diff_5") * late,
            "home_defense_improving": better["home"],
            "away_defense_improving": better["away"],
            "defense_trend_diff": better["home"] - better["away"],
            "scoring_env_ratio": (F.col("home_avg_pf_5") + F.col("away_avg_pf_5")) / clipped("total_line_open", low=20.0),
            "fav_consistency": F.col("odds_home_prob") * (1 - F.coalesce("home_pf_std_5", F.lit(10.0)) / 20.0),
            "elo_spread_agree": F.coalesce(agree, no).cast("double"),
            "strong_team_rested": elo * clipped("rest_diff", low=0) / 7.0,
            "home_ground_x_form": F.coalesce("is_home_ground", F.lit(0.0)) * F.coalesce("home_form_momentum", F.lit(0.0)),
        }
    )


def lineup_impact(appearances: DataFrame, impact: DataFrame) -> DataFrame:
    """Sum of the starters' and of the key members' impact per match and side; unknown members add 0."""
    known = impact.select("entity_id", "member_id", "weighted_impact")
    value = F.coalesce("weighted_impact", F.lit(0.0))
    return (
        appearances.filter("is_starter")
        .join(known, ["entity_id", "member_id"], "left")
        .groupBy("match_id", "side")
        .agg(
            F.coalesce(F.sum(F.when(F.col("is_spine"), value)), F.lit(0.0)).alias("spine_impact"),
            F.sum(value).alias("total_impact"),
        )
    )


def early_season(df: DataFrame) -> DataFrame:
    """How far the season's data can be trusted, and the rating difference damped by it."""
    trust = F.coalesce(clipped("round_number", high=8) / 8.0, F.lit(0.5))
    return df.withColumns(
        {
            "season_data_reliability": trust,
            "elo_confidence": F.coalesce("elo_diff", F.lit(0.0)) * trust,
            "home_form_reliability": known_share(*[f"home_{c}" for c in FORM_COLUMNS]),
            "away_form_reliability": known_share(*[f"away_{c}" for c in FORM_COLUMNS]),
        }
    )


def game_context(df: DataFrame, rounds: float = 27.0, cut: float = 8.0) -> DataFrame:
    """Pressure around the finals cut, elimination level and asymmetry of the standings."""
    left = clipped(1.0 - F.coalesce("round_number", F.lit(1)) / rounds, 0.0, 1.0)
    place = {s: F.coalesce(F.col(f"{s}_position").cast("double"), F.lit(cut)) for s in ("home", "away")}
    level = F.when(has_any("round_label", ELIMINATION_WORDS), 1.0).otherwise(0.0)
    return df.withColumns(
        {
            "home_finals_pressure": (place["home"] - cut) * (1.0 - left),
            "away_finals_pressure": (place["away"] - cut) * (1.0 - left),
            "is_elimination": F.when(F.col("is_finals") == 1, F.greatest(level, F.lit(0.5))).otherwise(level),
            "nothing_to_lose_diff": F.abs(place["home"] - place["away"]),
        }
    )


def travel(df: DataFrame, interstate_km: float = 300.0, overseas_km: float = 2100.0) -> DataFrame:
    """Distances of both sides to the venue from resolved coordinates.

    Needs ``home_lat/lon``, ``away_lat/lon``, ``venue_lat/lon``; an unresolved place gives distance 0
    and is marked. Overseas is decided by longitude when the venue is known (``away_is_abroad`` marks
    sides based abroad), else by distance.
    """

    def km(side: str) -> Column:
        d = haversine_km(f"{side}_lat", f"{side}_lon", "venue_lat", "venue_lon")
        return F.coalesce(d, F.lit(0.0))

    resolved = F.col("venue_lat").isNotNull()
    abroad = ~F.col("venue_lon").between(100.0, 160.0)
    overseas = F.when(resolved, abroad | F.coalesce("away_is_abroad", F.lit(False))).otherwise(km("away") >= overseas_km)
    return df.withColumns(
        {
            "home_travel_km": km("home"),
            "away_travel_km": km("away"),
            "travel_diff_km": km("away") - km("home"),
            "away_is_overseas": overseas.cast("double"),
            "away_is_interstate": ((km("away") >= interstate_km) & ~overseas).cast("double"),
            "venue_resolved": resolved,
        }
    )


def weather_features(df: DataFrame, blank_when_missing: bool = False) -> DataFrame:
    """Rain, wind and cold flags, ground severity, their product and a composite score.

    A missing ground report is unknown; ``blank_when_missing`` reads it as a blank (good) one.
    """
    report = F.trim("ground_conditions")
    seen = F.coalesce(report, F.lit("")) if blank_when_missing else report
    severity = looked_up(seen, GROUND_SEVERITY).cast("double")
    rainy, windy = flag(F.col("precipitation_mm") > 1.0), flag(F.col("wind_speed_kmh") > 30)
    zero = F.lit(0.0)
    anything = severity.isNotNull() | rainy.isNotNull() | windy.isNotNull()
    return df.withColumns(
        {
            "is_rainy": rainy,
            "is_windy": windy,
            "is_cold_actual": flag(F.col("temperature_c") < 12),
            "ground_not_good": flag(report.isin(*GROUND_NOT_GOOD)),
            "ground_severity": severity,
            "rain_x_wind": F.col("precipitation_mm") * F.col("wind_speed_kmh"),
            "bad_conditions_score": F.when(
                anything, F.coalesce(severity, zero) + F.coalesce(rainy, zero) + F.coalesce(windy, zero)
            ),
        }
    )


weather_proxy_features = weather_features  # the name older callers use
