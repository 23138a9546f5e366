"""Decision rules and the bookkeeping around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: category thresholds on the favourite's probability, and the flip threshold
LOCK, LEAN, FLIP = 0.65, 0.55, 0.52


def category(favourite: str | Column) -> Column:
    """How close the game is, from the favourite's probability."""
    p = F.col(favourite) if isinstance(favourite, str) else favourite
    return F.when(p >= LOCK, "LOCK").when(p >= LEAN, "LEAN").when(p.isNotNull(), "TOSS-UP")


def picked_right(prob: str | Column, outcome: str = "home_win", tie_home: bool = True) -> Column:
    """1 when the side the probability favours won; exactly one half goes to the home side by default."""
    prob = F.col(prob) if isinstance(prob, str) else prob
    home = prob >= 0.5 if tie_home else prob > 0.5
    return (home == (F.col(outcome) == 1)).cast("int")


def blended_picks(predictions: DataFrame, model_weight: float = 0.495) -> DataFrame:
    """Played, priced games with the three pickers (market, model, blend) judged."""
    blend = F.lit(model_weight) * F.col("model_prob") + F.lit(round(1 - model_weight, 12)) * F.col("odds_prob")
    return (
        predictions.filter(F.col("odds_prob").isNotNull() & F.col("home_win").isNotNull())
        .withColumn("blend_prob", blend)
        .withColumns(
            {
                "odds_correct": picked_right("odds_prob"),
                "model_correct": picked_right("model_prob"),
                "tip_correct": picked_right("blend_prob"),
                "confidence": F.abs(F.col("blend_prob") - 0.5) * 2,
            }
        )
    )


def missing_decisions(events: DataFrame, decided: DataFrame, key: str, starts: str, cutoff: Column) -> DataFrame:
    """Events starting at or after the cutoff for which no decision was handed in."""
    return events.filter(F.col(starts) >= cutoff).join(decided.select(key), key, "left_anti")


def starting_soon(events: DataFrame, starts: str, now: Column, from_minutes: int = 30, to_minutes: int = 90) -> DataFrame:
    """Events that start between ``from_minutes`` and ``to_minutes`` after ``now``."""
    low = now + F.make_dt_interval(mins=F.lit(from_minutes))
    high = now + F.make_dt_interval(mins=F.lit(to_minutes))
    return events.filter(F.col(starts).between(low, high))


def weight_grid(picks: DataFrame, steps: int) -> DataFrame:
    """Right decisions of every blend weight ``step / steps``.

    The grid is a fixed literal exploded per row and combined on the map side, so the shuffle
    carries one row per weight and task.
    """
    grid = picks.select("model_prob", "odds_prob", "home_win", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    w = F.col("step") * F.lit(1.0 / steps)
    right = picked_right(w * F.col("model_prob") + (1 - w) * F.col("odds_prob"))
    return grid.groupBy(F.col("step").cast("long").alias("step")).agg(
        F.sum(right).alias("correct"), F.count(F.lit(1)).alias("games")
    )


def decision_changes(old: DataFrame, new: DataFrame, min_shift: float = 0.05) -> DataFrame:
    """Matches whose decision flipped or whose probability moved by more than ``min_shift``."""
    both = old.select("match_id", F.col("prob").alias("old_prob")).join(
        new.select("match_id", F.col("prob").alias("new_prob")), "match_id"
    )
    out = both.withColumns(
        {
            "is_flip": (F.col("old_prob") >= 0.5) != (F.col("new_prob") >= 0.5),
            "shift": F.col("new_prob") - F.col("old_prob"),
        }
    )
    return out.filter(F.col("is_flip") | (F.abs("shift") > min_shift))


def latest_predictions(predictions: DataFrame, key: str) -> DataFrame:
    """Matchup text, decision and probability; alternative column names of older files are accepted."""

    def either(*names: str) -> Column:
        known = [F.col(n) for n in names if n in predictions.columns]
        return F.coalesce(*known) if known else F.lit(None)

    prob = F.coalesce(either("home_win_prob", "prob").cast("double"), F.lit(0.5))
    leaning = F.when(prob >= 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    return predictions.select(
        F.concat_ws(" v ", "home_team", "away_team").alias("matchup"),
        key,
        F.coalesce(either("tip", "tipped_team").cast("string"), leaning).alias("decision"),
        prob.alias("prob"),
    )


def best_step(picks: DataFrame, steps: int, by: list[str]) -> DataFrame:
    """Most accurate blend weight per group, ties to the smaller weight."""
    grid = picks.select(*by, "model_prob", "odds_prob", "home_win", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    w = F.col("step") * F.lit(1.0 / steps)
    right = picked_right(w * F.col("model_prob") + (1 - w) * F.col("odds_prob"))
    scored = grid.groupBy(*by, F.col("step").cast("long").alias("step")).agg((F.sum(right) / F.count(F.lit(1))).alias("accuracy"))
    return scored.groupBy(*by).agg(
        F.max_by("step", F.struct("accuracy", (-F.col("step")).alias("s"))).alias("best_step"), F.max("accuracy").alias("best_accuracy")
    )


def implied(home_odds: str, away_odds: str) -> dict[str, Column]:
    """Normalised probabilities and the margin they imply (25 points per unit of difference)."""
    from duelframe.functions.numbers import fair_pair

    home, away, _ = fair_pair(home_odds, away_odds)
    return {"home_prob": home, "away_prob": away, "implied_margin": F.bround(F.abs(home - away) * 25, 1)}


def decide(
    home_odds: str, away_odds: str, model: str, spread: str, home: str = "home_id", away: str = "away_id", tie_home: bool = False
) -> Column:
    """The decision rule as one struct: tip, category, confidence 1-4, source, margin, favourite.

    Clear favourites are taken. A moderate favourite is kept unless the model gives the other side
    more than the flip threshold. A coin flip goes to the model. Without a model the favourite is
    taken. At exactly one half the away side counts as favourite unless ``tie_home``.
    """
    parts = implied(home_odds, away_odds)
    hp, ap = parts["home_prob"], parts["away_prob"]
    fav_home = hp >= ap if tie_home else hp > ap
    fav_prob = F.greatest(hp, ap)
    fav = F.when(fav_home, F.col(home)).otherwise(F.col(away))
    other = F.when(fav_home, F.col(away)).otherwise(F.col(home))
    p = F.col(model)
    known = p.isNotNull()
    group = category(fav_prob)
    disagrees = known & ((p > 0.5) != fav_home)
    against = F.when(fav_home, 1 - p).otherwise(p)
    lean, toss = group == "LEAN", group == "TOSS-UP"
    flips = F.coalesce(lean & disagrees & (against > FLIP), F.lit(False))
    coin = F.coalesce(toss & known, F.lit(False))
    tip = F.when(flips, other).when(coin, F.when(p > 0.5, F.col(home)).otherwise(F.col(away))).otherwise(fav)
    confidence = (
        F.when(group == "LOCK", F.when(fav_prob >= 0.75, 4).otherwise(3))
        .when(lean, F.when(known & ~disagrees, 3).otherwise(2))
        .when(toss, F.when(known, 2).otherwise(1))
    )
    margin = F.when(F.col(spread).isNotNull(), F.abs(F.bround(F.col(spread)))).otherwise(parts["implied_margin"])
    return F.when(
        hp.isNotNull(),
        F.struct(
            tip.alias("tip"),
            group.alias("category"),
            confidence.alias("confidence"),
            F.when(flips, "MODEL FLIP").when(coin, "MODEL").otherwise("ODDS").alias("source"),
            margin.alias("margin"),
            fav.alias("favourite"),
            fav_prob.alias("favourite_prob"),
        ),
    )


def winning_margin(spread: str | Column, market_prob: str | Column) -> Column:
    """Margin estimate from the spread (or one implied by the price), to even, at least 2, else 12."""
    from duelframe.functions.numbers import to_even

    spread = F.col(spread) if isinstance(spread, str) else spread
    market_prob = F.col(market_prob) if isinstance(market_prob, str) else market_prob
    size = F.coalesce(F.abs(spread), F.abs(market_prob - 0.5) * 2 * 20)
    return F.when(size.isNotNull(), F.greatest(F.lit(2.0), to_even(size * 0.54 + 12.3))).otherwise(12.0)


def missing_impact(changes: DataFrame, impact: DataFrame, sides: DataFrame) -> DataFrame:
    """Per match, the (negated) impact sums of the members missing from each side."""
    valued = changes.join(
        impact.select("entity_id", F.col("member_name").alias("expected"), "impact"), ["entity_id", "expected"], "left"
    )
    per_side = valued.join(sides, ["match_id", "entity_id"]).groupBy("match_id").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "home", -F.coalesce("impact", F.lit(0.0)))), F.lit(0.0)).alias("home_raw"),
        F.coalesce(F.sum(F.when(F.col("side") == "away", -F.coalesce("impact", F.lit(0.0)))), F.lit(0.0)).alias("away_raw"),
        F.count(F.lit(1)).alias("changes"),
    )
    return per_side


def net_shift(home_raw: str, away_raw: str, cap: float | Column = 0.15, side_cap: float = 0.15) -> Column:
    """Difference of the capped side sums, capped again."""

    def capped(c: Column, limit) -> Column:
        limit = F.lit(limit) if isinstance(limit, float) else limit
        return F.greatest(-limit, F.least(limit, c))

    return capped(capped(F.col(home_raw), side_cap) - capped(F.col(away_raw), side_cap), cap)


def adjusted_probability(prob: Column, shift: Column) -> Column:
    """Shift a probability, within [0.05, 0.95]."""
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), prob + shift))


def adjust_for_lineups(predictions: DataFrame, missing: DataFrame, prob: str = "prob") -> DataFrame:
    """Apply the net shift where it exceeds 0.001; the tip and the confidence follow."""
    df = predictions.join(missing, "match_id", "left")
    shift = F.coalesce(net_shift("home_raw", "away_raw"), F.lit(0.0))
    new = F.when(F.abs(shift) > 0.001, adjusted_probability(F.col(prob), shift)).otherwise(F.col(prob))
    return df.withColumn("new_prob", new).withColumns(
        {"tip_home": F.col("new_prob") >= 0.5, "confidence": F.abs(F.col("new_prob") - 0.5) * 2}
    )


def pre_start_check(predictions: DataFrame, missing: DataFrame, auto: bool = False, guard: float = 0.20) -> DataFrame:
    """Line-up check before the start: shift damped in round 1, swings of clear favourites blocked.

    By default only the shift is reported and the tip stays (``auto`` off).
    """
    df = predictions.join(missing, "match_id")
    damp = F.when(F.col("round") <= 1, 0.25).otherwise(1.0) if auto else F.lit(1.0)
    shift = net_shift("home_raw", "away_raw") * damp
    new = adjusted_probability(F.col("prob"), shift)
    old_home, new_home = F.col("prob") >= 0.5, new >= 0.5
    clear = F.abs(F.col("prob") - 0.5) * 2 > guard
    tip = F.when((new_home != old_home) & clear, old_home).otherwise(new_home) if auto else old_home
    return df.select(
        "match_id", "changes", (new - F.col("prob")).alias("prob_shift"), new.alias("new_prob"), tip.alias("tip_home"),
        (tip != old_home).alias("is_swing"),
    )


def refresh_close_calls(
    predictions: DataFrame, fresh: DataFrame, threshold: float = 0.60, model_weight: float = 0.25
) -> DataFrame:
    """Blend close calls anew with fresh prices; clear calls stay out. A missing model probability is
    recovered from the old blend."""
    w, o = F.lit(model_weight), F.lit(1.0 - model_weight)
    close = predictions.filter(F.abs(F.col("old_prob") - 0.5) * 2 <= round((threshold - 0.5) * 2, 12))
    recovered = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col("old_prob") - o * F.col("old_market")) / w))
    model = F.coalesce("model_prob", recovered)
    new = F.greatest(F.lit(0.01), F.least(F.lit(0.99), w * model + o * F.col("fresh_market")))
    return close.join(fresh, "match_id").select(
        "match_id",
        "old_prob",
        new.alias("new_prob"),
        (F.col("fresh_market") - F.col("old_market")).alias("market_move"),
        ((new >= 0.5) != (F.col("old_prob") >= 0.5)).alias("is_flip"),
    )


def payload(decisions: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """Decisions to hand in: events not started yet, external ids, margin within the event's limits
    where a margin is asked for."""
    low, high = F.coalesce("margin_min", F.lit(1)), F.coalesce("margin_max", F.lit(100))
    return (
        events.filter(F.lower("status") == "pre")
        .join(decisions, "match_id")
        .join(ids, "tip")
        .select(
            "event_id",
            "external_id",
            F.when(F.col("margin_required"), F.greatest(low, F.least(high, F.col("margin")))).alias("margin"),
        )
    )


def day_schedule(
    events: DataFrame, starts: str, deadline_hours: int = 3, lead_hours: int = 2, trail_minutes: int = 30, repredict_minutes: int = 90
) -> DataFrame:
    """Per day: deadline, check window and time of the last re-prediction around the day's events."""
    days = events.groupBy(F.to_date(starts).alias("day")).agg(
        F.min(starts).alias("first_start"), F.max(starts).alias("last_start"), F.count(F.lit(1)).alias("games")
    )

    def ago(hours: int = 0, mins: int = 0) -> Column:
        return F.make_dt_interval(hours=F.lit(hours), mins=F.lit(mins))

    return days.select(
        "day",
        "games",
        (F.col("first_start") - ago(deadline_hours)).alias("deadline"),
        (F.col("first_start") - ago(lead_hours)).alias("check_start"),
        (F.col("last_start") + ago(0, trail_minutes)).alias("check_end"),
        (F.col("first_start") - ago(0, repredict_minutes)).alias("repredict_at"),
    )


def record_round(predictions: DataFrame) -> DataFrame:
    """Categories, picks and correctness flags of judged games, as the decision log stores them."""
    d = decide("h2h_home", "h2h_away", "model_prob", "spread_home")
    home, away = F.col("home_id"), F.col("away_id")
    winner = F.when(F.col("home_score") > F.col("away_score"), home).when(F.col("home_score") < F.col("away_score"), away)
    model_pick = F.when(F.col("model_prob") > 0.5, home).otherwise(away)
    market_pick = F.when(F.col("odds_prob") > 0.5, home).otherwise(away)

    def right(pick: Column) -> Column:
        return F.coalesce(pick == winner, F.lit(False)).cast("int")

    return (
        predictions.filter(F.col("home_score").isNotNull() & F.col("odds_prob").isNotNull())
        .withColumn("_d", d)
        .select(
            F.col("year").alias("season"),
            "round",
            "match_id",
            F.col("_d.category").alias("category"),
            F.col("_d.tip").alias("tip"),
            "home_score",
            "away_score",
            winner.alias("winner"),
            right(F.col("_d.tip")).alias("tip_correct"),
            right(model_pick).alias("model_correct"),
            right(market_pick).alias("fav_correct"),
            (model_pick == market_pick).cast("int").alias("model_agreed_odds"),
        )
    )


def drift_alarm(metrics: DataFrame, recent: DataFrame, points: float = 0.05) -> DataFrame:
    """Seasons whose recent accuracy is more than ``points`` behind the market's."""
    both = metrics.join(recent, "year")
    return both.select(
        "year",
        "recent_accuracy",
        "recent_odds_accuracy",
        (F.col("recent_odds_accuracy") - F.col("recent_accuracy") > points).alias("alarm"),
    )
