"""Look-back features. Every frame ends before the current row, so no feature sees its own event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.operators.history import Frames, Layout, lookback, running


def mean_of(frames: Frames, n: int, **columns: str | Column) -> dict[str, Column]:
    """``name_n``: mean of each column over the previous ``n`` rows, skipping NULL."""
    return {f"{name}_{n}": F.avg(c).over(frames.prior(n)) for name, c in columns.items()}


def rolling_form(
    log: DataFrame,
    layout: Layout,
    windows: Sequence[int] = (3, 5, 8),
    side_window: int = 5,
    legacy_unscored: bool = False,
) -> DataFrame:
    """Win rate, points for and against and margin over the previous games, and the last result.

    Frames count games, means skip missing values. With ``legacy_unscored`` a game without a score
    enters the win rate as a loss; otherwise it is left out.
    """
    result = F.coalesce("result", F.lit(0.0)) if legacy_unscored else F.col("result")

    def columns(f: Frames) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for n in windows:
            made |= mean_of(f, n, win_rate=result, avg_pf="points_for", avg_pa="points_against", avg_margin="margin")
        for extra in ("halftime_lead", "penalty_diff"):
            if extra in log.columns:
                made |= mean_of(f, side_window, **{f"avg_{extra}": extra})
        return made | {"last_result": F.max(result).over(f.prior(1))}

    return lookback(log, layout, max(*windows, side_window), columns)


def streak(log: DataFrame, layout: Layout, result: str = "result") -> DataFrame:
    """Length of the run of equal results before this game: positive for wins, negative otherwise.

    Games without a result neither extend nor break a run. The length is the number of scored games
    since the last change, so it needs two growing totals and one last-known value. In an opened history
    they grow within the cell, and its first run goes on from the one before the cell.
    """
    if layout.depth:
        return _streak_of_cells(log, layout, result)
    has = F.col(result).isNotNull()
    df = lookback(
        log, layout, 1, lambda f: {"_prev": F.last(result, ignorenulls=True).over(f.before)}, carry=has
    )
    df = running(df, layout, {"_n": ("count", F.col(result))})
    changed = has & (F.col("_prev").isNull() | (F.col("_prev") != F.col(result)))
    df = running(df, layout, {"_start": ("max", F.when(changed, F.col("_n")))})
    length = (F.col("_n") - F.col("_start")).cast("int")
    return df.withColumn(
        "streak",
        F.when(F.col("_prev").isNull(), F.lit(0)).when(F.col("_prev") == 1.0, length).otherwise(-length),
    ).drop("_prev", "_n", "_start")


def _streak_of_cells(log: DataFrame, layout: Layout, result: str) -> DataFrame:
    before = Frames(layout.partition, layout.order).before
    df = log.withColumn("_own", F.when(~F.col("_is_halo"), F.col(result)))
    df = df.select(
        "*",
        F.last("_own", ignorenulls=True).over(before).alias("_prev"),
        F.first("_own", ignorenulls=True).over(before).alias("_first"),
        F.count("_own").over(before).alias("_n"),
    )
    changed = F.col("_own").isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") != F.col("_own")))
    df = df.withColumn("_start", F.max(F.when(changed, F.col("_n"))).over(before))
    goes_on = (F.col("_start") == 0) & (F.col("_first") == F.col("_run_of"))
    inside = F.col("_n") - F.col("_start") + F.when(goes_on, F.col("_run")).otherwise(0)
    length = F.when(F.col("_prev").isNull(), F.col("_run")).otherwise(inside).cast("int")
    last = F.coalesce("_prev", "_run_of")
    return df.withColumn(
        "streak", F.when(last.isNull(), F.lit(0)).when(last == 1.0, length).otherwise(-length)
    ).drop("_own", "_prev", "_first", "_n", "_start")


def scoring_consistency(
    log: DataFrame,
    layout: Layout,
    windows: Sequence[int] = (5, 8),
    close_margin: int = 6,
    recent: int = 3,
    at_least: int = 3,
) -> DataFrame:
    """Spread, share of close games and short-against-long trend; NULL before ``at_least`` games."""
    close = F.when(F.col("margin").isNotNull(), (F.abs("margin") <= close_margin).cast("double"))

    def columns(f: Frames) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for n in windows:
            frame, short = f.prior(n), f.prior(recent)
            enough = F.count(F.lit(1)).over(frame) >= at_least
            for name, c in (("pf", "points_for"), ("pa", "points_against")):
                made[f"{name}_std_{n}"] = F.when(enough, F.stddev_samp(c).over(frame))
                made[f"{name}_trend_{n}"] = F.when(enough, F.avg(c).over(short) - F.avg(c).over(frame))
            made[f"close_game_rate_{n}"] = F.when(enough, F.avg(close).over(frame))
        return made

    return lookback(log, layout, max(*windows, recent), columns)


def scoring_cv(std: str, mean: str) -> Column:
    """Coefficient of variation with the mean floored at one."""
    return F.col(std) / F.when(F.col(mean).isNotNull(), F.greatest(F.col(mean), F.lit(1.0)))


def schedule(log: DataFrame, layout: Layout, short_rest: int = 6, bye: int = 11) -> DataFrame:
    """Days since the previous game, with short-rest and bye flags (0 for the first game)."""
    df = lookback(log, layout, 1, lambda f: {"_last": F.max(layout.date).over(f.prior(1))})
    rest = F.datediff(F.col(layout.date), F.col("_last"))
    return df.withColumns(
        {
            "days_rest": rest,
            "is_back_to_back": F.coalesce(rest < short_rest, F.lit(False)).cast("int"),
            "bye_last_round": F.coalesce(rest >= bye, F.lit(False)).cast("int"),
        }
    ).drop("_last")


def paired_events(matches: DataFrame) -> DataFrame:
    """Scored-meeting measures from the lower id's point of view, keyed by the unordered pair."""
    low_is_home = F.col("home_id") < F.col("away_id")
    margin = F.col("home_score") - F.col("away_score")
    seen = F.when(low_is_home, margin).otherwise(-margin)
    return matches.select(
        "match_id",
        "event_date",
        F.least("home_id", "away_id").alias("low_id"),
        F.greatest("home_id", "away_id").alias("high_id"),
        low_is_home.alias("low_is_home"),
        seen.alias("pair_margin"),
        F.when(seen > 0, 1.0).when(seen == 0, 0.5).when(seen < 0, 0.0).alias("pair_win"),
    )


def head_to_head(pairs: DataFrame, layout: Layout, lookbacks: Sequence[int] = (3, 5)) -> DataFrame:
    """Win rate, mean margin and number of the last meetings, seen from the current home side.

    Only scored meetings count: rows are positioned by the number of scored meetings before them,
    and a range frame over that position holds exactly the last ``n`` scored ones.
    """
    totals = {
        "_pos": ("count", F.col("pair_margin")),
        "_m_all": ("sum", F.col("pair_margin")),
        "_w_all": ("sum", F.col("pair_win")),
    }
    df = running(pairs, layout, totals)

    def columns(f: Frames) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for n in lookbacks:
            frame = f.prior_by("_pos", n)
            made[f"_n_{n}"] = F.count("pair_margin").over(frame)
            made[f"_m_{n}"] = F.sum("pair_margin").over(frame)
            made[f"_w_{n}"] = F.sum("pair_win").over(frame)
        return made

    df = lookback(df, layout, max(lookbacks), columns, carry=F.col("pair_margin").isNotNull())
    out: dict[str, Column] = {}
    for n in [*lookbacks, "all"]:
        count = F.col("_pos") if n == "all" else F.col(f"_n_{n}")
        rate = F.try_divide(F.col(f"_w_{n}"), count)
        mean = F.try_divide(F.col(f"_m_{n}").cast("double"), count)
        out[f"h2h_home_win_rate_{n}"] = F.when(F.col("low_is_home"), rate).otherwise(1.0 - rate)
        out[f"h2h_avg_margin_{n}"] = F.when(F.col("low_is_home"), mean).otherwise(-mean)
        out[f"h2h_matches_{n}"] = count
    return df.select("match_id", *[c.alias(name) for name, c in out.items()])


def venue_record(log: DataFrame, layout: Layout) -> DataFrame:
    """Share of earlier scored games at this venue that the participant won (a draw is no win)."""
    won = F.when(F.col("margin").isNotNull(), (F.col("margin") > 0).cast("long"))
    df = running(log, layout, {"_won": ("sum", won), "_played": ("count", F.col("margin"))})
    return df.withColumn("venue_win_rate", F.try_divide(F.col("_won"), F.col("_played"))).drop("_won", "_played")


def expanding_mean(df: DataFrame, layout: Layout, value: Column, name: str, count: str | None = None) -> DataFrame:
    """Mean of ``value`` over all earlier rows of the history, and optionally how many there were."""
    df = running(df, layout, {"_s": ("sum", value), "_c": ("count", value)})
    df = df.withColumn(name, F.try_divide(F.col("_s").cast("double"), F.col("_c")))
    if count:
        df = df.withColumn(count, F.col("_c"))
    return df.drop("_s", "_c")


def home_ground(log: DataFrame, season: Layout, season_venue: Layout, at_least: int = 3) -> DataFrame:
    """Home games so far this season, in all and at this venue, for both roles of the match.

    The log holds a participant's home *and* away rows, so the away side's count of its own home
    games is read off its away row: no as-of join is needed.
    """
    hosted = F.when((F.col("side") == "home") & F.col("margin").isNotNull(), 1)
    df = running(log, season, {"_all": ("count", hosted)})
    df = running(df, season_venue, {"_here": ("count", hosted)})
    return df.withColumn(
        "home_share", F.when(F.col("_all") >= at_least, F.col("_here") / F.col("_all"))
    ).drop("_all", "_here")


def ground_flags(sides: DataFrame, owner: float = 0.5, neutral: float = 0.3) -> DataFrame:
    """``is_home_ground`` (NULL before three home games) and ``is_neutral_venue``."""
    foreign = (F.col("home_home_share") < neutral) & (F.col("away_home_share") < neutral)
    return sides.withColumns(
        {
            "is_home_ground": (F.col("home_home_share") > owner).cast("double"),
            "is_neutral_venue": F.coalesce(foreign, F.lit(False)).cast("int"),
        }
    )


def attendance_ratio(matches: DataFrame, layout: Layout, at_least: int = 3, high: float = 1.2) -> DataFrame:
    """Attendance against the host's mean so far, NULL before ``at_least`` known crowds."""
    df = expanding_mean(matches, layout, F.col("attendance"), "_mean", "_known")
    usual = F.when(F.col("_known") >= at_least, F.col("_mean"))
    return df.withColumns(
        {
            "attendance_normalized": F.try_divide(F.col("attendance").cast("double"), usual),
            "attendance_high": (F.col("attendance") > usual * high).cast("double"),
        }
    ).drop("_mean", "_known")


def official_record(matches: DataFrame, layout: Layout, high: float = 0.60) -> DataFrame:
    """Home-win share of an official's earlier scored games; the flag is 0 where it is unknown."""
    home_win = F.when(F.col("home_score").isNotNull(), (F.col("home_score") > F.col("away_score")).cast("long"))
    df = expanding_mean(matches, layout, home_win, "ref_home_win_rate", "ref_games")
    return df.withColumn(
        "ref_is_high_home", F.coalesce(F.col("ref_home_win_rate") > high, F.lit(False)).cast("double")
    )


def rolling_stats(log: DataFrame, layout: Layout, stats: Sequence[str], windows: Sequence[int] = (3, 5)) -> DataFrame:
    """Means of process statistics over the previous games; all frames share one sort."""

    def columns(f: Frames) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for n in windows:
            made |= mean_of(f, n, **{f"avg_{s}": s for s in stats})
        return made

    return lookback(log, layout, max(windows), columns)


def weighted_rolling(
    log: DataFrame, layout: Layout, stats: Sequence[str], weight: str = "weight", n: int = 5
) -> DataFrame:
    """Weighted mean over the previous ``n`` games; the weight counts only where the value is known."""

    def columns(f: Frames) -> dict[str, Column]:
        frame, made = f.prior(n), {}
        for s in stats:
            used = F.when(F.col(s).isNotNull(), F.col(weight))
            made[f"oa_{s}_{n}"] = F.try_divide(F.sum(F.col(s) * F.col(weight)).over(frame), F.sum(used).over(frame))
        return made

    return lookback(log, layout, n, columns)


def opponent_weight(log: DataFrame, rating: str = "opponent_rating", season: str = "year") -> DataFrame:
    """Opponent rating over the season's mean rating (one small aggregate, joined on the season)."""
    means = log.groupBy(season).agg(F.avg(rating).alias("_mean"))
    known = F.coalesce(F.col(rating).cast("double"), F.col("_mean"))
    return log.join(means, season, "left").withColumn(
        "weight", F.coalesce(F.try_divide(known, F.col("_mean")), F.lit(1.0))
    ).drop("_mean")


def member_form(
    members: DataFrame, layout: Layout, stats: Sequence[str], windows: Sequence[int] = (3, 5)
) -> DataFrame:
    """First stage: every member's own means over the previous games. Second stage: the line-up's
    mean over its starters and over its key members."""
    own = rolling_stats(members, layout, stats, windows)
    names = [f"avg_{s}_{n}" for s in stats for n in windows]
    return own.groupBy("match_id", "side").agg(
        *[F.avg(F.when(F.col("is_starter"), F.col(c))).alias(f"starter_{c}") for c in names],
        *[F.avg(F.when(F.col("is_spine"), F.col(c))).alias(f"spine_{c}") for c in names],
    )


def season_period(matches: DataFrame, months: Sequence[int] = (6, 7), share: float = 0.5, cap: int = 3) -> DataFrame:
    """Rounds with at least ``share`` of their games in ``months``, numbered within the season."""
    rounds = matches.groupBy("year", "round").agg(
        (F.avg(F.month("event_date").isin(*months).cast("double")) >= share).alias("_in")
    )
    nth = F.row_number().over(Window.partitionBy("year", "_in").orderBy("round"))
    return rounds.select(
        "year",
        "round",
        F.col("_in").cast("double").alias("is_period"),
        F.when(F.col("_in"), F.least(nth, F.lit(cap))).otherwise(0).alias("period_round_number"),
    )


def workload(members: DataFrame, heavy: int = 75, value: str = "minutes") -> DataFrame:
    """Per participant and round: mean load of starters and key members, number of heavy loads."""
    return members.filter("is_starter").groupBy("entity_id", "year", "round").agg(
        F.avg(value).alias("starter_load"),
        F.avg(F.when(F.col("is_spine"), F.col(value))).alias("spine_load"),
        F.count_if(F.col(value) > heavy).alias("heavy_count"),
    )


def rolling_workload(rounds: DataFrame, n: int = 3) -> DataFrame:
    """Means over the previous ``n`` rounds; a participant has at most a few dozen rounds a year."""
    frame = Window.partitionBy("entity_id").orderBy("year", "round").rowsBetween(-n, -1)
    return rounds.select(
        "entity_id",
        "year",
        "round",
        F.avg("starter_load").over(frame).alias(f"starter_load_{n}"),
        F.avg("spine_load").over(frame).alias(f"spine_load_{n}"),
        F.avg("heavy_count").over(frame).alias(f"heavy_load_{n}"),
    )


def composite_form(games: DataFrame, layout: Layout, windows: Sequence[int] = (3, 5)) -> DataFrame:
    """Previous-games means of per-game composites; a composite is the mean of its known parts."""
    names = ["attack", "spine_attack", "error_rate", "errors"]
    return rolling_stats(games, layout, names, windows)


def known_mean(*columns: str) -> Column:
    """Mean of the non-NULL columns of a row, NULL when none is known."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, known)


def cumulative_rate(rounds: DataFrame, season: str = "year") -> DataFrame:
    """Running sum of correct decisions and their rate by round of a per-round table."""
    w = Window.partitionBy(season).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumns(
        {
            "cum_correct": F.sum("correct").over(w),
            "cum_rate": F.sum("correct").over(w) / F.sum("games").over(w),
        }
    )


def latest_rounds(rounds: DataFrame, n: int = 3, season: str = "year") -> DataFrame:
    """Rows of the last ``n`` rounds of each season of a per-round table."""
    rank = F.dense_rank().over(Window.partitionBy(season).orderBy(F.desc("round")))
    return rounds.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def rank_features(importance: DataFrame) -> DataFrame:
    """Rank features of each season by importance, ties by name."""
    w = Window.partitionBy("year").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w))

