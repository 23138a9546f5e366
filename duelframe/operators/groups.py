"""Members of a participant: line-ups, identity, expected starters, continuity, with/without effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.operators.history import Layout, lookback, measure
from duelframe.session import cut_lineage


def lineups(log: DataFrame, appearances: DataFrame) -> DataFrame:
    """One row per match and side with its starters, NULL where the line-up is unknown.

    Only starters are collected, and a line-up has a fixed number of slots, so the arrays are small
    whatever the size of the table.
    """
    starters = appearances.filter("is_starter").groupBy("match_id", "side").agg(
        F.sort_array(F.collect_set("member_id")).alias("starters"),
        F.map_from_entries(F.collect_set(F.struct("slot", "member_id"))).alias("by_slot"),
    )
    return log.select("match_id", "event_date", "side", "entity_id").join(starters, ["match_id", "side"], "left")


def lineup_stability(lines: DataFrame, layout: Layout) -> DataFrame:
    """Share of the current starters who were in the last known line-up."""
    narrow = lines.select("match_id", "event_date", "side", "entity_id", "starters")
    df = lookback(
        narrow,
        layout,
        1,
        lambda f: {"_prev": F.last("starters", ignorenulls=True).over(f.before)},
        carry=F.col("starters").isNotNull(),
    )
    kept = F.size(F.array_intersect("starters", "_prev"))
    known = F.col("starters").isNotNull() & F.col("_prev").isNotNull()
    return df.withColumn("lineup_stability", F.when(known, kept / F.size("starters"))).drop("_prev")


def slot_changes(lines: DataFrame, layout: Layout, slots: Sequence[int]) -> DataFrame:
    """Number of slots held by someone else than in the previous game (an empty slot is a holder too)."""
    narrow = lines.select("match_id", "event_date", "side", "entity_id", "by_slot")
    df = lookback(narrow, layout, 1, lambda f: {"_prev": F.last("by_slot").over(f.prior(1))})
    changed = sum(
        (
            (~F.try_element_at("by_slot", F.lit(k)).eqNullSafe(F.try_element_at("_prev", F.lit(k)))).cast("int")
            for k in slots
        ),
        F.lit(0),
    )
    known = F.col("by_slot").isNotNull() & F.col("_prev").isNotNull()
    return df.withColumn("slot_changes", F.when(known, changed)).drop("_prev", "by_slot")


def identity_islands(seen: DataFrame, keys: Sequence[str], year: str = "year", max_gap: int = 2) -> DataFrame:
    """A name is the same person while the gap between the years it was seen is at most ``max_gap``.

    Years are made distinct first (combined before the shuffle), so a key's window holds one row
    per year it appeared in.
    """
    years = seen.select(*keys, year).distinct()
    w = Window.partitionBy(*keys).orderBy(year)
    gap = (F.col(year) - F.lag(year).over(w) > max_gap).cast("long")
    isle = years.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("isle", F.sum("_gap").over(w))
    return isle.withColumn(
        "first_year", F.min(year).over(Window.partitionBy(*keys, "isle"))
    ).drop("_gap")


def identity_key(keys: Sequence[str]) -> Column:
    """Stable identifier of an island: its keys and first year."""
    return F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.col("first_year").cast("string"))


def expected_starters(appearances: DataFrame, n: int = 5, max_rows: int | None = None) -> DataFrame:
    """Most frequent holder of each slot over a participant's previous ``n`` matches, ties to the
    smallest id.

    Each match carries its starters, a bounded number, to the window over its participant's matches,
    and the choice among those of the ``n`` matches before is made within the row. No starter row is
    repeated for the matches it counts for.
    """
    sides = appearances.filter(F.col("entity_id").isNotNull())
    held = F.when(F.col("is_starter") & F.col("match_id").isNotNull(), F.struct("slot", "member_id"))
    games = (
        sides.groupBy("entity_id", "match_id")
        .agg(F.collect_set(F.struct("event_date")).alias("_days"), F.collect_list(held).alias("_held"))
        .select("entity_id", "match_id", F.explode("_days").alias("_day"), "_held")
        .select("entity_id", "match_id", "_day.event_date", "_held")
    )
    games = cut_lineage(games)  # counted by measure, then read once more
    layout = measure(games, ["entity_id"], max_rows=max_rows)
    before = lookback(games, layout, n, lambda f: {f"_held_{k}": F.lag("_held", k).over(f.ordered) for k in range(1, n + 1)})
    past = F.flatten(F.filter(F.array(*[f"_held_{k}" for k in range(1, n + 1)]), lambda x: x.isNotNull()))
    rows = before.select("entity_id", "match_id", past.alias("_past"))

    def usual(slot: Column) -> Column:
        mine = F.transform(F.filter("_past", lambda x: x["slot"].eqNullSafe(slot)), lambda x: x["member_id"])
        ranked = F.transform(
            F.array_distinct(mine), lambda m: F.struct((-F.size(F.filter(mine, lambda x: x.eqNullSafe(m)))).alias("n"), m.alias("member_id"))
        )
        return F.array_min(ranked)["member_id"]

    slots = F.array_distinct(F.transform("_past", lambda x: x["slot"]))
    chosen = F.transform(slots, lambda slot: F.struct(slot.alias("slot"), usual(slot).alias("expected_member")))
    return rows.select("entity_id", "match_id", F.explode(chosen).alias("_c")).select("entity_id", "match_id", "_c.*")


def top_members(appearances: DataFrame, n: int = 17) -> DataFrame:
    """The ``n`` most used starters of each participant and season, ties by member id."""
    used = appearances.filter("is_starter").groupBy("entity_id", "year", "member_id").agg(
        F.count(F.lit(1)).alias("starts")
    )
    w = Window.partitionBy("entity_id", "year").orderBy(F.desc("starts"), "member_id")
    return used.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def roster_continuity(appearances: DataFrame, n: int = 17, first_round: int = 1) -> DataFrame:
    """Share of last season's core (and of its key members) in this season's first-round squad.

    Written with joins on (participant, season, member) instead of collected squads; the core has
    at most ``n`` members per participant and season.
    """
    core = top_members(appearances, n).select("entity_id", "member_id", (F.col("year") + 1).alias("year"))
    spine = appearances.filter("is_spine").groupBy(
        "entity_id", (F.col("year") + 1).alias("year"), "member_id"
    ).agg(F.lit(1).alias("_spine"))
    opening = appearances.filter(F.col("is_starter") & (F.col("round") == first_round))
    squad = opening.groupBy("entity_id", "year", "member_id").agg(F.lit(1).alias("_back"))
    has_squad = squad.select("entity_id", "year", F.lit(1).alias("_squad")).distinct()
    keys = ["entity_id", "year", "member_id"]
    shares = (
        core.join(spine, keys, "left")
        .join(squad, keys, "left")
        .groupBy("entity_id", "year")
        .agg(
            F.count(F.lit(1)).alias("_core"),
            F.count("_back").alias("_kept"),
            F.count("_spine").alias("_key"),
            F.count(F.when(F.col("_back").isNotNull(), F.col("_spine"))).alias("_key_kept"),
        )
        .join(has_squad, ["entity_id", "year"])
    )
    roster = F.col("_kept") / F.col("_core")
    return shares.select(
        "entity_id",
        "year",
        roster.alias("roster_continuity"),
        F.when(F.col("_key") > 0, F.col("_key_kept") / F.col("_key")).otherwise(roster).alias("spine_continuity"),
    )


def with_without(
    appearances: DataFrame,
    log: DataFrame,
    min_starts: int = 10,
    min_absences: int = 3,
    window_from: int | None = None,
    window_to: int | None = None,
    full_group: float = 15.0,
    full_total: float = 40.0,
) -> DataFrame:
    """Effect of a member's presence on a participant: mean residual with minus mean without.

    ``log`` has ``match_id, entity_id, year, result, expected, margin`` for scored games. The games
    without a member are never listed: their sums are the participant's totals minus the sums of
    the games with the member. The member-by-game expansion therefore does not exist, and both
    inputs are aggregated once.
    """
    games = log.filter(F.col("result").isNotNull())
    if window_from is not None:
        games = games.filter(F.col("year") >= window_from)
    if window_to is not None:
        games = games.filter(F.col("year") <= window_to)
    games = games.select(
        "match_id", "entity_id", (F.col("result") - F.col("expected")).alias("residual"), "margin", "result"
    )
    sums = ("residual", "margin", "result")
    totals = games.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"t_{s}") for s in sums]
    )
    starts = appearances.filter("is_starter").select("match_id", "entity_id", "member_id").distinct()
    played = starts.join(games, ["match_id", "entity_id"]).groupBy("member_id", "entity_id").agg(
        F.count(F.lit(1)).alias("games_started"), *[F.sum(s).alias(f"w_{s}") for s in sums]
    )
    df = played.join(totals, "entity_id").withColumn("games_missed", F.col("n") - F.col("games_started"))
    df = df.filter((F.col("games_started") >= min_starts) & (F.col("games_missed") >= min_absences))

    def mean_with(s: str) -> Column:
        return F.col(f"w_{s}") / F.col("games_started")

    def mean_without(s: str) -> Column:
        return (F.col(f"t_{s}") - F.col(f"w_{s}")) / F.col("games_missed")

    group = F.least("games_started", "games_missed")
    confidence = F.least(F.lit(1.0), group / F.lit(full_group)) * F.least(F.lit(1.0), F.col("n") / F.lit(full_total))
    impact = mean_with("residual") - mean_without("residual")
    return df.select(
        "member_id",
        "entity_id",
        "games_started",
        "games_missed",
        impact.alias("elo_adj_impact"),
        (mean_with("margin") - mean_without("margin")).alias("margin_impact"),
        confidence.alias("confidence"),
        (impact * confidence).alias("weighted_impact"),
        mean_with("result").alias("win_rate_with"),
        mean_without("result").alias("win_rate_without"),
    )


def with_without_by_season(
    appearances: DataFrame,
    log: DataFrame,
    window: int = 3,
    thresholds: Sequence[tuple[int, int]] = ((10, 3),),
) -> DataFrame:
    """The same effect for every target season from the ``window`` seasons before it only.

    Season sums are sent to the (at most ``window``) target seasons they serve; the participant's
    totals meet the member's sums on (participant, target season). Threshold pairs are an exploded
    literal, evaluated after the aggregates.
    """
    games = log.filter(F.col("result").isNotNull()).select(
        "match_id", "entity_id", "year", (F.col("result") - F.col("expected")).alias("residual"), "margin"
    )
    last = games.agg(F.max("year").alias("y")).select("y").scalar()
    serves = F.explode(F.sequence(F.col("year") + 1, F.col("year") + window)).alias("target_year")

    def spread(df: DataFrame, *keys: str) -> DataFrame:
        wide = df.select("*", serves).filter(F.col("target_year") <= last)
        return wide.groupBy(*keys, "target_year").agg(
            *[F.sum(c).alias(c) for c in ("games", "residual", "margin")]
        )

    one = [F.count(F.lit(1)).alias("games"), F.sum("residual").alias("residual"), F.sum("margin").alias("margin")]
    totals = spread(games.groupBy("entity_id", "year").agg(*one), "entity_id")
    starts = appearances.filter("is_starter").select("match_id", "entity_id", "member_id").distinct()
    own = starts.join(games, ["match_id", "entity_id"]).groupBy("entity_id", "member_id", "year").agg(*one)
    mine = spread(own, "entity_id", "member_id")
    both = mine.join(
        totals.select("entity_id", "target_year", *[F.col(c).alias(f"t_{c}") for c in ("games", "residual", "margin")]),
        ["entity_id", "target_year"],
    ).withColumn("missed", F.col("t_games") - F.col("games"))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(a).alias("min_starts"), F.lit(b).alias("min_absences")) for a, b in thresholds])
    )
    kept = both.select("*", pairs.alias("p")).filter(
        (F.col("games") >= F.col("p.min_starts")) & (F.col("missed") >= F.col("p.min_absences"))
        & (F.col("missed") > 0)
    )
    impact = F.col("residual") / F.col("games") - (F.col("t_residual") - F.col("residual")) / F.col("missed")
    confidence = F.least(F.lit(1.0), F.least("games", "missed") / F.lit(15.0)) * F.least(
        F.lit(1.0), F.col("t_games") / F.lit(40.0)
    )
    return kept.select(
        "entity_id",
        "member_id",
        "target_year",
        F.col("p.min_starts").alias("min_starts"),
        F.col("p.min_absences").alias("min_absences"),
        F.col("games").alias("games_started"),
        F.col("missed").alias("games_missed"),
        (impact * confidence).alias("weighted_impact"),
    )


def lineup_changes(expected: DataFrame, appearances: DataFrame, last_slot: int = 13) -> DataFrame:
    """Slots whose expected holder is missing or replaced (compared by surname), for the sides whose
    line-up is known."""
    side = ["match_id", "entity_id"]
    current = appearances.filter(F.col("is_starter")).groupBy(*side).agg(F.collect_list(F.struct("slot", F.col("member_name").alias("actual"))).alias("_now"))

    def surname(c: str) -> Column:
        return F.lower(F.element_at(F.split(c, " "), -1))

    holders = F.transform(F.filter("_now", lambda x: x["slot"] == F.col("slot")), lambda x: x["actual"])
    diff = expected.filter(F.col("slot") <= last_slot).join(current, side).withColumn("actual", F.explode_outer(holders))
    return (
        diff.filter(F.col("actual").isNull() | (surname("actual") != surname("expected")))
        .withColumn("change_type", F.when(F.col("actual").isNull(), "MISSING").otherwise("REPLACED"))
        .select("match_id", "entity_id", "slot", "expected", "actual", "change_type")
    )


def appearance_rows(arrays: DataFrame, keys: Sequence[str], bench_from: int = 14) -> DataFrame:
    """Line-up and bench arrays as rows: the array position is the slot, the bench starts after the starters."""

    def listed(names: str, first: int, starts: bool) -> Column:
        row = lambda x, at: F.struct(x.alias("member_name"), (at + first).alias("slot"), F.lit(starts).alias("is_starter"))
        return F.transform(F.coalesce(names, F.array()), row)

    # one pass over the arrays, which may be costly to make
    return arrays.select(*keys, F.inline(F.concat(listed("lineup", 1, True), listed("bench", bench_from, False))))
