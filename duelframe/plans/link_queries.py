"""Joins (JN), names and orientation (part of NRM) with their SQL checks."""

from __future__ import annotations

import datetime

from pyspark.sql import Window, functions as F

from duelframe.functions.numbers import haversine_km
from duelframe.functions.text import folded, last_token, round_sort_key
from duelframe.operators import decisions as D, entity as E, groups as G, link as L, tables as T, windows as W
from duelframe.plans.common import log, member_games, stats_log
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.plans.windows_queries import importances, pick_rounds, picks, wide_sql
from duelframe.sources import adapters as A

MATCH = ["match_id", "event_date", "home_id", "away_id"]
PRICES = ["h2h_home_open", "h2h_away_open"]

define("feed_one", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY odds_date, home_id, away_id ORDER BY odds_id) AS k FROM odds_feed) WHERE k = 1")


@query(
    "jn01_exact_link",
    """
SELECT m.match_id, m.event_date, m.home_id, m.away_id, f.odds_id, f.h2h_home_open, f.h2h_away_open, f.odds_id IS NOT NULL AS is_linked
FROM matches m LEFT JOIN feed_one f ON f.odds_date = m.event_date AND f.home_id = m.home_id AND f.away_id = m.away_id""",
    "h2h_home_open h2h_away_open",
)
def jn01(spark, sf):
    return L.exact_link(A.matches(spark, sf).select(*MATCH), A.odds_feed(spark, sf), PRICES)


define(
    "nearest",
    """
SELECT match_id, event_date, home_id, away_id, odds_id, odds_date, h2h_home_open, h2h_away_open, gap AS link_gap
FROM (SELECT m.match_id, m.event_date, m.home_id, m.away_id, f.odds_id, f.odds_date, f.h2h_home_open, f.h2h_away_open,
             CAST(f.odds_date - m.event_date AS INTEGER) AS gap,
             row_number() OVER (PARTITION BY m.match_id ORDER BY abs(f.odds_date - m.event_date), f.odds_date, f.odds_id) AS k
      FROM matches m LEFT JOIN odds_feed f ON f.home_id = m.home_id AND f.away_id = m.away_id
           AND f.odds_date BETWEEN m.event_date - 2 AND m.event_date + 2) WHERE k = 1""",
)


@query("jn02_nearest_date", "SELECT * FROM nearest", "h2h_home_open h2h_away_open")
def jn02(spark, sf):
    return L.nearest_link(A.matches(spark, sf).select(*MATCH), A.odds_feed(spark, sf), PRICES)


define(
    "ladder",
    """
SELECT *, CAST(row_number() OVER (PARTITION BY year, round ORDER BY competition_points DESC, points_for - points_against DESC,
                                  points_for DESC, entity_id) AS INTEGER) AS position,
       points_for - points_against AS points_diff
FROM (SELECT year, round, entity_id, """
    + ", ".join(
        f"CAST(sum({e}) OVER (PARTITION BY year, entity_id ORDER BY round) AS BIGINT) AS {n}"
        for n, e in (
            ("played", "p"), ("won", "w"), ("drawn", "d"), ("lost", "l"), ("points_for", "pf"), ("points_against", "pa"),
            ("competition_points", "2 * w + d"), ("home_played", "hp"), ("home_won", "hw"), ("home_lost", "hl"),
            ("home_for", "hf"), ("home_against", "ha"), ("away_played", "ap"), ("away_won", "aw"), ("away_lost", "al"),
            ("away_for", "af"), ("away_against", "aa"),
        )
    )
    + """
      FROM (SELECT year, round, entity_id, count(margin) AS p, count(*) FILTER (WHERE margin > 0) AS w,
                   count(*) FILTER (WHERE margin = 0) AS d, count(*) FILTER (WHERE margin < 0) AS l,
                   coalesce(sum(points_for), 0) AS pf, coalesce(sum(points_against), 0) AS pa,
                   count(margin) FILTER (WHERE side = 'home') AS hp, count(*) FILTER (WHERE side = 'home' AND margin > 0) AS hw,
                   count(*) FILTER (WHERE side = 'home' AND margin < 0) AS hl,
                   coalesce(sum(points_for) FILTER (WHERE side = 'home'), 0) AS hf, coalesce(sum(points_against) FILTER (WHERE side = 'home'), 0) AS ha,
                   count(margin) FILTER (WHERE side = 'away') AS ap, count(*) FILTER (WHERE side = 'away' AND margin > 0) AS aw,
                   count(*) FILTER (WHERE side = 'away' AND margin < 0) AS al,
                   coalesce(sum(points_for) FILTER (WHERE side = 'away'), 0) AS af, coalesce(sum(points_against) FILTER (WHERE side = 'away'), 0) AS aa
            FROM log GROUP BY 1, 2, 3))""",
)
LADDER_VALUES = ["position", "won", "lost", "points_for", "points_against", "points_diff", "competition_points"]


def _ladder_side(side: str, a: str) -> str:
    return (
        ", ".join(f"{a}.{v} AS {side}_{v}" for v in LADDER_VALUES)
        + f", {a}.home_won::DOUBLE / nullif({a}.home_won + {a}.home_lost, 0) AS {side}_home_win_pct"
        + f", {a}.away_won::DOUBLE / nullif({a}.away_won + {a}.away_lost, 0) AS {side}_away_win_pct"
        + f", {a}.home_for::DOUBLE / nullif({a}.home_played, 0) AS {side}_home_ppg"
        + f", {a}.away_for::DOUBLE / nullif({a}.away_played, 0) AS {side}_away_ppg"
        + f", {a}.home_against::DOUBLE / nullif({a}.home_played, 0) AS {side}_home_pag"
        + f", {a}.away_against::DOUBLE / nullif({a}.away_played, 0) AS {side}_away_pag"
    )


LADDER_R6 = " ".join(f"{s}_{r}_{v}" for s in ("home", "away") for r in ("home", "away") for v in ("win_pct", "ppg", "pag"))
define(
    "ladder_lookup",
    f"""
SELECT m.match_id, {_ladder_side('home', 'h')}, {_ladder_side('away', 'a')}, h.position - a.position AS ladder_pos_diff
FROM matches m LEFT JOIN ladder h ON h.year = m.year AND h.round = TRY_CAST(m.round_label AS INTEGER) - 1 AND h.entity_id = m.home_id
               LEFT JOIN ladder a ON a.year = m.year AND a.round = TRY_CAST(m.round_label AS INTEGER) - 1 AND a.entity_id = m.away_id""",
)


@query("jn03_ladder_lookup", "SELECT * FROM ladder_lookup", LADDER_R6)
def jn03(spark, sf):
    m = A.matches(spark, sf).select("match_id", "year", "round_label", "home_id", "away_id")
    return T.ladder_features(m, T.ladders(log(spark, sf)))


define(
    "season_stats",
    """
SELECT year, entity_id, sum(runs) / count(runs)::DOUBLE AS avg_runs, sum(errors) / count(errors)::DOUBLE AS avg_errors,
       count(runs) AS games FROM stats_log GROUP BY 1, 2""",
)


@query(
    "jn04_prior_season",
    """
SELECT m.match_id, h.avg_runs AS home_avg_runs, h.avg_errors AS home_avg_errors, a.avg_runs AS away_avg_runs,
       a.avg_errors AS away_avg_errors, h.avg_runs - a.avg_runs AS avg_runs_diff
FROM matches m LEFT JOIN season_stats h ON h.year = m.year - 1 AND h.entity_id = m.home_id
               LEFT JOIN season_stats a ON a.year = m.year - 1 AND a.entity_id = m.away_id""",
    "home_avg_runs home_avg_errors away_avg_runs away_avg_errors avg_runs_diff",
)
def jn04(spark, sf):
    stats = L.shifted(T.season_stats(stats_log(spark, sf)), "year", 1)
    m = A.matches(spark, sf).select("match_id", "year", "home_id", "away_id")
    out = L.two_role_lookup(m, stats, ["avg_runs", "avg_errors"], ["year"])
    return out.withColumn("avg_runs_diff", F.col("home_avg_runs") - F.col("away_avg_runs")).drop("year", "home_id", "away_id")


define(
    "allowed",
    """
SELECT a.year, a.entity_id, avg(CASE WHEN slot = 1 THEN minutes END) AS allowed_spine, avg(CASE WHEN slot = 2 THEN minutes END) AS allowed_forward,
       avg(CASE WHEN slot >= 3 THEN minutes END) AS allowed_back, avg(minutes) AS allowed_total
FROM (SELECT g.year, CASE WHEN g.side = 'home' THEN m.away_id ELSE m.home_id END AS entity_id, g.slot, g.minutes
      FROM member_games g JOIN matches m USING (match_id)) a GROUP BY 1, 2""",
)


@query(
    "jn05_opponent_profile",
    """
SELECT m.match_id, a.allowed_spine AS home_opp_spine, a.allowed_forward AS home_opp_forward, a.allowed_back AS home_opp_back, a.allowed_total AS home_opp_total,
       h.allowed_spine AS away_opp_spine, h.allowed_forward AS away_opp_forward, h.allowed_back AS away_opp_back, h.allowed_total AS away_opp_total,
       a.allowed_total - h.allowed_total AS opp_total_diff
FROM matches m LEFT JOIN allowed h ON h.year = m.year - 1 AND h.entity_id = m.home_id
               LEFT JOIN allowed a ON a.year = m.year - 1 AND a.entity_id = m.away_id""",
    "home_opp_spine home_opp_forward home_opp_back home_opp_total away_opp_spine away_opp_forward away_opp_back away_opp_total opp_total_diff",
)
def jn05(spark, sf):
    m = A.matches(spark, sf).select("match_id", "year", "home_id", "away_id")
    profile = L.shifted(T.points_allowed(member_games(spark, sf), m), "year", 1)
    return T.opponent_profile(m, profile).drop("year", "home_id", "away_id")


@query(
    "jn06_inner_stats",
    """
SELECT l.match_id, l.side, l.entity_id, l.points_for, s.runs, s.metres, s.sets, s.errors FROM log l JOIN side_stats s USING (match_id, side)""",
)
def jn06(spark, sf):
    narrow = log(spark, sf).select("match_id", "side", "entity_id", "points_for")
    return narrow.join(A.side_stats(spark, sf), ["match_id", "side"], "inner")


define(
    "weather",
    """
SELECT l_orderkey AS match_id, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity - 10 END AS temperature_c,
       CASE WHEN l_partkey % 5 <> 0 THEN round(l_discount * 100) / 2 END AS precipitation_mm,
       CASE WHEN l_partkey % 7 <> 0 THEN round(l_tax * 100) * 6 END AS wind_speed_kmh,
       CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Good' WHEN l_returnflag = 'N' THEN 'Heavy'
            WHEN l_linestatus = 'F' THEN 'Fair' ELSE '' END AS ground_conditions
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
WHERE k = 1""",
)


@query(
    "jn07_first_row_lookup",
    "SELECT m.match_id, w.temperature_c + 0.0 AS temperature_c, w.precipitation_mm + 0.0 AS precipitation_mm, w.wind_speed_kmh + 0.0 AS wind_speed_kmh, w.ground_conditions FROM matches m LEFT JOIN weather w USING (match_id)",
)
def jn07(spark, sf):
    return A.matches(spark, sf).select("match_id").join(T.weather(spark, sf), "match_id", "left")


@query(
    "jn08_official_lookup",
    """
SELECT m.match_id, o.referee AS official FROM matches m
LEFT JOIN (SELECT o_orderkey AS match_id, substr(o_orderpriority, 3) AS referee FROM orders WHERE o_orderkey % 19 <> 0) o USING (match_id)""",
)
def jn08(spark, sf):
    officials = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.when(F.col("o_orderkey") % 19 != 0, F.substring("o_orderpriority", 3, 100)).otherwise("").alias("official"),
    )
    named = officials.filter(F.col("official") != "")
    return A.matches(spark, sf).select("match_id").join(named, "match_id", "left")


define(
    "pair_feed",
    """
SELECT *, least(home_id, away_id) AS pl, greatest(home_id, away_id) AS ph,
       row_number() OVER (PARTITION BY odds_date, least(home_id, away_id), greatest(home_id, away_id) ORDER BY odds_id) AS k FROM odds_feed""",
)


@query(
    "jn09_either_orientation",
    """
SELECT m.match_id, m.event_date, m.home_id, m.away_id, f.home_id <> m.home_id AS flipped,
       CASE WHEN f.home_id <> m.home_id THEN f.h2h_away_open ELSE f.h2h_home_open END AS h2h_home_open,
       CASE WHEN f.home_id <> m.home_id THEN f.h2h_home_open ELSE f.h2h_away_open END AS h2h_away_open
FROM matches m LEFT JOIN (SELECT * FROM pair_feed WHERE k = 1) f
  ON f.odds_date = m.event_date AND f.pl = least(m.home_id, m.away_id) AND f.ph = greatest(m.home_id, m.away_id)""",
    "h2h_home_open h2h_away_open",
)
def jn09(spark, sf):
    feed = A.odds_feed(spark, sf).withColumnRenamed("odds_date", "event_date")
    return E.match_either_way(
        A.matches(spark, sf).select(*MATCH), feed, ["event_date"], [("h2h_home_open", "h2h_away_open")], ["odds_id"]
    )


@query(
    "jn10_base_probability",
    """
SELECT m.match_id, m.year, m.home_id, m.away_id,
       CASE WHEN f.home_id <> m.home_id THEN f.h2h_home_open ELSE f.h2h_away_open END / (f.h2h_home_open + f.h2h_away_open) AS base_prob
FROM matches m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY year(odds_date), pl, ph ORDER BY odds_date, odds_id) AS first FROM pair_feed) f
  ON f.first = 1 AND year(f.odds_date) = m.year AND f.pl = least(m.home_id, m.away_id) AND f.ph = greatest(m.home_id, m.away_id)""",
    "base_prob",
)
def jn10(spark, sf):
    feed = A.odds_feed(spark, sf).withColumn("year", F.year("odds_date"))
    m = A.matches(spark, sf).select("match_id", "year", "home_id", "away_id")
    linked = E.match_either_way(m, feed, ["year"], [("h2h_home_open", "h2h_away_open")], ["odds_date", "odds_id"])
    inverse = {s: F.try_divide(F.lit(1.0), F.col(f"h2h_{s}_open")) for s in ("home", "away")}
    return linked.withColumn("base_prob", inverse["home"] / (inverse["home"] + inverse["away"])).select(
        *m.columns, "base_prob"
    )


CUTOFF = datetime.date(2000, 1, 1)


@query(
    "jn11_missing_decisions",
    """
SELECT match_id, event_date, home_id, away_id FROM matches m
WHERE event_date >= DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.match_id = m.match_id AND q.quoted_at < TIMESTAMP '2000-01-01')""",
)
def jn11(spark, sf):
    decided = A.quotes(spark, sf).filter(F.col("quoted_at") < F.lit(CUTOFF).cast("timestamp"))
    return D.missing_decisions(A.matches(spark, sf).select(*MATCH), decided, "match_id", "event_date", F.lit(CUTOFF))


@query(
    "jn12_starting_soon",
    "SELECT event_id, ts, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:30:00' AND TIMESTAMP '2024-01-10 13:30:00'",
)
def jn12(spark, sf):
    events = A.table(spark, sf, "events").select("event_id", "ts", "user_id")
    return D.starting_soon(events, "ts", F.lit(datetime.datetime(2024, 1, 10, 12)), 30, 90)


define(
    "slot_diff",
    """
SELECT e.match_id, e.entity_id, e.slot, 'P' || CAST(e.expected_member % 30 AS VARCHAR) || ' S' || CAST(e.expected_member AS VARCHAR) AS expected,
       c.member_name AS actual, CASE WHEN c.member_name IS NULL THEN 'MISSING' ELSE 'REPLACED' END AS change_type
FROM expected_slots e LEFT JOIN (SELECT * FROM appearances WHERE is_starter) c
  ON c.match_id = e.match_id AND c.entity_id = e.entity_id AND c.slot = e.slot
WHERE c.member_id IS DISTINCT FROM e.expected_member
  AND EXISTS (SELECT 1 FROM appearances x WHERE x.match_id = e.match_id AND x.entity_id = e.entity_id AND x.is_starter)""",
)


def slot_diff(spark, sf):
    apps = A.appearances(spark, sf)
    expected = G.expected_starters(apps).withColumn(
        "expected",
        F.concat(F.lit("P"), (F.col("expected_member") % 30).cast("string"), F.lit(" S"), F.col("expected_member").cast("string")),
    )
    return G.lineup_changes(expected, apps)


@query("jn13_lineup_changes", "SELECT * FROM slot_diff")
def jn13(spark, sf):
    return slot_diff(spark, sf)


define(
    "impact_list",
    """
SELECT entity_id, CASE WHEN member_id % 3 = 0 THEN 'Q Mc' || 'S' || CAST(member_id AS VARCHAR) ELSE member_name END AS member_name,
       (member_id % 17 - 8) / 40.0::DOUBLE AS impact, member_id AS listed_at
FROM (SELECT DISTINCT entity_id, member_id, member_name FROM appearances WHERE member_id % 5 <> 0)""",
)


def members(spark, sf):
    """Every member of every participant, once."""
    return A.appearances(spark, sf).select("entity_id", "member_id", "member_name").distinct()


def impact_list(spark, sf, known=None):
    listed = (members(spark, sf) if known is None else known).filter(F.col("member_id") % 5 != 0)
    return listed.select(
        "entity_id",
        F.when(F.col("member_id") % 3 == 0, F.concat(F.lit("Q McS"), F.col("member_id").cast("string")))
        .otherwise(F.col("member_name"))
        .alias("member_name"),
        ((F.col("member_id") % 17 - 8) / F.lit(40.0)).alias("impact"),
        F.col("member_id").alias("listed_at"),
    )


define(
    "wanted_impact",
    """
SELECT w.entity_id, w.member_name, coalesce(x.impact, n.impact, 0.0::DOUBLE) AS impact
FROM (SELECT DISTINCT entity_id, member_name FROM appearances) w
LEFT JOIN impact_list x ON x.entity_id = w.entity_id AND x.member_name = w.member_name
LEFT JOIN (SELECT w2.entity_id, w2.member_name, arg_min(i.impact, i.listed_at) AS impact
           FROM (SELECT DISTINCT entity_id, member_name FROM appearances) w2
           JOIN impact_list i ON i.entity_id = w2.entity_id AND ends_with(lower(i.member_name), lower(split_part(w2.member_name, ' ', 2)))
           GROUP BY 1, 2) n ON n.entity_id = w.entity_id AND n.member_name = w.member_name""",
)


@query("jn14_impact_fallback", "SELECT * FROM wanted_impact", "impact")
def jn14(spark, sf):
    wanted = A.appearances(spark, sf).select("entity_id", "member_name").distinct()
    return E.impact_with_fallback(wanted, impact_list(spark, sf))


# places by rule: one per nation number, on a fixed grid
PLACES = {f"NATION_{i}": (-45.0 + i * 3.0, 100.0 + i * 4.0) for i in range(25)}
define("places", "SELECT 'NATION_' || i AS place, -45.0::DOUBLE + i * 3.0::DOUBLE AS lat, 100.0::DOUBLE + i * 4.0::DOUBLE AS lon FROM range(25) t(i)")
define(
    "grounds",
    """
SELECT DISTINCT venue_id, home_id % 30 AS spot, CASE venue_id % 4 WHEN 0 THEN 'NATION_' || home_id WHEN 1 THEN 'nation ' || home_id
       WHEN 2 THEN 'Park of NATION-' || home_id || ' (north)' ELSE CASE WHEN venue_id % 8 = 3 THEN 'elsewhere' ELSE 'Nation_' || home_id || ' Oval' END END AS ground
FROM matches""",
)
define(
    "ground_place",
    """
SELECT ground, lat, lon FROM (
  SELECT g.ground, p.lat, p.lon, row_number() OVER (PARTITION BY g.ground ORDER BY
         CASE WHEN p.place = g.ground THEN 0 WHEN regexp_replace(lower(p.place), '[^a-z0-9]', '', 'g') = regexp_replace(lower(g.ground), '[^a-z0-9]', '', 'g') THEN 1 ELSE 2 END,
         length(p.place) DESC, p.place) AS k
  FROM (SELECT DISTINCT ground FROM grounds) g LEFT JOIN places p
    ON contains(regexp_replace(lower(p.place), '[^a-z0-9]', '', 'g'), regexp_replace(lower(g.ground), '[^a-z0-9]', '', 'g'))
    OR contains(regexp_replace(lower(g.ground), '[^a-z0-9]', '', 'g'), regexp_replace(lower(p.place), '[^a-z0-9]', '', 'g'))) WHERE k = 1""",
)


def ground_name():
    home = F.col("home_id").cast("string")
    kind = F.col("venue_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("NATION_"), home))
        .when(kind == 1, F.concat(F.lit("nation "), home))
        .when(kind == 2, F.concat(F.lit("Park of NATION-"), home, F.lit(" (north)")))
        .when(F.col("venue_id") % 8 == 3, "elsewhere")
        .otherwise(F.concat(F.lit("Nation_"), home, F.lit(" Oval")))
    )


@query("jn15_fuzzy_place", "SELECT * FROM ground_place", "lat lon")
def jn15(spark, sf):
    names = A.matches(spark, sf).select(ground_name().alias("ground")).distinct()
    found = names.withColumn("_p", E.fuzzy_lookup("ground", PLACES))
    return found.select("ground", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))


@query(
    "jn16_mark",
    """
SELECT match_id, side, entity_id, EXISTS (SELECT 1 FROM appearances a WHERE a.match_id = log.match_id AND a.side = log.side AND a.is_spine) AS has_spine FROM log""",
)
def jn16(spark, sf):
    keys = A.appearances(spark, sf).filter("is_spine")
    return L.mark(log(spark, sf).select("match_id", "side", "entity_id"), keys, ["match_id", "side"], "has_spine")


@query(
    "jn17_games_with_and_without",
    """
SELECT t.entity_id, p.member_id, coalesce(s.n, 0) AS games_started, t.n - coalesce(s.n, 0) AS games_missed
FROM (SELECT DISTINCT entity_id, member_id FROM appearances WHERE is_starter) p
JOIN (SELECT entity_id, count(*) AS n FROM log WHERE margin IS NOT NULL GROUP BY 1) t USING (entity_id)
JOIN (SELECT a.entity_id, a.member_id, count(*) AS n FROM appearances a JOIN log l USING (match_id, entity_id)
           WHERE a.is_starter AND l.margin IS NOT NULL GROUP BY 1, 2) s
  ON s.entity_id = p.entity_id AND s.member_id = p.member_id""",
)
def jn17(spark, sf):
    games = log(spark, sf).withColumn("expected", F.lit(0.5))
    both = G.with_without(A.appearances(spark, sf), games, 0, 0)
    return both.select("entity_id", "member_id", "games_started", "games_missed")


@query(
    "jn18_parameter_grid",
    """
SELECT w AS step, sum(CAST((w * 0.05::DOUBLE * model_prob + (1 - w * 0.05::DOUBLE) * odds_prob >= 0.5) = (home_win = 1) AS INTEGER))::BIGINT AS correct, count(*) AS games
FROM picks CROSS JOIN range(0, 21) g(w) GROUP BY w""",
)
def jn18(spark, sf):
    return D.weight_grid(picks(spark, sf), 20)


@query(
    "jn19_side_by_side",
    """
SELECT a.year, feature, a.importance AS importance_a, b.importance AS importance_b, b.importance - a.importance AS importance_delta,
       CASE WHEN b.importance - a.importance < -0.0005 THEN 'better' WHEN b.importance - a.importance > 0.0005 THEN 'worse' ELSE 'same' END AS verdict
FROM importances a JOIN (SELECT year - 1 AS year, feature, importance FROM importances) b USING (year, feature)""",
    "importance_a importance_b importance_delta",
)
def jn19(spark, sf):
    """Every season beside the next one."""
    long = importances(spark, sf)
    return L.side_by_side(long, long.withColumn("year", F.col("year") - 1), ["year", "feature"], ["importance"])


@query(
    "jn20_decision_changes",
    """
SELECT match_id, open_prob AS old_prob, close_prob AS new_prob, (open_prob >= 0.5) <> (close_prob >= 0.5) AS is_flip,
       close_prob - open_prob AS shift
FROM predictions WHERE ((open_prob >= 0.5) <> (close_prob >= 0.5)) OR abs(close_prob - open_prob) > 0.05""",
    "old_prob new_prob shift",
)
def jn20(spark, sf):
    p = A.predictions(spark, sf)
    old = p.select("match_id", F.col("open_prob").alias("prob")).filter("prob is not null")
    new = p.select("match_id", F.col("close_prob").alias("prob")).filter("prob is not null")
    return D.decision_changes(old, new)


@query(
    "jn21_pair_attributes",
    """
SELECT m.match_id, x.meetings, x.last_day FROM matches m
LEFT JOIN (SELECT home_id, away_id, count(*) AS meetings, max(event_date) AS last_day FROM matches GROUP BY 1, 2) x USING (home_id, away_id)""",
)
def jn21(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "year", "home_id", "away_id")
    known = m.groupBy("home_id", "away_id").agg(
        F.count(F.lit(1)).alias("meetings"), F.max("event_date").alias("last_day")
    )
    return m.join(known, ["home_id", "away_id"], "left").select("match_id", "meetings", "last_day")


@query(
    "jn22_two_role_rounds",
    """
SELECT m.match_id, h.starter_load_3 AS home_starter_load_3, h.heavy_load_3 AS home_heavy_load_3,
       a.starter_load_3 AS away_starter_load_3, a.heavy_load_3 AS away_heavy_load_3
FROM matches m LEFT JOIN workload_roll h ON h.year = m.year AND h.round = m.round AND h.entity_id = m.home_id
               LEFT JOIN workload_roll a ON a.year = m.year AND a.round = m.round AND a.entity_id = m.away_id""",
    "home_starter_load_3 home_heavy_load_3 away_starter_load_3 away_heavy_load_3",
)
def jn22(spark, sf):
    rolled = W.rolling_workload(W.workload(member_games(spark, sf)))
    m = A.matches(spark, sf).select("match_id", "year", "round", "home_id", "away_id")
    out = L.two_role_lookup(m, rolled, ["starter_load_3", "heavy_load_3"], ["year", "round"])
    return out.drop("year", "round", "home_id", "away_id")


@query("jn23_period_merge", "SELECT match_id, is_period, period_round_number FROM matches JOIN period USING (year, round)")
def jn23(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "year", "round")
    return m.join(W.season_period(m), ["year", "round"], "left").select("match_id", "is_period", "period_round_number")


@query(
    "jn24_season_on_season",
    """
SELECT c.year, c.entity_id, c.avg_runs, p.avg_runs AS prior_avg_runs, c.avg_runs - p.avg_runs AS change
FROM season_stats c JOIN season_stats p ON p.entity_id = c.entity_id AND p.year = c.year - 1""",
    "avg_runs prior_avg_runs change",
)
def jn24(spark, sf):
    stats = T.season_stats(stats_log(spark, sf)).select("year", "entity_id", "avg_runs")
    prior = L.shifted(stats, "year", 1).withColumnRenamed("avg_runs", "prior_avg_runs")
    return stats.join(prior, ["year", "entity_id"]).withColumn("change", F.col("avg_runs") - F.col("prior_avg_runs"))


# ---- names and orientation -------------------------------------------------------------------


def aliases(spark, sf):
    """Three spellings of every nation."""
    n = A.table(spark, sf, "nation")
    spelled = F.explode(F.array("n_name", F.lower("n_name"), F.concat(F.lit("the "), F.col("n_name"))))
    return n.select(spelled.alias("alias"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("canonical"))


def named_matches(spark, sf):
    home, away = F.col("home_id").cast("string"), F.col("away_id").cast("string")
    return A.matches(spark, sf).select(
        "match_id",
        F.concat(F.lit(" NATION_"), home).alias("home_team"),
        F.when(F.col("match_id") % 3 == 0, F.concat(F.lit("The Nation_"), away)).otherwise(F.concat(F.lit("nation_"), away)).alias("away_team"),
    )


@query(
    "nrm01_canonical_strict",
    "SELECT match_id, 'Nation ' || home_id AS home_team, 'Nation ' || away_id AS away_team FROM matches",
)
def nrm01(spark, sf):
    return E.canonical_names(named_matches(spark, sf), ["home_team", "away_team"], aliases(spark, sf))


@query(
    "nrm02_canonical_lenient",
    """
SELECT match_id, 'Nation ' || home_id AS home_team, CASE WHEN match_id % 4 = 0 THEN 'Guest ' || away_id ELSE 'Nation ' || away_id END AS away_team FROM matches""",
)
def nrm02(spark, sf):
    names = named_matches(spark, sf).withColumn(
        "away_team",
        F.when(F.col("match_id") % 4 == 0, F.concat(F.lit(" Guest "), F.regexp_extract("away_team", r"(\d+)$", 1))).otherwise(F.col("away_team")),
    )
    return E.canonical_names(names, ["home_team", "away_team"], aliases(spark, sf), strict=False)


PAIRS = [("home_id", "away_id"), ("home_score", "away_score"), ("halftime_home", "halftime_away"), ("penalty_home", "penalty_away")]
# the owner of a venue has most home games there; ties go to the smallest id
define("owners", "SELECT venue_id, arg_min(home_id, (-n, home_id)) AS owner_id FROM (SELECT venue_id, home_id, count(*) AS n FROM matches GROUP BY 1, 2) GROUP BY 1")


@query(
    "nrm03_orientation_by_owner",
    """
SELECT match_id, venue_id, swap AS was_swapped, CASE WHEN swap THEN away_id ELSE home_id END AS home_id, CASE WHEN swap THEN home_id ELSE away_id END AS away_id,
       CASE WHEN swap THEN away_score ELSE home_score END AS home_score, CASE WHEN swap THEN home_score ELSE away_score END AS away_score,
       CASE WHEN swap THEN halftime_away ELSE halftime_home END AS halftime_home, CASE WHEN swap THEN halftime_home ELSE halftime_away END AS halftime_away,
       CASE WHEN swap THEN penalty_away ELSE penalty_home END AS penalty_home, CASE WHEN swap THEN penalty_home ELSE penalty_away END AS penalty_away
FROM (SELECT m.*, coalesce(o.owner_id = m.away_id, false) AS swap FROM matches m LEFT JOIN owners o USING (venue_id))""",
)
def nrm03(spark, sf):
    m = A.matches(spark, sf)
    owners = E.venue_owners(m)
    return E.orient_by_owner(m.select("match_id", "venue_id", *[c for p in PAIRS for c in p]), owners, PAIRS)


@query(
    "nrm04_orientation_in_feed",
    """
SELECT match_id, event_date, home_id, away_id, coalesce(o, 'unmatched') AS orientation
FROM (SELECT m.match_id, m.event_date, m.home_id, m.away_id,
             arg_min(CASE WHEN f.home_id = m.home_id THEN 'direct' WHEN f.home_id IS NOT NULL THEN 'swapped' END,
                     CASE CAST(f.odds_date - m.event_date AS INTEGER) WHEN 0 THEN 0 WHEN -2 THEN 2 WHEN -1 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 8 END
                     + CASE WHEN f.home_id = m.home_id THEN 0 ELSE 1 END) AS o
      FROM matches m LEFT JOIN odds_feed f ON least(f.home_id, f.away_id) = least(m.home_id, m.away_id)
           AND greatest(f.home_id, f.away_id) = greatest(m.home_id, m.away_id) AND f.odds_date BETWEEN m.event_date - 2 AND m.event_date + 2
      GROUP BY ALL)""",
)
def nrm04(spark, sf):
    return L.orientation_in_feed(A.matches(spark, sf).select(*MATCH), A.odds_feed(spark, sf))


@query("nrm05_header_rename", "SELECT o_orderkey AS match_id, o_custkey AS member_id, o_orderpriority AS referee FROM orders")
def nrm05(spark, sf):
    raw = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").toDF(" O_OrderKey", "o_custkey ", "O_ORDERPRIORITY")
    return E.renamed_headers(raw, {"o_orderkey": "match_id", "o_custkey": "member_id", "o_orderpriority": "referee"})


# "prelim" contains "elim", which is tried first: preliminary rounds sort with the elimination rounds
@query(
    "nrm06_round_sort_key",
    """
SELECT match_id, round_label, CASE round_label WHEN 'Qualif Final' THEN 100 WHEN 'Semi Final' THEN 102 WHEN 'Prelim Final' THEN 101
       WHEN 'Grand Final' THEN 104 ELSE TRY_CAST(round_label AS INTEGER) END AS round_sort FROM matches""",
)
def nrm06(spark, sf):
    return A.matches(spark, sf).select("match_id", "round_label", round_sort_key("round_label").alias("round_sort"))
