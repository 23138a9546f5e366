"""Look-back window queries (WN) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from duelframe.operators import groups as G, windows as W
from duelframe.operators.history import measure
from duelframe.operators.sides import from_sides, team_log
from duelframe.plans.common import log, member_games, per_entity, stats_log
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.sources import adapters as A

FORM = [f"{s}_{n}" for n in (3, 5, 8) for s in ("win_rate", "avg_pf", "avg_pa", "avg_margin")]
FORM_DIFFS = {f"win_rate_diff_{n}": f"win_rate_{n}" for n in (3, 5, 8)} | {
    f"avg_margin_diff_{n}": f"avg_margin_{n}" for n in (3, 5, 8)
}


def wide_sql(view: str, values: list[str], differences: dict[str, str] | None = None) -> str:
    """SQL text of the pivot back to one row per match."""
    cols = [f"max(CASE WHEN side = '{s}' THEN {v} END) AS {s}_{v}" for s in ("home", "away") for v in values]
    inner = f"SELECT match_id, {', '.join(cols)} FROM {view} GROUP BY match_id"
    if not differences:
        return inner
    diffs = ", ".join(f"home_{v} - away_{v} AS {n}" for n, v in differences.items())
    return f"SELECT *, {diffs} FROM ({inner})"


def names(values: list[str], differences: dict[str, str] | None = None) -> str:
    return " ".join([f"{s}_{v}" for s in ("home", "away") for v in values] + list(differences or {}))


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY entity_id ORDER BY event_date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


define(
    "form",
    "SELECT match_id, event_date, year, round, side, entity_id, opponent_id, "
    + ", ".join(
        f"avg(result) {_frame(n)} AS win_rate_{n}, avg(points_for) {_frame(n)} AS avg_pf_{n}, "
        f"avg(points_against) {_frame(n)} AS avg_pa_{n}, avg(margin) {_frame(n)} AS avg_margin_{n}"
        for n in (3, 5, 8)
    )
    + f", avg(halftime_lead) {_frame(5)} AS avg_halftime_lead_5, avg(penalty_diff) {_frame(5)} AS avg_penalty_diff_5,"
    " lag(result) OVER (PARTITION BY entity_id ORDER BY event_date, match_id) AS last_result FROM log",
)
# run lengths by gaps and islands over the scored games, then carried to the next game by position
define(
    "streaks",
    """
SELECT g.match_id, g.side, CAST(CASE WHEN r.len IS NULL THEN 0 WHEN r.result = 1 THEN r.len ELSE -r.len END AS INTEGER) AS streak
FROM (SELECT *, count(result) OVER (PARTITION BY entity_id ORDER BY event_date, match_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM log) g
LEFT JOIN (
  SELECT entity_id, result, n, row_number() OVER (PARTITION BY entity_id, isle, result ORDER BY n) AS len
  FROM (SELECT entity_id, result, n, n - row_number() OVER (PARTITION BY entity_id, result ORDER BY n) AS isle
        FROM (SELECT entity_id, result, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, match_id) AS n
              FROM log WHERE result IS NOT NULL))) r
  ON r.entity_id = g.entity_id AND r.n = g.pos""",
)


@query("wn01_rolling_form", wide_sql("form", FORM, FORM_DIFFS), names(FORM, FORM_DIFFS))
def wn01(spark, sf):
    df = log(spark, sf)
    return from_sides(W.rolling_form(df, per_entity(df)), FORM, differences=FORM_DIFFS)


_SIDE = ["avg_halftime_lead_5", "avg_penalty_diff_5"]


@query("wn02_rolling_skip_missing", wide_sql("form", _SIDE), names(_SIDE))
def wn02(spark, sf):
    df = log(spark, sf)
    return from_sides(W.rolling_form(df, per_entity(df)), _SIDE)


@query("wn03_last_result", wide_sql("form", ["last_result"]), names(["last_result"]))
def wn03(spark, sf):
    df = log(spark, sf)
    return from_sides(W.rolling_form(df, per_entity(df)), ["last_result"])


@query("wn04_streak", wide_sql("streaks", ["streak"], {"streak_diff": "streak"}))
def wn04(spark, sf):
    df = log(spark, sf).select("match_id", "event_date", "side", "entity_id", "result")
    return from_sides(W.streak(df, per_entity(df)), ["streak"], differences={"streak_diff": "streak"})


_H2H_R6 = "h2h_home_win_rate_3 h2h_avg_margin_3 h2h_home_win_rate_5 h2h_avg_margin_5 h2h_home_win_rate_all h2h_avg_margin_all"
define(
    "h2h",
    """
SELECT match_id, CASE WHEN sgn = 1 THEN 1 ELSE 0 END AS low_home, """
    + ", ".join(
        f"CASE WHEN sgn = 1 THEN list_avg(w{n}) ELSE 1 - list_avg(w{n}) END AS h2h_home_win_rate_{n}, "
        f"sgn * list_avg(m{n}) AS h2h_avg_margin_{n}, CAST(len(m{n}) AS BIGINT) AS h2h_matches_{n}"
        for n in (3, 5, "all")
    )
    + """
FROM (SELECT match_id, sgn, ms AS mall, ws AS wall, ms[-3:] AS m3, ws[-3:] AS w3, ms[-5:] AS m5, ws[-5:] AS w5
      FROM (SELECT match_id, sgn, coalesce(list(mm) FILTER (WHERE mm IS NOT NULL) OVER w, []) AS ms,
                   coalesce(list(ww) FILTER (WHERE mm IS NOT NULL) OVER w, []) AS ws
            FROM (SELECT *, CASE WHEN mm > 0 THEN 1.0::DOUBLE WHEN mm = 0 THEN 0.5::DOUBLE WHEN mm < 0 THEN 0.0::DOUBLE END AS ww
                  FROM (SELECT match_id, event_date, least(home_id, away_id) AS a, greatest(home_id, away_id) AS b,
                               CASE WHEN home_id < away_id THEN 1 ELSE -1 END AS sgn,
                               CASE WHEN home_id < away_id THEN home_score - away_score ELSE away_score - home_score END AS mm
                        FROM matches))
            WINDOW w AS (PARTITION BY a, b ORDER BY event_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
)


@query("wn05_head_to_head", "SELECT * EXCLUDE (low_home) FROM h2h", _H2H_R6)
def wn05(spark, sf):
    pairs = W.paired_events(A.matches(spark, sf))
    return W.head_to_head(pairs, measure(pairs, ["low_id", "high_id"]))


_B = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
define(
    "venue_record",
    f"""
SELECT match_id, side, sum(CASE WHEN margin > 0 THEN 1.0 WHEN margin IS NOT NULL THEN 0.0 END) OVER w
       / nullif(count(margin) OVER w, 0)::DOUBLE AS venue_win_rate
FROM log WINDOW w AS (PARTITION BY entity_id, venue_id ORDER BY event_date, match_id {_B})""",
)
define(
    "venue_total",
    f"""
SELECT match_id, avg(home_score + away_score) OVER (PARTITION BY venue_id ORDER BY event_date, match_id {_B})
       AS venue_avg_total_score FROM matches""",
)


@query(
    "wn06_venue_record",
    f"SELECT * FROM ({wide_sql('venue_record', ['venue_win_rate'])}) JOIN venue_total USING (match_id)",
    "home_venue_win_rate away_venue_win_rate venue_avg_total_score",
)
def wn06(spark, sf):
    df = log(spark, sf)
    wide = from_sides(W.venue_record(df, measure(df, ["entity_id", "venue_id"])), ["venue_win_rate"])
    m = A.matches(spark, sf).select("match_id", "event_date", "venue_id", "home_score", "away_score")
    total = W.expanding_mean(
        m, measure(m, ["venue_id"]), F.col("home_score") + F.col("away_score"), "venue_avg_total_score"
    )
    return wide.join(total.select("match_id", "venue_avg_total_score"), "match_id")


define(
    "ground",
    f"""
SELECT m.match_id, CASE WHEN hn >= 3 THEN CAST(hv::DOUBLE / hn > 0.5 AS DOUBLE) END AS is_home_ground,
       CASE WHEN hn >= 3 AND an >= 3 AND hv::DOUBLE / hn < 0.3 AND av::DOUBLE / an < 0.3 THEN 1 ELSE 0 END AS is_neutral_venue
FROM matches m JOIN
 (SELECT match_id, max(CASE WHEN side = 'home' THEN n END) AS hn, max(CASE WHEN side = 'home' THEN v END) AS hv,
         max(CASE WHEN side = 'away' THEN n END) AS an, max(CASE WHEN side = 'away' THEN v END) AS av
  FROM (SELECT match_id, side, count(*) FILTER (WHERE side = 'home' AND margin IS NOT NULL) OVER s AS n,
               count(*) FILTER (WHERE side = 'home' AND margin IS NOT NULL) OVER sv AS v
        FROM log WINDOW s AS (PARTITION BY entity_id, year ORDER BY event_date, match_id {_B}),
                        sv AS (PARTITION BY entity_id, year, venue_id ORDER BY event_date, match_id {_B}))
  GROUP BY match_id) USING (match_id)""",
)


@query("wn07_home_ground", "SELECT * FROM ground")
def wn07(spark, sf):
    df = log(spark, sf).select("match_id", "event_date", "year", "venue_id", "side", "entity_id", "margin")
    shares = W.home_ground(
        df, measure(df, ["entity_id", "year"]), measure(df, ["entity_id", "year", "venue_id"])
    )
    return W.ground_flags(from_sides(shares, ["home_share"])).select(
        "match_id", "is_home_ground", "is_neutral_venue"
    )


_SCHED = ["days_rest", "is_back_to_back", "bye_last_round"]
define(
    "rest",
    """
SELECT match_id, side, d AS days_rest, CASE WHEN d < 6 THEN 1 ELSE 0 END AS is_back_to_back,
       CASE WHEN d >= 11 THEN 1 ELSE 0 END AS bye_last_round
FROM (SELECT match_id, side, CAST(event_date - lag(event_date) OVER (PARTITION BY entity_id ORDER BY event_date, match_id)
             AS INTEGER) AS d FROM log)""",
)


@query("wn08_schedule", wide_sql("rest", _SCHED, {"rest_diff": "days_rest"}))
def wn08(spark, sf):
    df = log(spark, sf).select("match_id", "event_date", "side", "entity_id")
    return from_sides(W.schedule(df, per_entity(df)), _SCHED, differences={"rest_diff": "days_rest"})


_CONS = [f"{s}_{n}" for n in (5, 8) for s in ("pf_std", "pa_std", "close_game_rate", "pf_trend", "pa_trend")]
_CONS_D = {
    f"{s}_diff_{n}": f"{v}_{n}"
    for n in (5, 8)
    for s, v in (("pf_std", "pf_std"), ("close_game", "close_game_rate"), ("pf_trend", "pf_trend"), ("pa_trend", "pa_trend"))
}


def _guarded(expr: str, n: int) -> str:
    return f"CASE WHEN count(*) {_frame(n)} >= 3 THEN {expr} END"


define(
    "consistency",
    "SELECT match_id, side, "
    + ", ".join(
        f"{_guarded(f'stddev_samp(points_for) {_frame(n)}', n)} AS pf_std_{n}, "
        f"{_guarded(f'stddev_samp(points_against) {_frame(n)}', n)} AS pa_std_{n}, "
        f"{_guarded(f'avg(CASE WHEN abs(margin) <= 6 THEN 1 WHEN margin IS NOT NULL THEN 0 END) {_frame(n)}', n)} AS close_game_rate_{n}, "
        f"{_guarded(f'avg(points_for) {_frame(3)} - avg(points_for) {_frame(n)}', n)} AS pf_trend_{n}, "
        f"{_guarded(f'avg(points_against) {_frame(3)} - avg(points_against) {_frame(n)}', n)} AS pa_trend_{n}"
        for n in (5, 8)
    )
    + " FROM log",
)


@query("wn09_scoring_consistency", wide_sql("consistency", _CONS, _CONS_D), names(_CONS, _CONS_D))
def wn09(spark, sf):
    df = log(spark, sf)
    return from_sides(W.scoring_consistency(df, per_entity(df)), _CONS, differences=_CONS_D)


@query("wn10_close_game_rate", wide_sql("consistency", ["close_game_rate_5"]), names(["close_game_rate_5"]))
def wn10(spark, sf):
    df = log(spark, sf)
    return from_sides(W.scoring_consistency(df, per_entity(df), windows=(5,)), ["close_game_rate_5"])


@query("wn11_short_long_trend", wide_sql("consistency", ["pf_trend_8", "pa_trend_8"]), names(["pf_trend_8", "pa_trend_8"]))
def wn11(spark, sf):
    df = log(spark, sf)
    return from_sides(W.scoring_consistency(df, per_entity(df), windows=(8,)), ["pf_trend_8", "pa_trend_8"])


define(
    "cv",
    "SELECT match_id, side, pf_std_5 / CASE WHEN avg_pf_5 IS NOT NULL THEN greatest(avg_pf_5, 1) END AS scoring_cv_5 "
    "FROM consistency JOIN form USING (match_id, side)",
)


@query(
    "wn12_scoring_cv",
    wide_sql("cv", ["scoring_cv_5"], {"scoring_cv_diff_5": "scoring_cv_5"}),
    names(["scoring_cv_5"], {"scoring_cv_diff_5": ""}),
)
def wn12(spark, sf):
    df = log(spark, sf)
    layout = per_entity(df)
    both = W.scoring_consistency(W.rolling_form(df, layout, windows=(5,)), layout, windows=(5,))
    cv = both.withColumn("scoring_cv_5", W.scoring_cv("pf_std_5", "avg_pf_5"))
    return from_sides(cv, ["scoring_cv_5"], differences={"scoring_cv_diff_5": "scoring_cv_5"})


@query(
    "wn13_attendance_ratio",
    f"""
SELECT match_id, CASE WHEN n >= 3 THEN attendance / nullif(a, 0) END AS attendance_normalized,
       CASE WHEN n >= 3 AND attendance IS NOT NULL THEN CAST(attendance > a * 1.2::DOUBLE AS DOUBLE) END AS attendance_high
FROM (SELECT match_id, attendance, count(attendance) OVER w AS n, avg(attendance) OVER w AS a
      FROM matches WINDOW w AS (PARTITION BY home_id ORDER BY event_date, match_id {_B}))""",
    "attendance_normalized",
)
def wn13(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "home_id", "attendance")
    return W.attendance_ratio(m, measure(m, ["home_id"])).select(
        "match_id", "attendance_normalized", "attendance_high"
    )


define(
    "lineups",
    """
SELECT l.match_id, l.event_date, l.side, l.entity_id, s.starters, s.slot1, s.slot2
FROM log l LEFT JOIN (SELECT match_id, side, list_sort(list(member_id)) AS starters,
                             max(CASE WHEN slot = 1 THEN member_id END) AS slot1, max(CASE WHEN slot = 2 THEN member_id END) AS slot2
                      FROM appearances WHERE is_starter GROUP BY 1, 2) s USING (match_id, side)""",
)


@query(
    "wn14_lineup_retention",
    """
SELECT match_id, max(CASE WHEN side = 'home' THEN r END) AS home_lineup_stability,
       max(CASE WHEN side = 'away' THEN r END) AS away_lineup_stability,
       max(CASE WHEN side = 'home' THEN r END) - max(CASE WHEN side = 'away' THEN r END) AS lineup_stability_diff
FROM (SELECT match_id, side, CASE WHEN prev IS NOT NULL THEN len(list_intersect(starters, prev))::DOUBLE / len(starters) END AS r
      FROM (SELECT *, last_value(starters IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY event_date, match_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM lineups))
GROUP BY match_id""",
    "home_lineup_stability away_lineup_stability lineup_stability_diff",
)
def wn14(spark, sf):
    lineups = G.lineups(log(spark, sf), A.appearances(spark, sf))
    df = G.lineup_stability(lineups, per_entity(lineups))
    return from_sides(df, ["lineup_stability"], differences={"lineup_stability_diff": "lineup_stability"})


@query(
    "wn15_official_record",
    f"""
SELECT match_id, a AS ref_home_win_rate, n AS ref_games, CAST(coalesce(a > 0.6::DOUBLE, false) AS DOUBLE) AS ref_is_high_home
FROM (SELECT match_id, avg(hw) OVER w AS a, count(hw) OVER w AS n
      FROM (SELECT *, CASE WHEN home_score > away_score THEN 1 WHEN home_score IS NOT NULL THEN 0 END AS hw FROM matches)
      WINDOW w AS (PARTITION BY referee ORDER BY event_date, match_id {_B}))""",
    "ref_home_win_rate",
)
def wn15(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "referee", "home_score", "away_score")
    return W.official_record(m, measure(m, ["referee"])).select(
        "match_id", "ref_home_win_rate", "ref_games", "ref_is_high_home"
    )


STATS = ["runs", "metres", "sets", "errors"]
ROLLED = [f"avg_{s}_{n}" for n in (3, 5) for s in STATS]
ROLLED_D = {f"{v}_diff": v for v in ROLLED}
define(
    "rolled_stats",
    "SELECT match_id, side, "
    + ", ".join(f"avg({s}) {_frame(n)} AS avg_{s}_{n}" for n in (3, 5) for s in STATS)
    + " FROM stats_log",
)


@query("wn16_rolling_process_stats", wide_sql("rolled_stats", ROLLED, ROLLED_D), names(ROLLED, ROLLED_D))
def wn16(spark, sf):
    df = stats_log(spark, sf)
    return from_sides(W.rolling_stats(df, per_entity(df), STATS), ROLLED, differences=ROLLED_D)


define(
    "member_games",
    """
SELECT a.*, minutes, touches FROM appearances a
LEFT JOIN (SELECT l_orderkey AS match_id, l_suppkey AS member_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS minutes,
                  count(*) AS touches FROM lineitem GROUP BY 1, 2) USING (match_id, member_id)""",
)
_MF = [f"avg_{s}_{n}" for s in ("minutes", "touches") for n in (3, 5)]


@query(
    "wn17_member_form",
    "SELECT match_id, side, "
    + ", ".join(
        f"avg(CASE WHEN is_starter THEN {c} END) AS starter_{c}, avg(CASE WHEN is_spine THEN {c} END) AS spine_{c}" for c in _MF
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"avg({s}) OVER (PARTITION BY member_id ORDER BY event_date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS avg_{s}_{n}"
        for s in ("minutes", "touches")
        for n in (3, 5)
    )
    + " FROM member_games) GROUP BY match_id, side",
    " ".join(f"{k}_{c}" for k in ("starter", "spine") for c in _MF),
)
def wn17(spark, sf):
    members = member_games(spark, sf)
    members = A.dealt(members, A.table(spark, sf, "lineitem").count(), "member_id")
    return W.member_form(members, measure(members, ["member_id"]), ["minutes", "touches"])


@query(
    "wn18_slot_changes",
    """
SELECT match_id, side, CASE WHEN starters IS NOT NULL AND prev IS NOT NULL THEN
       CAST(slot1 IS DISTINCT FROM prev1 AS INTEGER) + CAST(slot2 IS DISTINCT FROM prev2 AS INTEGER) END AS slot_changes
FROM (SELECT *, lag(starters) OVER w AS prev, lag(slot1) OVER w AS prev1, lag(slot2) OVER w AS prev2
      FROM lineups WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, match_id))""",
)
def wn18(spark, sf):
    lineups = G.lineups(log(spark, sf), A.appearances(spark, sf))
    return G.slot_changes(lineups, per_entity(lineups), slots=(1, 2)).select("match_id", "side", "slot_changes")


_OA = [f"oa_{s}_5" for s in ("runs", "sets", "errors")]
define(
    "rated_log",
    """
SELECT s.*, CASE WHEN s.side = 'home' THEN 1400 + (m.cents // 7) % 201 ELSE 1400 + m.cents % 201 END AS opponent_rating
FROM stats_log s JOIN matches m USING (match_id)""",
)
define(
    "oa",
    "SELECT match_id, side, "
    + ", ".join(
        f"sum({s} * wt) {_frame(5)} / nullif(sum(CASE WHEN {s} IS NOT NULL THEN wt END) {_frame(5)}, 0) AS oa_{s}_5"
        for s in ("runs", "sets", "errors")
    )
    + " FROM (SELECT *, opponent_rating / avg(opponent_rating) OVER (PARTITION BY year) AS wt FROM rated_log)",
)


@query("wn19_opponent_adjusted", wide_sql("oa", _OA, {f"{v}_diff": v for v in _OA}), names(_OA, {f"{v}_diff": v for v in _OA}))
def wn19(spark, sf):
    cents = A.matches(spark, sf).select("match_id", "cents")
    rating = F.when(F.col("side") == "home", F.expr("cents div 7") % 201 + 1400).otherwise(F.col("cents") % 201 + 1400)
    df = W.opponent_weight(stats_log(spark, sf).join(cents, "match_id").withColumn("opponent_rating", rating))
    rolled = W.weighted_rolling(df, per_entity(df), ["runs", "sets", "errors"])
    return from_sides(rolled, _OA, differences={f"{v}_diff": v for v in _OA})


define(
    "workload",
    """
SELECT entity_id, year, round, avg(minutes) AS starter_load, avg(CASE WHEN is_spine THEN minutes END) AS spine_load,
       count(*) FILTER (WHERE minutes > 75) AS heavy_count
FROM member_games WHERE is_starter GROUP BY 1, 2, 3""",
)
define(
    "workload_roll",
    """
SELECT entity_id, year, round, avg(starter_load) OVER w AS starter_load_3, avg(spine_load) OVER w AS spine_load_3,
       avg(heavy_count) OVER w AS heavy_load_3
FROM workload WINDOW w AS (PARTITION BY entity_id ORDER BY year, round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)


@query("wn20_rolling_workload", "SELECT * FROM workload_roll", "starter_load_3 spine_load_3 heavy_load_3")
def wn20(spark, sf):
    return W.rolling_workload(W.workload(member_games(spark, sf)))


define(
    "period",
    """
SELECT year, round, CAST(p AS DOUBLE) AS is_period,
       CASE WHEN p THEN CAST(least(row_number() OVER (PARTITION BY year, p ORDER BY round), 3) AS INTEGER) ELSE 0 END AS period_round_number
FROM (SELECT year, round, avg(CASE WHEN month(event_date) IN (6, 7) THEN 1 ELSE 0 END) >= 0.5 AS p FROM matches GROUP BY 1, 2)""",
)


@query("wn21_period_round_number", "SELECT * FROM period")
def wn21(spark, sf):
    return W.season_period(A.matches(spark, sf))


@query(
    "wn22_identity_islands",
    """
SELECT home_id, member, year, isle, min(year) OVER (PARTITION BY home_id, member, isle) AS first_year
FROM (SELECT *, CAST(coalesce(sum(brk) OVER (PARTITION BY home_id, member ORDER BY year), 0) AS BIGINT) AS isle
      FROM (SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY home_id, member ORDER BY year) > 2 THEN 1 ELSE 0 END AS brk
            FROM (SELECT DISTINCT home_id, CAST(o_custkey AS VARCHAR) AS member, year FROM m0)))""",
)
def wn22(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    nations = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home_id"))
    seen = orders.join(nations, "o_custkey").select("home_id", F.col("o_custkey").cast("string").alias("member"), "year")
    return G.identity_islands(seen, ["home_id", "member"])


define(
    "expected_slots",
    """
SELECT entity_id, match_id, slot, member_id AS expected_member
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, match_id, slot ORDER BY n DESC, member_id) AS rk
      FROM (SELECT t.entity_id, t.match_id, a.slot, a.member_id, count(*) AS n
            FROM (SELECT entity_id, match_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, match_id) AS o
                  FROM (SELECT DISTINCT entity_id, match_id, event_date FROM appearances)) t
            JOIN (SELECT x.entity_id, x.slot, x.member_id, y.o FROM appearances x JOIN
                    (SELECT entity_id, match_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, match_id) AS o
                     FROM (SELECT DISTINCT entity_id, match_id, event_date FROM appearances)) y USING (entity_id, match_id)
                  WHERE x.is_starter) a
              ON a.entity_id = t.entity_id AND a.o BETWEEN t.o - 5 AND t.o - 1
            GROUP BY ALL)) WHERE rk = 1""",
)


@query("wn23_expected_starters", "SELECT * FROM expected_slots")
def wn23(spark, sf):
    return G.expected_starters(A.appearances(spark, sf))


define(
    "picks",
    """
SELECT *, CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN 0 END AS y,
       0.495::DOUBLE * model_prob + 0.505::DOUBLE * odds_prob AS blend_prob,
       CAST((odds_prob >= 0.5) = (home_win = 1) AS INTEGER) AS odds_correct,
       CAST((model_prob >= 0.5) = (home_win = 1) AS INTEGER) AS model_correct,
       CAST((0.495::DOUBLE * model_prob + 0.505::DOUBLE * odds_prob >= 0.5) = (home_win = 1) AS INTEGER) AS tip_correct,
       abs(0.495::DOUBLE * model_prob + 0.505::DOUBLE * odds_prob - 0.5) * 2 AS confidence
FROM predictions WHERE odds_prob IS NOT NULL AND home_win IS NOT NULL""",
)
define("pick_rounds", "SELECT year, round, CAST(sum(tip_correct) AS BIGINT) AS correct, count(*) AS games FROM picks GROUP BY 1, 2")


def picks(spark, sf):
    """Played games with a price: three pickers, whether each was right, and the confidence."""
    from duelframe.operators.decisions import blended_picks

    return blended_picks(A.predictions(spark, sf))


def pick_rounds(spark, sf):
    return picks(spark, sf).groupBy("year", "round").agg(
        F.sum("tip_correct").alias("correct"), F.count(F.lit(1)).alias("games")
    )


@query(
    "wn24_cumulative_rate",
    """
SELECT year, round, correct, games, CAST(sum(correct) OVER w AS BIGINT) AS cum_correct, sum(correct) OVER w / sum(games) OVER w AS cum_rate
FROM pick_rounds WINDOW w AS (PARTITION BY year ORDER BY round)""",
    "cum_rate",
)
def wn24(spark, sf):
    return W.cumulative_rate(pick_rounds(spark, sf))


@query(
    "wn25_latest_rounds",
    "SELECT year, round, correct, games FROM (SELECT *, dense_rank() OVER (PARTITION BY year ORDER BY round DESC) AS k FROM pick_rounds) WHERE k <= 3",
)
def wn25(spark, sf):
    return W.latest_rounds(pick_rounds(spark, sf))


define(
    "importances",
    """
SELECT year, feature, round(importance, 6) AS importance FROM (
  SELECT year, abs(corr(model_prob, home_win)) AS model_prob, abs(corr(odds_prob, home_win)) AS odds_prob,
         abs(corr(open_prob, home_win)) AS open_prob, abs(corr(line_home_open, home_win)) AS line_home_open
  FROM picks GROUP BY year)
UNPIVOT (importance FOR feature IN (model_prob, odds_prob, open_prob, line_home_open))""",
)


def importances(spark, sf):
    """Yearly absolute correlation of each numeric column with the outcome, as a long table."""
    features = ["model_prob", "odds_prob", "open_prob", "line_home_open"]
    wide = picks(spark, sf).groupBy("year").agg(*[F.abs(F.corr(c, "home_win")).alias(c) for c in features])
    return wide.unpivot("year", features, "feature", "importance").withColumn("importance", F.round("importance", 6))


@query(
    "wn26_feature_rank",
    "SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM importances",
    "importance",
)
def wn26(spark, sf):
    return W.rank_features(importances(spark, sf))


_CF = [f"avg_{s}_{n}" for n in (3, 5) for s in ("attack", "spine_attack", "error_rate", "errors")]


@query(
    "wn27_composite_form",
    f"""
SELECT match_id, side, {', '.join(f"avg({s}) {_frame(n)} AS avg_{s}_{n}" for n in (3, 5) for s in ("attack", "spine_attack", "error_rate", "errors"))}
FROM (SELECT l.match_id, l.side, l.entity_id, l.event_date, (g.m + g.t) / 2 AS attack, g.sm AS spine_attack,
             s.errors::DOUBLE / nullif(s.sets, 0) AS error_rate, s.errors
      FROM log l LEFT JOIN side_stats s USING (match_id, side)
      LEFT JOIN (SELECT match_id, side, avg(minutes) AS m, avg(touches) AS t, avg(CASE WHEN is_spine THEN minutes END) AS sm
                 FROM member_games GROUP BY 1, 2) g USING (match_id, side))""",
    " ".join(_CF),
)
def wn27(spark, sf):
    per_game = member_games(spark, sf).groupBy("match_id", "side").agg(
        F.avg("minutes").alias("m"), F.avg("touches").alias("t"),
        F.avg(F.when(F.col("is_spine"), F.col("minutes"))).alias("spine_attack"),
    )
    games = (
        stats_log(spark, sf)
        .join(per_game, ["match_id", "side"], "left")
        .withColumns({"attack": W.known_mean("m", "t"), "error_rate": F.try_divide("errors", "sets")})
        .select("match_id", "side", "event_date", "entity_id", "attack", "spine_attack", "error_rate", "errors")
    )
    return W.composite_form(games, per_entity(games)).select("match_id", "side", *_CF)


@query(
    "wn28_momentum",
    "SELECT *, home_form_momentum - away_form_momentum AS form_momentum_diff FROM (SELECT match_id, "
    "home_win_rate_3 - home_win_rate_8 AS home_form_momentum, away_win_rate_3 - away_win_rate_8 AS away_form_momentum, "
    "home_win_rate_3 - home_win_rate_5 AS home_form_momentum_3v5, away_win_rate_3 - away_win_rate_5 AS away_form_momentum_3v5 "
    f"FROM ({wide_sql('form', FORM)}))",
    "home_form_momentum away_form_momentum home_form_momentum_3v5 away_form_momentum_3v5 form_momentum_diff",
)
def wn28(spark, sf):
    from duelframe.operators.features import momentum

    return momentum(wn01(spark, sf)).select(
        "match_id", "home_form_momentum", "away_form_momentum", "home_form_momentum_3v5",
        "away_form_momentum_3v5", "form_momentum_diff",
    )
