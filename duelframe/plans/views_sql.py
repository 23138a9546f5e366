"""The adapter views again, as independent DuckDB SQL, for the side-by-side checks."""

from __future__ import annotations

import re

CTE: dict[str, str] = {
    "m0": """
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS event_date,
       CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST((dayofyear(o_orderdate) - 1) // 14 + 1 AS INTEGER) AS round,
       c_nationkey AS home_id, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS away_id,
       CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey, o_orderpriority AS referee
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "matches": """
SELECT match_id, event_date, year, round, home_id, away_id, home_score, away_score, venue_id, referee,
       attendance, league, cents,
       home_score // 2 AS halftime_home, away_score // 3 AS halftime_away,
       CAST(CASE WHEN match_id % 7 <> 0 THEN cents % 11 END AS INTEGER) AS penalty_home,
       CAST(CASE WHEN match_id % 7 <> 0 THEN (cents // 11) % 11 END AS INTEGER) AS penalty_away,
       CASE round WHEN 24 THEN 'Qualif Final' WHEN 25 THEN 'Semi Final' WHEN 26 THEN 'Prelim Final'
                  WHEN 27 THEN 'Grand Final' ELSE CAST(round AS VARCHAR) END AS round_label,
       CASE WHEN match_id % 13 <> 0 THEN CAST(cents % 12 + 1 AS VARCHAR) || ':' ||
            lpad(CAST((cents // 12) % 4 * 15 AS VARCHAR), 2, '0') ||
            CASE WHEN (cents // 48) % 2 = 0 THEN ' AM' ELSE ' PM' END END AS kickoff_time
FROM (SELECT *, CAST(CASE WHEN match_id % 50 <> 0 THEN cents % 41 END AS INTEGER) AS home_score,
             CAST(CASE WHEN match_id % 50 <> 0 THEN (cents // 41) % 41 END AS INTEGER) AS away_score,
             CAST(o_custkey % 40 AS INTEGER) AS venue_id, CAST(o_custkey % 8 AS INTEGER) AS league,
             CAST(CASE WHEN match_id % 17 <> 0 THEN cents % 30000 END AS INTEGER) AS attendance FROM m0)""",
    "log": """
SELECT *, points_for - points_against AS margin,
       CASE WHEN points_for > points_against THEN 1.0::DOUBLE WHEN points_for = points_against THEN 0.5::DOUBLE
            WHEN points_for < points_against THEN 0.0::DOUBLE END AS result
FROM (SELECT match_id, event_date, year, round, venue_id, league, 'home' AS side, home_id AS entity_id,
             away_id AS opponent_id, home_score AS points_for, away_score AS points_against,
             halftime_home - halftime_away AS halftime_lead, penalty_home - penalty_away AS penalty_diff
      FROM matches
      UNION ALL
      SELECT match_id, event_date, year, round, venue_id, league, 'away', away_id, home_id, away_score, home_score,
             halftime_away - halftime_home, penalty_away - penalty_home FROM matches)""",
    "quotes": """
SELECT l_orderkey AS match_id, l_shipdate AS quoted_at, l_linenumber AS line_no, l_partkey AS part_no,
       l_suppkey AS bookmaker, CAST(l_quantity AS INTEGER) + 21 AS home_ticks,
       72 - CAST(l_quantity AS INTEGER) AS away_ticks, CAST(l_partkey % 41 - 20 AS INTEGER) AS line_halves,
       CAST(l_partkey % 21 + 60 AS INTEGER) AS total_halves
FROM lineitem""",
    "quote_rank": """
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY quoted_at, line_no, part_no, bookmaker) AS first_rn,
       row_number() OVER (PARTITION BY match_id ORDER BY quoted_at DESC, line_no DESC, part_no DESC, bookmaker DESC) AS last_rn
FROM quotes""",
    "odds": """
SELECT match_id, sum(home_ticks) / (count(*) * 20.0::DOUBLE) AS h2h_home, sum(away_ticks) / (count(*) * 20.0::DOUBLE) AS h2h_away,
       max(CASE WHEN first_rn = 1 THEN home_ticks END) / 20.0::DOUBLE AS h2h_home_open,
       max(CASE WHEN first_rn = 1 THEN away_ticks END) / 20.0::DOUBLE AS h2h_away_open,
       CASE WHEN match_id % 9 <> 0 THEN max(CASE WHEN last_rn = 1 THEN home_ticks END) / 20.0::DOUBLE END AS h2h_home_close,
       CASE WHEN match_id % 9 <> 0 THEN max(CASE WHEN last_rn = 1 THEN away_ticks END) / 20.0::DOUBLE END AS h2h_away_close,
       min(home_ticks) / 20.0::DOUBLE AS h2h_home_min, max(home_ticks) / 20.0::DOUBLE AS h2h_home_max,
       min(away_ticks) / 20.0::DOUBLE AS h2h_away_min, max(away_ticks) / 20.0::DOUBLE AS h2h_away_max,
       10.0::DOUBLE + max(CASE WHEN last_rn = 1 THEN total_halves END) / 4.0::DOUBLE AS h2h_draw,
       max(CASE WHEN first_rn = 1 THEN line_halves END) / 2.0::DOUBLE AS line_home_open,
       CASE WHEN match_id % 9 <> 0 THEN max(CASE WHEN last_rn = 1 THEN line_halves END) / 2.0::DOUBLE END AS line_home_close,
       max(CASE WHEN first_rn = 1 THEN total_halves END) / 2.0::DOUBLE AS total_line_open,
       CASE WHEN match_id % 9 <> 0 THEN max(CASE WHEN last_rn = 1 THEN total_halves END) / 2.0::DOUBLE END AS total_line_close,
       CAST(count(*) AS INTEGER) AS bookmakers_surveyed
FROM quote_rank GROUP BY match_id""",
    "odds_feed": """
SELECT match_id AS odds_id, event_date + CAST(match_id % 5 - 2 AS INTEGER) AS odds_date,
       CASE WHEN match_id % 11 = 0 THEN away_id ELSE home_id END AS home_id,
       CASE WHEN match_id % 11 = 0 THEN home_id ELSE away_id END AS away_id,
       CASE WHEN match_id % 11 = 0 THEN h2h_away_open ELSE h2h_home_open END AS h2h_home_open,
       CASE WHEN match_id % 11 = 0 THEN h2h_home_open ELSE h2h_away_open END AS h2h_away_open
FROM matches JOIN odds USING (match_id) WHERE match_id % 7 <> 0""",
    "appearances": """
SELECT *, slot <= 2 AS is_starter, slot = 1 AS is_spine
FROM (SELECT match_id, event_date, year, round, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
             CASE WHEN l_suppkey % 2 = 0 THEN home_id ELSE away_id END AS entity_id, l_suppkey AS member_id,
             'P' || CAST(l_suppkey % 30 AS VARCHAR) || ' S' || CAST(l_suppkey AS VARCHAR) AS member_name,
             CAST(row_number() OVER (PARTITION BY match_id, l_suppkey % 2 ORDER BY l_suppkey) AS INTEGER) AS slot
      FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN matches ON l_orderkey = match_id)""",
    "side_stats": """
SELECT l_orderkey AS match_id, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS runs,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS metres, count(*) AS sets,
       count(*) FILTER (WHERE l_returnflag = 'R') AS errors
FROM lineitem GROUP BY 1, 2""",
    "stats_log": """
SELECT log.*, runs, metres, sets, errors FROM log LEFT JOIN side_stats USING (match_id, side)""",
    "predictions": """
SELECT match_id, event_date, year, round, home_id, away_id, home_score, away_score,
       (cents % 997 + 1) / 998.0::DOUBLE AS model_prob,
       h2h_away_open / (h2h_away_open + h2h_home_open) AS open_prob,
       h2h_away_close / (h2h_away_close + h2h_home_close) AS close_prob,
       coalesce(h2h_away_close / (h2h_away_close + h2h_home_close), h2h_away_open / (h2h_away_open + h2h_home_open)) AS odds_prob,
       line_home_open,
       CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN 0 END AS home_win
FROM matches LEFT JOIN odds USING (match_id)""",
}


def define(name: str, sql: str) -> None:
    """Add a shared view that later checks may build on."""
    if name in CTE:
        raise ValueError(f"view {name} is defined twice")
    CTE[name] = sql


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql.lower()))
    return [n for n in CTE if n in words]


RECURSIVE = {"fold", "fold_log", "fold_grid", "fold_reset", "blend_em", "blend_em_wf"}


def check_sql(body: str, r6: str = "", places: int = 6) -> str:
    """A full statement: the views the body names, in order, then the body.

    ``r6`` lists output columns rounded to ``places`` (and freed of negative zero).
    """
    ordered: list[str] = []

    def visit(sql: str, trail: tuple[str, ...]) -> None:
        for name in _needs(sql):
            if name in trail or name in ordered:
                continue
            visit(CTE[name], (*trail, name))
            ordered.append(name)

    visit(body, ())
    if r6:
        marks = ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in r6.split())
        body = f"SELECT * REPLACE ({marks}) FROM ({body})"
    views = ", ".join(f"{n} AS ({CTE[n].strip()})" for n in ordered)
    kind = "WITH RECURSIVE" if RECURSIVE & set(ordered) else "WITH"
    return f"{kind} {views} {body}" if ordered else body
