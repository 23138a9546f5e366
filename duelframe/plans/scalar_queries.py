"""Scalar function families (SCL) with their SQL checks, each over a whole given table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from duelframe.functions import numbers as N, text as X
from duelframe.plans.link_queries import ground_name
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.sources import adapters as A


@query(
    "scl01_trim_case",
    "SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, trim(' ' || p_name || ' ') AS bare, regexp_replace(p_name, ' [a-z]+$', '') AS stem FROM part",
)
def scl01(spark, sf):
    p = A.table(spark, sf, "part")
    padded = F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))
    return p.select(
        "p_partkey", X.folded(F.upper("p_name")).alias("low"), F.upper("p_name").alias("up"), F.trim(padded).alias("bare"),
        F.regexp_replace("p_name", " [a-z]+$", "").alias("stem"),
    )


@query("scl02_fuzzy_key", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS fuzzy FROM customer")
def scl02(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", X.fuzzy_key("c_name").alias("fuzzy"))


@query(
    "scl03_keyword_containment",
    "SELECT p_partkey, p_name LIKE '%red%' OR p_name LIKE '%ring%' OR p_name LIKE '%blue%' AS hit FROM part",
)
def scl03(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", X.has_any("p_name", ["red", "ring", "blue"]).alias("hit"))


@query(
    "scl04_last_token",
    "SELECT p_partkey, string_split(p_name, ' ')[-1] AS surname, ends_with(p_name, 'ring') AS is_ring FROM part",
)
def scl04(spark, sf):
    return A.table(spark, sf, "part").select(
        "p_partkey", X.last_token("p_name").alias("surname"), F.col("p_name").endswith("ring").alias("is_ring")
    )


@query("scl05_composite_key", "SELECT match_id, year || '_r' || round || '_' || home_id || '_v_' || away_id AS key FROM matches")
def scl05(spark, sf):
    return A.matches(spark, sf).select("match_id", X.composite_key("year", "round", "home_id", "away_id").alias("key"))


@query(
    "scl06_slug",
    "SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_brand || '. ' || p_type || '  ' || p_name), '.', ''), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM part",
)
def scl06(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit(". "), F.col("p_type"), F.lit("  "), F.col("p_name"))
    return A.table(spark, sf, "part").select("p_partkey", X.slug(raw).alias("slug"))


@query(
    "scl07_snake_case",
    "SELECT user_id, event_type || '_kick_metres' AS snake FROM events",
)
def scl07(spark, sf):
    return A.table(spark, sf, "events").select(
        "user_id", X.snake(F.concat(F.col("event_type"), F.lit("KickMetres"))).alias("snake")
    )


@query(
    "scl08_lenient_int",
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN CAST(o_custkey AS INTEGER) WHEN 2 THEN CAST(o_custkey AS INTEGER) ELSE NULL END AS n FROM orders""",
)
def scl08(spark, sf):
    cust = F.col("o_custkey")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("-"))
        .when(F.col("o_orderkey") % 4 == 1, F.format_number(cust, 0))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("+"), cust.cast("string")))
        .otherwise(F.col("o_orderpriority"))
    )
    return A.table(spark, sf, "orders").select("o_orderkey", X.lenient_int(text).alias("n"))


@query("scl09_ordinal_date", "SELECT match_id, event_date AS parsed FROM matches")
def scl09(spark, sf):
    m = A.matches(spark, sf)
    d = F.col("event_date")
    day = F.dayofmonth(d)
    suffix = (
        F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    )
    full = F.concat(day.cast("string"), suffix, F.date_format(d, " MMMM"))
    short = F.concat(day.cast("string"), suffix, F.date_format(d, " MMM"))
    text = (
        F.when(F.col("match_id") % 4 == 0, full)
        .when(F.col("match_id") % 4 == 1, short)
        .when(F.col("match_id") % 4 == 2, F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return m.select("match_id", X.ordinal_date(text, "year").alias("parsed"))


def summary_lines(spark, sf):
    """One line of labelled fields per match, as a results page prints it."""
    m = A.matches(spark, sf)
    same = F.col("penalty_home") == F.col("penalty_away")
    parts = [
        F.concat(F.lit("Date: "), F.date_format("event_date", "EEE"), F.lit(", "), F.dayofmonth("event_date").cast("string"), F.lit("th "), F.date_format("event_date", "MMMM"), F.lit(".")),
        F.concat(F.lit("Kickoff: "), F.col("kickoff_time"), F.lit(".")),
        F.concat(F.lit("Halftime: Home "), F.col("halftime_home").cast("string"), F.lit("-"), F.col("halftime_away").cast("string"), F.lit(".")),
        F.concat(
            F.lit("Penalties: "), F.col("penalty_home").cast("string"),
            F.when(same, "-all").otherwise(F.concat(F.lit("-"), F.col("penalty_away").cast("string"))), F.lit("."),
        ),
        F.concat(F.lit("Referee: R "), F.element_at(F.split("referee", "-"), 2), F.lit(".")),
        F.concat(F.lit("Crowd: "), F.format_number("attendance", 0), F.lit(".")),
    ]
    return m.select("match_id", "year", F.concat_ws(" ", *parts).alias("line"))


define(
    "summary_fields",
    """
SELECT match_id, event_date, kickoff_time, halftime_home, halftime_away, penalty_home, penalty_away,
       'R ' || substr(referee, instr(referee, '-') + 1) AS referee, attendance FROM matches""",
)


@query("scl10_field_extraction", "SELECT match_id, event_date AS parsed_date, kickoff_time, halftime_home, halftime_away, penalty_home, penalty_away, referee, attendance FROM summary_fields")
def scl10(spark, sf):
    from duelframe.sources.pages import summary_fields

    return summary_fields(summary_lines(spark, sf), "line", "year").drop("line", "year")


@query(
    "scl11_name_counts",
    """
SELECT match_id, a.member_name AS name, CAST(CASE WHEN slot % 2 = 0 THEN slot ELSE 1 END AS INTEGER) AS n FROM appearances a""",
)
def scl11(spark, sf):
    a = A.appearances(spark, sf)
    one = F.when(F.col("slot") % 2 == 0, F.format_string("%s (%d)", "member_name", "slot")).otherwise(F.col("member_name"))
    text = a.groupBy("match_id", "side").agg(F.concat_ws(", ", F.sort_array(F.collect_list(one))).alias("scorers"))
    return text.select("match_id", F.explode(X.name_counts("scorers")).alias("s")).select(
        "match_id", F.col("s.name").alias("name"), F.col("s.count").alias("n")
    )


@query(
    "scl12_twelve_hour",
    """
SELECT match_id, CASE WHEN kickoff_time LIKE '%PM' AND h <> 12 THEN h + 12 WHEN kickoff_time LIKE '%AM' AND h = 12 THEN 0 ELSE h END AS hour
FROM (SELECT match_id, kickoff_time, CAST(split_part(kickoff_time, ':', 1) AS INTEGER) AS h FROM matches)""",
)
def scl12(spark, sf):
    return A.matches(spark, sf).select("match_id", X.twelve_hour("kickoff_time").alias("hour"))


@query(
    "scl13_date_parts",
    "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour FROM events",
)
def scl13(spark, sf):
    return A.table(spark, sf, "events").select(
        "event_id", F.weekday("ts").alias("weekday"), F.month("ts").alias("month"), F.year("ts").alias("year"), F.hour("ts").alias("hour")
    )


@query(
    "scl14_day_arithmetic",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 2 AS later, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders",
)
def scl14(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return A.table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(day, 2).alias("later"), F.datediff(day, F.lit(datetime.date(1995, 1, 1))).alias("days")
    )


@query(
    "scl15_season_week",
    "SELECT match_id, CAST(greatest(1, least(27, (event_date - make_date(year, 3, 1)) // 7 + CASE WHEN event_date < make_date(year, 3, 1) THEN 0 ELSE 1 END)) AS INTEGER) AS week FROM matches",
)
def scl15(spark, sf):
    return A.matches(spark, sf).select("match_id", N.season_week("event_date", F.make_date("year", F.lit(3), F.lit(1))).alias("week"))


@query(
    "scl16_local_weekday",
    "SELECT event_id, ts + INTERVAL 10 HOUR AS local_ts, CAST(dayofweek(ts + INTERVAL 10 HOUR) AS INTEGER) AS cron_day FROM events",
)
def scl16(spark, sf):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+10:00")
    return A.table(spark, sf, "events").select(
        "event_id", local.alias("local_ts"), F.pmod(F.weekday(local) + 1, F.lit(7)).alias("cron_day")
    )


@query(
    "scl17_fair_pair",
    """
SELECT match_id, (1 / h2h_home) / (1 / h2h_home + 1 / h2h_away) AS fair_home, (1 / h2h_away) / (1 / h2h_home + 1 / h2h_away) AS fair_away,
       1 / h2h_home + 1 / h2h_away AS overround FROM odds""",
    "fair_home fair_away overround",
)
def scl17(spark, sf):
    home, away, over = N.fair_pair("h2h_home", "h2h_away")
    return A.odds(spark, sf).select("match_id", home.alias("fair_home"), away.alias("fair_away"), over.alias("overround"))


@query(
    "scl18_clip",
    "SELECT match_id, CASE WHEN attendance IS NOT NULL THEN greatest(1000, least(20000, attendance)) END AS capped FROM matches",
)
def scl18(spark, sf):
    return A.matches(spark, sf).select("match_id", N.clipped("attendance", 1000, 20000).alias("capped"))


@query(
    "scl19_sign_power_log",
    "SELECT match_id, CAST(sign(home_score - away_score) AS DOUBLE) AS sgn, CAST((home_score - away_score) ** 2 AS DOUBLE) AS sq, CAST(abs(home_score - away_score) AS INTEGER) AS gap, ln(abs(home_score - away_score) + 1) AS lg FROM matches",
    "lg sgn sq",
)
def scl19(spark, sf):
    d = F.col("home_score") - F.col("away_score")
    return A.matches(spark, sf).select(
        "match_id", F.signum(d).alias("sgn"), F.pow(d, F.lit(2)).alias("sq"), F.abs(d).alias("gap"), F.ln(F.abs(d) + 1).alias("lg")
    )


@query(
    "scl20_haversine",
    """
SELECT match_id, 2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (
 SELECT match_id, sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(l2 - l1) / 2) ** 2 AS h FROM (
  SELECT match_id, radians(-45.0::DOUBLE + home_id * 3) AS a, radians(-45.0::DOUBLE + away_id * 3) AS b, 100.0::DOUBLE + home_id * 4 AS l1, 100.0::DOUBLE + away_id * 4 AS l2 FROM matches))""",
    "km",
)
def scl20(spark, sf):
    def lat(c):
        return F.col(c) * 3 - F.lit(45.0)

    def lon(c):
        return F.col(c) * 4 + F.lit(100.0)

    return A.matches(spark, sf).select(
        "match_id", N.haversine_km(lat("home_id"), lon("home_id"), lat("away_id"), lon("away_id")).alias("km")
    )


@query(
    "scl21_nested_conditional",
    "SELECT match_id, CASE WHEN home_score > away_score THEN 'home' WHEN home_score = away_score THEN 'draw' WHEN home_score < away_score THEN 'away' ELSE 'unplayed' END AS outcome FROM matches",
)
def scl21(spark, sf):
    h, a = F.col("home_score"), F.col("away_score")
    return A.matches(spark, sf).select(
        "match_id", F.when(h > a, "home").when(h == a, "draw").when(h < a, "away").otherwise("unplayed").alias("outcome")
    )


@query(
    "scl22_half_even",
    "SELECT match_id, CAST(round_even(attendance / 2.0, 0) * 2 AS DOUBLE) AS to_even FROM matches",
    "to_even",
)
def scl22(spark, sf):
    return A.matches(spark, sf).select("match_id", N.to_even("attendance").cast("double").alias("to_even"))


@query(
    "scl23_ordinal_map",
    "SELECT match_id, CASE ground_conditions WHEN 'Good' THEN 0 WHEN '' THEN 0 WHEN 'Fair' THEN 1 WHEN 'Heavy' THEN 4 END AS severity FROM weather",
)
def scl23(spark, sf):
    from duelframe.operators.features import GROUND_SEVERITY
    from duelframe.operators.tables import weather

    return weather(spark, sf).select("match_id", X.looked_up(F.trim("ground_conditions"), GROUND_SEVERITY).alias("severity"))


@query(
    "scl24_first_known",
    "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h2>([^<]*)</h2>', 1)), ''), nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), url) AS label FROM pages",
)
def scl24(spark, sf):
    return A.table(spark, sf, "pages").select(
        "page_id",
        X.first_known(F.regexp_extract("html", "<h2>([^<]*)</h2>", 1), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "url").alias("label"),
    )


@query(
    "scl25_json_access",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.detail.name'), 'none') AS detail FROM events",
)
def scl25(spark, sf):
    parsed = F.from_json("props", "k int, detail struct<name: string>")
    return A.table(spark, sf, "events").withColumn("p", parsed).select(
        "event_id", F.col("p.k").alias("k"), F.coalesce("p.detail.name", F.lit("none")).alias("detail")
    )


@query(
    "scl26_known_share",
    """
SELECT match_id, (CAST(home_score IS NOT NULL AS INTEGER) + CAST(attendance IS NOT NULL AS INTEGER) + CAST(penalty_home IS NOT NULL AS INTEGER) + CAST(kickoff_time IS NOT NULL AS INTEGER)) / 4.0::DOUBLE AS known FROM matches""",
    "known",
)
def scl26(spark, sf):
    return A.matches(spark, sf).select("match_id", N.known_share("home_score", "attendance", "penalty_home", "kickoff_time").alias("known"))


@query("scl27_median", "SELECT match_id, median(home_ticks) AS median_home, median(away_ticks) AS median_away FROM quotes GROUP BY 1", "median_home median_away")
def scl27(spark, sf):
    q = A.quotes(spark, sf)
    return q.groupBy("match_id").agg(F.median("home_ticks").alias("median_home"), F.median("away_ticks").alias("median_away"))


@query(
    "scl28_split_fixture",
    "SELECT match_id, 'Nation ' || home_id AS home_name, 'Nation ' || away_id AS away_name, CAST(event_date AS TIMESTAMP) + INTERVAL 19 HOUR + INTERVAL 35 MINUTE AS kickoff FROM matches",
)
def scl28(spark, sf):
    text = F.concat(
        F.lit("Nation "), F.col("home_id").cast("string"), F.lit(" v Nation "), F.col("away_id").cast("string"),
        F.date_format("event_date", " '('yyyy-MM-dd"), F.lit(" 19:35)"),
    )
    m = A.matches(spark, sf).select("match_id", text.alias("fixture"))
    return m.select("match_id", *[c.alias(n) for n, c in X.split_fixture("fixture").items()])
