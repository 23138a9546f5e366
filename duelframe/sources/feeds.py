"""Nested JSON feeds flattened with ``from_json``, ``explode`` and grouped aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.functions.text import first_known, looked_up
from duelframe.schema import numeric

BOOKMAKERS = (
    "id string, home_team string, away_team string, commence_time string, "
    "bookmakers array<struct<key: string, markets: array<struct<key: string, "
    "outcomes: array<struct<name: string, price: double, point: double>>>>>>"
)
MATCH_CENTRE = (
    "homeTeam struct<name: string, score: int>, awayTeam struct<name: string, score: int>, "
    "stats struct<groups: array<struct<title: string, stats: array<struct<title: string, "
    "homeValue: struct<value: double>, awayValue: struct<value: double>, home: struct<value: double>, away: struct<value: double>>>>>>"
)
_PERSON = "playerId: bigint, firstName: string, lastName: string, fullName: string, number: int"
PLAYERS = (
    f"homeTeam struct<players: array<struct<{_PERSON}>>>, awayTeam struct<players: array<struct<{_PERSON}>>>, "
    "stats struct<players: struct<homeTeam: array<struct<playerId: bigint, minutes: bigint>>, awayTeam: array<struct<playerId: bigint, minutes: bigint>>>>"
)
OFFICIALS = "officials array<struct<position: string, firstName: string, lastName: string>>, groundConditions string, weather string"
LEADERS = (
    "totalStats struct<leaders: array<struct<teamNickName: string, value: string>>>, "
    "averageStats struct<leaders: array<struct<teamNickName: string, value: string>>>"
)
DAILY = (
    "daily struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>, "
    "precipitation_sum: array<double>, wind_speed_10m_max: array<double>, weather_code: array<int>>"
)
LINEUP_MAP = "map<string, map<string, struct<full_name: string, player_id: bigint>>>"


def bookmaker_feed(feed: DataFrame, body: str = "body") -> DataFrame:
    """One fixture per event with the average head-to-head prices and home spread of its bookmakers."""
    # ``from_json`` does not run in generated code, nor does anything it is merged with; as a generator it is
    # not merged with whatever made the messages. A message without an object is still a row of nulls.
    e = feed.select(F.inline(F.array(F.from_json(body, BOOKMAKERS))))
    outcomes = (
        e.select("id", "home_team", "away_team", "commence_time", F.explode_outer("bookmakers").alias("b"))
        .select("id", "home_team", "away_team", "commence_time", F.explode_outer("b.markets").alias("m"))
        .select("id", "home_team", "away_team", "commence_time", F.col("m.key").alias("market"), F.explode_outer("m.outcomes").alias("o"))
    )
    head, home = F.col("market") == "h2h", F.col("o.name") == F.col("home_team")
    away = F.col("o.name") == F.col("away_team")
    return outcomes.groupBy("id", "home_team", "away_team", "commence_time").agg(
        F.avg(F.when(head & home, F.col("o.price"))).alias("h2h_home"),
        F.avg(F.when(head & away, F.col("o.price"))).alias("h2h_away"),
        F.avg(F.when((F.col("market") == "spreads") & home, F.col("o.point"))).alias("spread_home"),
    )


def match_centre(feed: DataFrame, columns: Mapping[str, str], keys: Sequence[str], body: str = "body") -> DataFrame:
    """Wide statistics per match; titles map to declared columns and either value spelling is read."""
    rows = feed.select(*keys, F.from_json(body, MATCH_CENTRE).alias("d"))
    stats = rows.select(
        *keys,
        F.col("d.homeTeam.score").alias("home_score"),
        F.col("d.awayTeam.score").alias("away_score"),
        F.explode_outer(F.flatten(F.transform("d.stats.groups", lambda g: g["stats"]))).alias("s"),
    ).withColumns(
        {
            "name": looked_up("s.title", columns),
            "home": F.coalesce("s.homeValue.value", "s.home.value"),
            "away": F.coalesce("s.awayValue.value", "s.away.value"),
        }
    )
    return stats.groupBy(*keys, "home_score", "away_score").agg(
        *[
            F.max(F.when(F.col("name") == n, F.col(side))).alias(f"{side}_{n}")
            for n in dict.fromkeys(columns.values())
            for side in ("home", "away")
        ]
    )


def player_rows(feed: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Player statistics joined to the line-up entries of the same side by player id."""
    rows = feed.select(*keys, F.from_json(body, PLAYERS).alias("d"))

    def both(name: str, home: str, away: str) -> DataFrame:
        sides = F.array(
            F.struct(F.lit("home").alias("side"), F.col(home).alias("items")),
            F.struct(F.lit("away").alias("side"), F.col(away).alias("items")),
        )
        return rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", F.explode("s.items").alias(name))

    people = both("p", "d.homeTeam.players", "d.awayTeam.players").select(
        *keys,
        "side",
        F.col("p.playerId").alias("player_id"),
        first_known(F.concat_ws(" ", "p.firstName", "p.lastName"), "p.fullName").alias("player_name"),
        F.col("p.number").alias("jersey_number"),
    )
    played = both("x", "d.stats.players.homeTeam", "d.stats.players.awayTeam").select(
        *keys, "side", F.col("x.playerId").alias("player_id"), F.col("x.minutes").alias("minutes")
    )
    return played.join(people, [*keys, "side", "player_id"], "left").withColumn(
        "jersey_number", F.coalesce("jersey_number", F.lit(0))
    )


def officials(feed: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """First official whose position is referee, with ground and weather reports."""
    d = feed.select(*keys, F.from_json(body, OFFICIALS).alias("d"))
    first = F.try_element_at(F.filter("d.officials", lambda o: o["position"] == "Referee"), F.lit(1))
    return d.select(
        *keys,
        F.nullif(F.concat_ws(" ", first["firstName"], first["lastName"]), F.lit("")).alias("referee"),
        F.col("d.groundConditions").alias("ground_conditions"),
        F.col("d.weather").alias("weather"),
    )


def leaders(feed: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Total and average leader lists as long rows; thousands separators are dropped."""
    d = feed.select(*keys, F.from_json(body, LEADERS).alias("d"))
    lists = F.array(
        F.struct(F.lit("total").alias("metric"), F.col("d.totalStats.leaders").alias("items")),
        F.struct(F.lit("average").alias("metric"), F.col("d.averageStats.leaders").alias("items")),
    )
    rows = d.select(*keys, F.explode(lists).alias("l")).select(*keys, "l.metric", F.explode("l.items").alias("x"))
    value = numeric(F.regexp_replace("x.value", ",", ""))
    return rows.select(*keys, "metric", F.col("x.teamNickName").alias("team"), value.alias("value")).filter(
        (F.col("team") != "") & F.col("value").isNotNull()
    )


def baseline_lineups(feed: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Baseline line-ups kept as a map of maps: team, jersey, member."""
    teams = feed.select(*keys, F.explode(F.from_json(body, LINEUP_MAP)).alias("team", "by_jersey"))
    return teams.select(*keys, "team", F.explode("by_jersey").alias("jersey", "m")).select(
        *keys, "team", F.col("jersey").try_cast("int").alias("jersey_number"), F.col("m.full_name").alias("full_name"), F.col("m.player_id").alias("player_id")
    )


def allowed_points(feed: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Points allowed by position as long rows."""
    d = F.from_json(body, "positions array<struct<position: string, avg_points_allowed: double>>")
    return feed.select(*keys, F.explode(d["positions"]).alias("p")).select(*keys, "p.*")


def daily_weather(feed: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Daily arrays as rows: mean of the day's extremes (or the one known), rain, wind and code 0 if missing."""
    d = feed.select(*keys, F.from_json(body, DAILY)["daily"].alias("d"))
    # an array the service left out must not hide the others
    zipped = F.arrays_zip(
        *[
            F.coalesce(f"d.{c}", F.array()).alias(c)
            for c in ("time", "temperature_2m_max", "temperature_2m_min", "precipitation_sum", "wind_speed_10m_max", "weather_code")
        ]
    )
    rows = d.select(*keys, F.explode(zipped).alias("z"))
    hi, lo = F.col("z.temperature_2m_max"), F.col("z.temperature_2m_min")

    def zero(c: str, places: int | None = None) -> Column:
        v = F.col(c) if places is None else F.round(c, places)
        return F.coalesce(v, F.lit(0))

    return rows.select(
        *keys,
        F.to_date("z.time").alias("day"),
        F.coalesce(F.bround((hi + lo) / 2, 1), hi, lo).alias("temperature_c"),
        zero("z.precipitation_sum", 1).alias("precipitation_mm"),
        zero("z.wind_speed_10m_max", 1).alias("wind_speed_kmh"),
        zero("z.weather_code").alias("weather_code"),
    )
