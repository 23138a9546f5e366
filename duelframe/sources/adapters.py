"""Views of the given Parquet tables as two-sided event data.

Every view is a lazy plan over whole tables; nothing is sampled. Money is turned into integer cents
and prices into integer ticks before any aggregation, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# fixed values: slot -> position, the usual thirteen starters and four on the bench
POSITION_BY_SLOT = {
    1: "FB", 2: "WG", 3: "CE", 4: "CE", 5: "WG", 6: "FE", 7: "HB", 8: "PR", 9: "HK",
    10: "PR", 11: "SR", 12: "SR", 13: "LK", 14: "INT", 15: "INT", 16: "INT", 17: "INT",
}
SPINE_SLOTS = (1, 6, 7, 9)
#: Rows that a task sorts and groups at once.
ROWS_PER_TASK = 500_000


def whole(c: Column) -> Column:
    """Nearest integer of a non-negative amount."""
    return F.floor(c + F.lit(0.5))


def view(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Mark a lazy plan over given tables. It is built anew for each use, so files that landed since are read."""

    @wraps(build)
    def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark, sf_dir)

    return planned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over so many tasks that one gets about ``ROWS_PER_TASK`` of ``rows``
    rows; the number is given, so that it is not lowered for rows that compress well."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return df.repartition(n, *keys)


@view
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order between the customer's nation (home) and a derived other nation (away)."""
    return matches_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def matches_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The match view over given (batch or streaming) orders."""
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = customer.select("c_custkey", "c_nationkey")
    day = F.col("o_orderdate").cast("date")
    key, cents = F.col("o_orderkey"), F.col("cents")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn("cents", whole(F.col("o_totalprice") * 100))
        .withColumn("scored", key % 50 != 0)
        .select(
            key.alias("match_id"),
            day.alias("event_date"),
            F.year(day).alias("year"),
            (F.expr("(dayofyear(cast(o_orderdate as date)) - 1) div 14") + 1).cast("int").alias("round"),
            F.col("c_nationkey").alias("home_id"),
            ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int").alias("away_id"),
            F.when(F.col("scored"), cents % 41).cast("int").alias("home_score"),
            F.when(F.col("scored"), F.expr("cents div 41") % 41).cast("int").alias("away_score"),
            (F.col("o_custkey") % 40).cast("int").alias("venue_id"),
            F.col("o_orderpriority").alias("referee"),
            F.when(key % 17 != 0, cents % 30000).cast("int").alias("attendance"),
            (F.col("o_custkey") % 8).cast("int").alias("league"),
            "cents",
        )
        .withColumns(
            {
                "halftime_home": F.expr("home_score div 2").cast("int"),
                "halftime_away": F.expr("away_score div 3").cast("int"),
                "penalty_home": F.when(F.col("match_id") % 7 != 0, F.col("cents") % 11).cast("int"),
                "penalty_away": F.when(F.col("match_id") % 7 != 0, F.expr("cents div 11") % 11).cast("int"),
                "round_label": F.when(F.col("round") == 24, "Qualif Final")
                .when(F.col("round") == 25, "Semi Final")
                .when(F.col("round") == 26, "Prelim Final")
                .when(F.col("round") == 27, "Grand Final")
                .otherwise(F.col("round").cast("string")),
                "kickoff_time": F.when(
                    F.col("match_id") % 13 != 0,
                    F.concat(
                        (F.col("cents") % 12 + 1).cast("string"),
                        F.lit(":"),
                        F.lpad((F.expr("cents div 12") % 4 * 15).cast("string"), 2, "0"),
                        F.when(F.expr("cents div 48") % 2 == 0, " AM").otherwise(" PM"),
                    ),
                ),
            }
        )
    )


@view
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmaker quotes: one per line item. Prices are ticks of 1/20."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_shipdate").alias("quoted_at"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("bookmaker"),
        (F.col("l_quantity").cast("int") + 21).alias("home_ticks"),
        (F.lit(72) - F.col("l_quantity").cast("int")).alias("away_ticks"),
        (F.col("l_partkey") % 41 - 20).cast("int").alias("line_halves"),
        (F.col("l_partkey") % 21 + 60).cast("int").alias("total_halves"),
    )


@view
def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per match: first and last quote, range, average and number of quotes."""
    at = F.struct("quoted_at", "line_no", "part_no", "bookmaker")
    quote = F.struct("home_ticks", "away_ticks", "line_halves", "total_halves")
    per_match = (
        quotes(spark, sf_dir)
        .groupBy("match_id")
        .agg(
            F.min_by(quote, at).alias("o"),
            F.max_by(quote, at).alias("c"),
            F.min("home_ticks").alias("hmin"),
            F.max("home_ticks").alias("hmax"),
            F.min("away_ticks").alias("amin"),
            F.max("away_ticks").alias("amax"),
            F.sum("home_ticks").alias("hsum"),
            F.sum("away_ticks").alias("asum"),
            F.count(F.lit(1)).cast("int").alias("bookmakers_surveyed"),
        )
    )
    closed = F.col("match_id") % 9 != 0

    def price(c: str | Column) -> Column:
        return (F.col(c) if isinstance(c, str) else c) / F.lit(20.0)

    n = F.col("bookmakers_surveyed")
    return per_match.select(
        "match_id",
        (F.col("hsum") / (n * F.lit(20.0))).alias("h2h_home"),
        (F.col("asum") / (n * F.lit(20.0))).alias("h2h_away"),
        price("o.home_ticks").alias("h2h_home_open"),
        price("o.away_ticks").alias("h2h_away_open"),
        F.when(closed, price("c.home_ticks")).alias("h2h_home_close"),
        F.when(closed, price("c.away_ticks")).alias("h2h_away_close"),
        price("hmin").alias("h2h_home_min"),
        price("hmax").alias("h2h_home_max"),
        price("amin").alias("h2h_away_min"),
        price("amax").alias("h2h_away_max"),
        (F.lit(10.0) + F.col("c.total_halves") / F.lit(4.0)).alias("h2h_draw"),
        (F.col("o.line_halves") / F.lit(2.0)).alias("line_home_open"),
        F.when(closed, F.col("c.line_halves") / F.lit(2.0)).alias("line_home_close"),
        (F.col("o.total_halves") / F.lit(2.0)).alias("total_line_open"),
        F.when(closed, F.col("c.total_halves") / F.lit(2.0)).alias("total_line_close"),
        "bookmakers_surveyed",
    )


@view
def odds_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odds as a second source would deliver them: no match id, dates off by up to two days,
    sides swapped on some rows, some matches absent."""
    base = matches(spark, sf_dir).select("match_id", "event_date", "home_id", "away_id")
    m = F.col("match_id")
    swap = m % 11 == 0
    return (
        base.join(odds(spark, sf_dir), "match_id")
        .filter(m % 7 != 0)
        .select(
            m.alias("odds_id"),
            F.date_add("event_date", (m % 5 - 2).cast("int")).alias("odds_date"),
            F.when(swap, F.col("away_id")).otherwise(F.col("home_id")).alias("home_id"),
            F.when(swap, F.col("home_id")).otherwise(F.col("away_id")).alias("away_id"),
            F.when(swap, F.col("h2h_away_open")).otherwise(F.col("h2h_home_open")).alias("h2h_home_open"),
            F.when(swap, F.col("h2h_home_open")).otherwise(F.col("h2h_away_open")).alias("h2h_away_open"),
        )
    )


@view
def member_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per match and side with what they did: the suppliers of an order, numbered within the
    side, with the quantity (``minutes``) and number (``touches``) of their lines."""
    given = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isNotNull())
    # dealt by the match alone: sums, join and slots then share this exchange
    lines = (
        dealt(given, given.count(), "l_orderkey")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("minutes"), F.count(F.lit(1)).alias("touches"))
    )
    base = matches(spark, sf_dir).select("match_id", "event_date", "year", "round", "home_id", "away_id")
    home = F.col("l_suppkey") % 2 == 0
    slot = F.row_number().over(Window.partitionBy("match_id", "side").orderBy("l_suppkey"))
    return (
        lines.join(base, lines.l_orderkey == base.match_id)
        .withColumn("side", F.when(home, "home").otherwise("away"))
        .withColumn("slot", slot)
        .select(
            "match_id",
            "event_date",
            "year",
            "round",
            "side",
            F.when(home, F.col("home_id")).otherwise(F.col("away_id")).alias("entity_id"),
            F.col("l_suppkey").alias("member_id"),
            F.concat(
                F.lit("P"), (F.col("l_suppkey") % 30).cast("string"), F.lit(" S"), F.col("l_suppkey").cast("string")
            ).alias("member_name"),
            "slot",
            (F.col("slot") <= 2).alias("is_starter"),
            (F.col("slot") == 1).alias("is_spine"),
            "minutes",
            "touches",
        )
    )


@view
def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per match and side; the unused sums are pruned, which leaves a distinct."""
    return member_lines(spark, sf_dir).drop("minutes", "touches")


@view
def side_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process statistics per match and side: quantities, cents and counts of the side's lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("match_id"),
            F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away").alias("side"),
            F.col("l_quantity").cast("long").alias("q"),
            whole(F.col("l_extendedprice") * 100).alias("c"),
            (F.col("l_returnflag") == "R").cast("long").alias("r"),
        )
        .groupBy("match_id", "side")
        .agg(
            F.sum("q").alias("runs"),
            F.sum("c").alias("metres"),
            F.count(F.lit(1)).alias("sets"),
            F.sum("r").alias("errors"),
        )
    )


@view
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and market probability per match, with the outcome."""
    m = matches(spark, sf_dir).select(
        "match_id", "event_date", "year", "round", "home_id", "away_id", "home_score", "away_score", "cents"
    )
    o = odds(spark, sf_dir).select(
        "match_id", "h2h_home_open", "h2h_away_open", "h2h_home_close", "h2h_away_close", "line_home_open"
    )

    def prob(kind: str) -> Column:
        a, h = F.col(f"h2h_away_{kind}"), F.col(f"h2h_home_{kind}")
        return a / (a + h)

    return m.join(o, "match_id", "left").select(
        "match_id",
        "event_date",
        "year",
        "round",
        "home_id",
        "away_id",
        "home_score",
        "away_score",
        ((F.col("cents") % 997 + 1) / F.lit(998.0)).alias("model_prob"),
        prob("open").alias("open_prob"),
        prob("close").alias("close_prob"),
        F.coalesce(prob("close"), prob("open")).alias("odds_prob"),
        "line_home_open",
        F.when(F.col("home_score") > F.col("away_score"), 1)
        .when(F.col("home_score") < F.col("away_score"), 0)
        .alias("home_win"),
    )
