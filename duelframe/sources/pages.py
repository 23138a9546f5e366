"""Fields of landed pages and summary lines, by regular expressions on the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.functions.text import lenient_int, ordinal_date

# fixed values: the labelled fields of a match summary line; an optional team name starts with a
# letter, so that it cannot swallow the first digit of a count
DATE = r"(?i)Date:\s*\w+,?\s*(\d{1,2}\w*\s+\w+)"
KICKOFF = r"(?i)Kickoff:\s*([\d:]+\s*[ap]\.?m\.?)"
HALFTIME = r"(?i)Halftime:\s*(?:[a-z][\w\s.'-]*?\s)?\s*(\d+)\s*-\s*(\d+)"
PENALTIES = r"(?i)Penalties:\s*(?:[a-z][\w\s.'-]*?\s)?\s*(\d+)\s*-\s*(\d+|all)"
REFEREE = r"(?i)Referee:\s*([a-z][\w\s\-'.]+?)(?:\.|,|\s{2,}|$)"
CROWD = r"(?i)Crowd:\s*([\d,]+)"


def _found(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def summary_fields(df: DataFrame, line: str, year: str) -> DataFrame:
    """Typed columns from a summary line; ``N-all`` gives both sides the same count."""
    away = _found(line, PENALTIES, 2)
    home = lenient_int(_found(line, PENALTIES))
    return df.withColumns(
        {
            "parsed_date": ordinal_date(_found(line, DATE), year),
            "kickoff_time": F.regexp_replace(_found(line, KICKOFF), r"\.$", ""),
            "halftime_home": lenient_int(_found(line, HALFTIME)),
            "halftime_away": lenient_int(_found(line, HALFTIME, 2)),
            "penalty_home": home,
            "penalty_away": F.when(F.lower(away) == "all", home).otherwise(lenient_int(away)),
            "referee": F.trim(_found(line, REFEREE)),
            "attendance": lenient_int(_found(line, CROWD)),
        }
    )


def page_rows(pages: DataFrame, row: str, cells: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Table-like rows of a page: every match of ``row`` with its cells in order."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("at", "row"))
    return found.select(key, (F.col("at") + 1).alias("position"), F.regexp_extract_all("row", F.lit(cells), F.lit(1)).alias("cells"))


def ranked(rows: DataFrame, rank: Column) -> DataFrame:
    """Tied rows print no rank of their own: the position takes its place."""
    return rows.withColumn("rank", F.coalesce(rank.try_cast("int"), F.col("position")))


def page_header(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Language, title, first heading, number of paragraphs and links, host and path of a page."""
    return pages.select(
        key,
        _found(html, r'<html lang="([a-z]+)"').alias("lang"),
        _found(html, r"<title>([^<]*)</title>").alias("title"),
        _found(html, r"<h1>([^<]*)</h1>").alias("heading"),
        F.regexp_count(html, F.lit("<p>")).alias("paragraphs"),
        F.regexp_count(html, F.lit("<a href=")).alias("links"),
        _found(url, r"^https?://([^/]+)/").alias("host"),
        _found(url, r"^https?://[^/]+(/[^?#]*)").alias("path"),
        F.col(html).contains('class="ad"').alias("has_ad"),
    )


def land_pages(pages: DataFrame, folder: str) -> None:
    """Land pages (``year``, ``round``, ``value``) many to a file, each whole and with the path it would have as a
    file of its own: the number of files goes with the tasks, not with the pages. What a task has of one
    period is one page, as text written by period is one file."""

    def part(c: str) -> Column:  # as a folder of partitions names a missing value
        return F.concat(F.lit(f"/{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))

    text = F.concat(F.coalesce("value", F.lit("")), F.lit("\n"))
    path = F.concat(F.lit(folder), part("year"), part("round"), F.lit("/page"))
    rows = pages.select(path.alias("path"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), text.alias("text"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    rows.groupBy("path", "task").agg(F.array_join(in_order, "").alias("value")).select("path", "value").write.parquet(folder)


def landed_pages(spark, folder: str, bundled: bool = False) -> DataFrame:
    """Whole landed pages with year and round read off their path ``.../year=YYYY/round=N/...``;
    periods that were never landed are simply absent. A page is a file of its own, or with ``bundled``
    a row of what ``land_pages`` wrote."""
    if bundled:
        raw, path = spark.read.schema("path string, value string").parquet(folder), F.col("path")
    else:
        raw, path = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True), F.input_file_name()
    return raw.select(
        F.regexp_extract(path, r"/year=(\d{4})/", 1).try_cast("int").alias("year"),
        _found(path, r"/round=([^/]+)/").alias("round"),
        F.col("value").alias("html"),
    )
