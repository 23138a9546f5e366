"""Names, orientation and lookups that make two sources speak of the same thing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.functions.text import folded, fuzzy_key, last_token


def duplicate_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases claimed by more than one canonical name; must be empty for a usable table."""
    return (
        aliases.groupBy(folded("alias").alias("alias"))
        .agg(F.count_distinct("canonical").alias("claims"))
        .filter(F.col("claims") > 1)
    )


def canonical_names(
    df: DataFrame, columns: Sequence[str], aliases: DataFrame, strict: bool = True
) -> DataFrame:
    """Replace names by their canonical form: unknown names raise (strict) or stay as they are.

    The alias table is joined without a hint, so it is broadcast only while Spark measures it below
    the broadcast threshold; a larger table is shuffled and AQE splits hot names.
    """
    known = aliases.groupBy(folded("alias").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    for column in columns:
        joined = df.join(known, folded(column) == F.col("_alias"), "left")
        unknown = F.raise_error(F.concat(F.lit(f"unknown name in {column}: "), F.col(column))).cast("string")
        fallback = F.when(F.col(column).isNotNull(), unknown) if strict else F.trim(F.col(column))
        df = joined.withColumn(column, F.coalesce("_canonical", fallback)).drop("_alias", "_canonical")
    return df


def swap_where(df: DataFrame, condition: Column, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Exchange the columns of every pair on the rows where the condition holds, in one projection."""
    yes = F.coalesce(condition, F.lit(False))
    out: dict[str, Column] = {}
    for a, b in pairs:
        out[a] = F.when(yes, F.col(b)).otherwise(F.col(a))
        out[b] = F.when(yes, F.col(a)).otherwise(F.col(b))
    return df.withColumns(out)


def venue_owners(matches: DataFrame, venue: str = "venue_id", home: str = "home_id") -> DataFrame:
    """The side with most home games at each venue; ties go to the smallest id. A null venue has no owner."""
    games = matches.where(F.col(venue).isNotNull() & F.col(home).isNotNull()).groupBy(venue, home).agg(F.count(F.lit(1)).alias("_n"))
    return games.groupBy(venue).agg(F.max_by(home, F.struct(F.col("_n"), -F.col(home))).alias("owner_id"))


def orient_by_owner(
    matches: DataFrame, owners: DataFrame, pairs: Sequence[tuple[str, str]], venue: str = "venue_id"
) -> DataFrame:
    """Swap sides where the venue's owner is listed as the away side."""
    own = owners.groupBy(F.col(venue).alias("_venue")).agg(F.min("owner_id").alias("_owner"))
    joined = matches.join(own, F.col(venue) == F.col("_venue"), "left")
    swapped = F.coalesce(F.col("_owner") == F.col("away_id"), F.lit(False))
    marked = joined.withColumn("was_swapped", swapped)
    return swap_where(marked, F.col("was_swapped"), pairs).drop("_venue", "_owner")


def renamed_headers(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Map header variants (compared trimmed and lower-cased) to the declared names."""
    wanted = {k.strip().lower(): v for k, v in renames.items()}
    return df.withColumnsRenamed({c: wanted[c.strip().lower()] for c in df.columns if c.strip().lower() in wanted})


def pair_keys(home: str, away: str) -> dict[str, Column]:
    """Order-free pair key and whether this row lists the higher one first."""
    return {
        "pair_low": F.least(home, away),
        "pair_high": F.greatest(home, away),
        "pair_flipped": F.col(home) > F.col(away),
    }


def match_either_way(
    left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[tuple[str, str]], order: Sequence[str]
) -> DataFrame:
    """Join two tables on an unordered pair (and ``on``), the right side's home/away ``values`` being
    exchanged where its orientation differs. The right side is reduced to its first row per key
    before the join, so no pair can multiply."""
    r = right.withColumns(pair_keys("home_id", "away_id"))
    carried = [c for pair in values for c in pair]
    first = r.groupBy(*on, "pair_low", "pair_high").agg(
        F.min_by(F.struct("pair_flipped", *carried), F.struct(*order)).alias("_r")
    )
    joined = left.withColumns(pair_keys("home_id", "away_id")).join(first, [*on, "pair_low", "pair_high"], "left")
    flip = F.col("_r.pair_flipped") != F.col("pair_flipped")
    out: dict[str, Column] = {"flipped": flip}
    for h, a in values:
        out[h] = F.when(flip, F.col(f"_r.{a}")).otherwise(F.col(f"_r.{h}"))
        out[a] = F.when(flip, F.col(f"_r.{h}")).otherwise(F.col(f"_r.{a}"))
    return joined.withColumns(out).drop("_r", "pair_low", "pair_high", "pair_flipped")


def impact_with_fallback(
    wanted: DataFrame, impact: DataFrame, name: str = "member_name", value: str = "impact", group: str = "entity_id"
) -> DataFrame:
    """Value by exact name, else by a listed name that ends with the surname, else 0.

    Suffixes of the listed names are expanded (a name has few characters) so that "ends with" is an
    equality join on (group, suffix) instead of a comparison of all names of a group.
    """
    exact = impact.groupBy(group, name).agg(F.min_by(value, "listed_at").alias("_exact"))
    text = F.lower(F.col(name))
    suffix = F.explode(
        F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.length(text)))
    )
    tails = impact.select(group, "listed_at", value, suffix.alias("_tail"))
    fallback = tails.groupBy(group, "_tail").agg(F.min_by(value, "listed_at").alias("_near"))
    return (
        wanted.withColumn("_tail", F.lower(last_token(name)))
        .join(exact, [group, name], "left")
        .join(fallback, [group, "_tail"], "left")
        .withColumn(value, F.coalesce("_exact", "_near", F.lit(0.0)))
        .drop("_exact", "_near", "_tail")
    )


def fuzzy_lookup(c: str | Column, table: Mapping[str, tuple[float, float]]) -> Column:
    """Coordinates of a name: exact, else equal once punctuation is gone, else the longest known name
    that contains it or is contained in it.

    ``table`` is a small fixed dictionary; it travels as a literal array sorted by length, so the
    lookup stays a column expression. Apply it to distinct names.
    """
    c = F.col(c) if isinstance(c, str) else c
    key = fuzzy_key(c)
    entries = sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit("".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum())).alias("key"),
                F.lit(lat).alias("lat"),
                F.lit(lon).alias("lon"),
            )
            for n, (lat, lon) in entries
        ]
    )

    def first(test) -> Column:
        return F.try_element_at(F.filter(rows, test), F.lit(1))

    near = F.when(F.length(key) > 0, first(lambda r: key.contains(r["key"]) | r["key"].contains(key)))
    found = F.coalesce(first(lambda r: r["name"] == c), first(lambda r: r["key"] == key), near)
    return F.when(F.length(F.trim(c)) > 0, F.struct(found["lat"].alias("lat"), found["lon"].alias("lon"), found["name"].alias("name")))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in a declared order (limited before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
