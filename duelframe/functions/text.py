"""Text and parsing expressions: all native columns, no UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F, types as T

# fixed values: order of named rounds after the numbered ones; anything else sorts before them
ROUND_ORDER = (("qualif", 100), ("elim", 101), ("semi", 102), ("prelim", 103), ("grand", 104))
UNKNOWN_ROUND = 99
# fixed values: words that mark a finals round, and an elimination round
FINALS_WORDS = ("final", "qualif", "elim", "semi", "prelim", "grand")
ELIMINATION_WORDS = ("qualifying", "eliminat", "semi", "prelim")
# fixed values: accepted shapes of a date once the ordinal suffix is gone and the year appended
DAY_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "d/M/yyyy", "yyyy-M-d")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(c: str | Column) -> Column:
    """Trimmed lower-case text, the form names are compared in."""
    return F.lower(F.trim(_col(c)))


def fuzzy_key(c: str | Column) -> Column:
    """Only lower-case letters and digits."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def has_any(c: str | Column, words: Sequence[str]) -> Column:
    """Case-insensitive containment of any of the words."""
    return F.lower(_col(c)).rlike("|".join(words))


def last_token(c: str | Column) -> Column:
    """Last blank-separated word."""
    return F.element_at(F.split(F.trim(_col(c)), r"\s+"), -1)


def composite_key(*parts: str | Column) -> Column:
    """``year_rROUND_home_v_away``."""
    year, rnd, home, away = (_col(p).cast("string") for p in parts)
    return F.concat(year, F.lit("_r"), rnd, F.lit("_"), home, F.lit("_v_"), away)


def slug(c: str | Column) -> Column:
    """Lower case, dots dropped, blanks to one hyphen."""
    plain = F.regexp_replace(folded(c), r"\.", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), "-+", "-")


def snake(c: str | Column) -> Column:
    """camelCase to snake_case."""
    once = F.regexp_replace(_col(c), "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(once, "([a-z0-9])([A-Z])", "$1_$2"))


def lenient_int(c: str | Column) -> Column:
    """Integer from text such as ``1,234``, ``+25`` or ``-`` (0); NULL if it is no number."""
    text = F.regexp_replace(F.trim(_col(c)), "[,+]", "")
    return F.when(text.isin("-", ""), F.lit(0)).otherwise(text.try_cast("int"))


def round_sort_key(c: str | Column) -> Column:
    """Numbered rounds by number, named rounds after them, unknown labels in between."""
    label = folded(c)
    named = [F.when(label.contains(word), F.lit(rank)) for word, rank in ROUND_ORDER]
    return F.coalesce(_col(c).try_cast("int"), *named, F.lit(UNKNOWN_ROUND))


def ordinal_date(c: str | Column, year: str | Column) -> Column:
    """Date from ``2nd March`` (the year is appended unless the text has one), by the known shapes."""
    plain = F.regexp_replace(F.trim(_col(c)), r"(\d+)(st|nd|rd|th)\b", "$1")
    dated = F.when(plain.rlike(r"\d{4}"), plain).otherwise(F.concat_ws(" ", plain, _col(year).cast("string")))
    return F.coalesce(*[F.try_to_timestamp(dated, F.lit(f)) for f in DAY_FORMATS]).cast("date")


def twelve_hour(c: str | Column, strict: bool = True) -> Column:
    """Hour of ``h:mm AM/PM``; with ``strict`` off 24-hour text is read as well."""
    text = F.upper(F.trim(_col(c)))
    hour = F.regexp_extract(text, r"^(\d{1,2})", 1).try_cast("int")
    pm, am = text.contains("PM"), text.contains("AM")
    clock = F.when(pm & (hour != 12), hour + 12).when(am & (hour == 12), F.lit(0)).when(pm | am, hour)
    return clock if strict else clock.otherwise(F.when(text.rlike(r"^\d{1,2}:\d{2}$"), hour))


def first_known(*columns: str | Column) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in columns])


def looked_up(c: str | Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    pairs: list[Column] = []
    for key, value in table.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def name_counts(c: str | Column) -> Column:
    """``A Smith (2), B Jones`` as an array of (name, count) structs; a missing count is one."""
    parts = F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.trim(F.regexp_replace(x, r"\s*\(\d+\)\s*$", "")).alias("name"),
            F.coalesce(F.regexp_extract(x, r"\((\d+)\)\s*$", 1).try_cast("int"), F.lit(1)).alias("count"),
        ),
    )


def split_fixture(c: str | Column) -> dict[str, Column]:
    """Parts of ``A v B (YYYY-MM-DD HH:MM)``."""
    teams = F.split(F.element_at(F.split(_col(c), r" \("), 1), " v ")
    return {
        "home_name": F.try_element_at(teams, F.lit(1)),
        "away_name": F.try_element_at(teams, F.lit(2)),
        "kickoff": F.try_to_timestamp(F.regexp_extract(_col(c), r"\((\d{4}-\d{2}-\d{2} \d{2}:\d{2})\)", 1), F.lit("yyyy-MM-dd HH:mm")),
    }


def numeric_groups(schema: T.StructType, groups: Mapping[str, Sequence[str]], skip: Sequence[str] = ()) -> dict[str, str]:
    """Numeric columns whose name contains a group's word, by declared type and name only."""
    out: dict[str, str] = {}
    for field in schema:
        if not isinstance(field.dataType, T.NumericType) or field.name in skip:
            continue
        for group, words in groups.items():
            if any(w in field.name.lower() for w in words):
                out.setdefault(field.name, group)
    return out
