"""Turning one row per event into one row per participant, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def to_sides(
    matches: DataFrame,
    common: Sequence[str],
    paired: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Two rows per event, ``side`` being ``home`` or ``away``.

    ``paired`` maps an output column to its (home view, away view) source expressions, so that
    ``{"points_for": ("home_score", "away_score")}`` reads the own score on both rows. It is a
    narrow ``explode``: no shuffle, one scan.
    """

    def view(side: str, at: int) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            *[F.expr(pair[at]).alias(name) for name, pair in paired.items()],
        )

    return matches.select(*common, F.explode(F.array(view("home", 0), view("away", 1))).alias("_s")).select(
        *common, "_s.*"
    )


PARTICIPANTS = {
    "entity_id": ("home_id", "away_id"),
    "opponent_id": ("away_id", "home_id"),
    "points_for": ("home_score", "away_score"),
    "points_against": ("away_score", "home_score"),
}


def team_log(matches: DataFrame, common: Sequence[str] = ("match_id", "event_date"), **extra: tuple[str, str]) -> DataFrame:
    """The participant log used by the look-back operators, with ``margin`` and ``result``.

    ``result`` is 1, 0.5 or 0, and NULL for an event without a score.
    """
    log = to_sides(matches, common, {**PARTICIPANTS, **extra})
    margin = F.col("points_for") - F.col("points_against")
    return log.withColumns(
        {
            "margin": margin,
            "result": F.when(margin > 0, 1.0).when(margin == 0, 0.5).when(margin < 0, 0.0),
        }
    )


def from_sides(
    log: DataFrame,
    values: Sequence[str],
    key: str | Sequence[str] = "match_id",
    differences: Mapping[str, str] | None = None,
) -> DataFrame:
    """Back to one row per event: ``home_x``, ``away_x`` and the named differences.

    One hash aggregate on the event key; ``differences`` maps an output name to the measure whose
    home-minus-away difference it holds.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wide = log.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{side}_{v}")
            for side in ("home", "away")
            for v in values
        ]
    )
    if differences:
        wide = wide.withColumns(
            {name: F.col(f"home_{v}") - F.col(f"away_{v}") for name, v in differences.items()}
        )
    return wide
