"""Keys, labels, filters and column selections at contest grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import outcome

META_COLUMNS = (
    "match_id", "league_id", "season", "date", "as_of_date", "status", "home_id", "away_id",
    "home_goals", "away_goals", "home_xg", "away_xg", "result",
)
MARKET_COLUMNS = ("imp_home", "imp_draw", "imp_away")
WITH_MARKET = "with_market"
NO_MARKET = "no_market"

# The differences the linear component is fitted on.
LINEAR_DIFFERENCES = {
    "rating_ext_diff": ("rating_ext_home", "rating_ext_away"),
    "rating_own_diff": ("rating_own_home", "rating_own_away"),
    "ppg10_diff": ("home_points_ma10", "away_points_ma10"),
    "xg_for10_diff": ("home_xg_for_ma10", "away_xg_for_ma10"),
    "xg_against10_diff": ("home_xg_against_ma10", "away_xg_against_ma10"),
    "rest_diff": ("home_rest_days", "away_rest_days"),
}


def with_status(contests: DataFrame, include_scheduled: bool = False) -> DataFrame:
    wanted = ["finished", "scheduled"] if include_scheduled else ["finished"]
    return contests.filter(F.col("status").isin(wanted))


def with_label(contests: DataFrame) -> DataFrame:
    return contests.withColumn("result", outcome("home_goals", "away_goals"))


def with_calendar(contests: DataFrame, no_crowd_seasons: tuple[str, ...]) -> DataFrame:
    return contests.withColumns(
        {
            "as_of_date": F.date_sub("date", 1),
            "month": F.month("date"),
            "no_crowd": F.col("season").isin(list(no_crowd_seasons)).cast("int")
            if no_crowd_seasons
            else F.lit(0),
        }
    )


def unordered_pair(home="home_id", away="away_id") -> tuple[Column, Column]:
    return F.least(home, away), F.greatest(home, away)


def with_derby(contests: DataFrame, derbies: tuple[tuple, ...]) -> DataFrame:
    """1 where the unordered pairing is in the configured list."""
    if not derbies:
        return contests.withColumn("derby", F.lit(0))
    lo, hi = unordered_pair()
    hit = F.lit(False)
    for a, b in sorted({tuple(sorted(p)) for p in derbies}):
        hit = hit | ((lo == F.lit(a)) & (hi == F.lit(b)))
    return contests.withColumn("derby", hit.cast("int"))


def with_differences(frame: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Home minus away; an absent source column gives NULL."""
    have = set(frame.columns)
    return frame.withColumns(
        {
            name: (F.col(h) - F.col(a)).cast("double")
            if h in have and a in have
            else F.lit(None).cast("double")
            for name, (h, a) in pairs.items()
        }
    )


def feature_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in META_COLUMNS]


def variant_columns(columns: list[str], variant: str) -> list[str]:
    cols = feature_columns(columns)
    return cols if variant == WITH_MARKET else [c for c in cols if c not in MARKET_COLUMNS]


def split_season(season_rows: DataFrame, from_matchday: int | None) -> tuple[DataFrame, DataFrame]:
    """(played, remaining): by missing result, or by a matchday cut."""
    if from_matchday is None:
        return (
            season_rows.filter(F.col("result").isNotNull()),
            season_rows.filter(F.col("result").isNull()),
        )
    cut = F.col("matchday")
    return season_rows.filter(cut < from_matchday), season_rows.filter(cut >= from_matchday)


def variant_choice(remaining: DataFrame, keys: list[str], market_available: bool = True) -> DataFrame:
    """Market variant only where every remaining contest of the key has a price."""
    complete = F.coalesce(F.bool_and(F.col("imp_home").isNotNull()), F.lit(True))
    return remaining.groupBy(*keys).agg(
        F.when(complete & F.lit(market_available), WITH_MARKET).otherwise(NO_MARKET).alias("variant")
    )


def explode_aliases(config: DataFrame) -> DataFrame:
    """Nested alias settings to one row per (source, alias, team_id)."""
    per_source = config.select("team_id", F.explode("aliases").alias("source", "names"))
    return per_source.select("source", F.explode("names").alias("alias"), "team_id")
