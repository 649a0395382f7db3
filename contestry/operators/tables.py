"""Presentation data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import col
from contestry.operators.aggregates import with_team_names

# Display labels of the three outcomes.
OUTCOME_LABELS = {"H": "1 (local)", "D": "X (empate)", "A": "2 (visitante)"}


def outcome_label(result: Column | str) -> Column:
    r = col(result)
    out = F.lit("—")
    for key, label in OUTCOME_LABELS.items():
        out = F.when(r == key, label).otherwise(out)
    return out


def matchday_view(
    predictions: DataFrame, contests: DataFrame, teams: DataFrame, season: str, matchday: int
) -> DataFrame:
    """Predictions of one round with the known outcome and team names."""
    rows = contests.filter((F.col("season") == season) & (F.col("matchday") == matchday))
    joined = predictions.join(rows.select("match_id", "result"), "match_id")
    named = with_team_names(joined, teams, {"home_id": "home_name", "away_id": "away_name"})
    return named.withColumns(
        {"predicted": outcome_label("pred_result"), "actual": outcome_label("result")}
    )


def focus_timeline(features: DataFrame, teams: DataFrame, focus, season: str) -> DataFrame:
    """One team's contests of a season, each value taken from the side it played on."""
    rows = features.filter(
        (F.col("season") == season)
        & ((F.col("home_id") == F.lit(focus)) | (F.col("away_id") == F.lit(focus)))
    )
    at_home = F.col("home_id") == F.lit(focus)

    def pick(home: str, away: str) -> Column:
        return F.when(at_home, F.col(home)).otherwise(F.col(away))

    out = rows.select(
        "league_id",
        "match_id",
        "matchday",
        "date",
        pick("away_id", "home_id").alias("opponent_id"),
        at_home.alias("at_home"),
        pick("rating_ext_home", "rating_ext_away").alias("rating"),
        pick("home_xg", "away_xg").alias("xg_for"),
        pick("away_xg", "home_xg").alias("xg_against"),
        pick("home_points_ma5", "away_points_ma5").alias("form_points_ma5"),
    )
    return with_team_names(out, teams, {"opponent_id": "opponent"})
