"""Ordering, limits, arg-min choices and repeatable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.columns import col


def next_matchday(contests: DataFrame, season: str) -> DataFrame:
    """All contests of each league's earliest scheduled matchday in the season."""
    open_rows = contests.filter((F.col("season") == season) & (F.col("status") == "scheduled"))
    first = open_rows.groupBy("league_id").agg(F.min("matchday").alias("matchday"))
    return open_rows.join(first, ["league_id", "matchday"])


def available_matchdays(contests: DataFrame, season: str) -> DataFrame:
    rows = contests.filter((F.col("season") == season) & F.col("matchday").isNotNull())
    return rows.select("league_id", "matchday").distinct()


def best_candidate(losses: DataFrame, keys: list[str], candidate: str, ordinal: str, loss: str) -> DataFrame:
    """Candidate with the lowest loss; the first in ordinal order wins a tie."""
    agg = F.min_by(F.struct(candidate, loss), F.struct(loss, ordinal)).alias("best")
    best = losses.groupBy(*keys).agg(agg) if keys else losses.agg(agg)
    return best.select(*keys, f"best.{candidate}", f"best.{loss}")


def weakest_teams(params: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The n teams of lowest attack plus defence per fit."""
    w = Window.partitionBy(*keys).orderBy(F.col("attack") + F.col("defence"), "team_id")
    return params.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_rows(frame: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return frame.orderBy(F.desc(by), tie).limit(n)


def seeded_sample(frame: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, the same ones on every run and partitioning."""
    return frame.orderBy(F.md5(F.concat_ws("|", F.lit(seed), col(key))), key).limit(n)


def chronological(frame: DataFrame) -> DataFrame:
    """Position of each contest in its league's (date, match_id) order, without a global sort."""
    from contestry.functions.bounded import dense_position

    rows = dense_position(frame.withColumn("__one", F.lit(1)), ["league_id"], "date", "match_id", {"__before": "__one"})
    return rows.withColumn("position", F.col("__before") + 1).drop("__one", "__before")
