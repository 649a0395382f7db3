"""External rating histories: one file per club, one row per validity range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.sources.results import LayoutError


def read_rating_history(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw rows of all club files plus the club alias taken from the file name."""
    raw = spark.read.csv(paths, header=True, enforceSchema=False)
    if "Elo" not in raw.columns:
        raise LayoutError("rating history lacks the column Elo")
    return raw.withColumn(
        "file_club", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    )


def parse_rating_history(raw: DataFrame, history_start: str) -> DataFrame:
    """(club, rating, date) with date = start of validity, from `history_start` on."""
    rows = raw.select(
        F.col("Club").alias("club"),
        F.col("Elo").cast("double").alias("rating"),
        F.col("From").cast("date").alias("date"),
    )
    return rows.filter(F.col("date") >= F.lit(history_start).cast("date"))


def clubs_without_history(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected clubs whose file held no row: most often a wrong alias."""
    return expected.select("club").join(raw.select(F.col("Club").alias("club")).distinct(), "club", "left_anti")
