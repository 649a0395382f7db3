"""Schedule pages: HTML rows to typed contests, and the choice of an archived snapshot."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the page layout.
TABLE = r'(?is)<table[^>]*\bid="sched[^"]*"[^>]*>(.*?)</table>'
BODY = r"(?is)<tbody[^>]*>(.*?)</tbody>"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r'(?is)<t[dh]\b[^>]*\bdata-stat="{name}"[^>]*>(.*?)</t[dh]>'
TAG = r"(?s)<[^>]+>"
SCORE = r"^(\d+)\s*[–-]\s*(\d+)$"
STAMP = r"^\d{14}$"
LINK = r'(?is)<a\b[^>]*\bhref="([^"]*)"'
HEADING = r"(?is)<h1\b[^>]*>(.*?)</h1>"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(_html.unescape, na_action="ignore")


def _cell(name: str) -> Column:
    inner = F.regexp_extract("row", CELL.format(name=name), 1)
    return F.trim(F.regexp_replace(inner, TAG, ""))


def schedule_rows(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Every table row of every schedule page as text cells."""
    body = F.regexp_extract(F.regexp_extract("html", TABLE, 1), BODY, 1)
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(body, F.lit(ROW), 1)).alias("row"))
    names = ("gameweek", "date", "home_team", "away_team", "score", "home_xg", "away_xg")
    return rows.select(*keep, *[_cell(n).alias(n) for n in names])


def parse_schedule(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Played contests of the schedule pages; an odd score stops the job."""
    cells = schedule_rows(pages, keep).filter((F.col("home_team") != "") & (F.col("score") != ""))
    score = F.col("score")
    ok = score.rlike(SCORE)

    def goals(group: int) -> Column:
        return F.when(ok, F.regexp_extract(score, SCORE, group).cast("int")).otherwise(
            F.raise_error(F.concat(F.lit("odd schedule score: "), score)).cast("string").cast("int")
        )

    def number(name: str, kind: str) -> Column:
        return F.when(F.col(name) != "", F.col(name).cast(kind))

    return cells.select(
        *keep,
        number("gameweek", "int").alias("matchday"),
        F.col("date").cast("date").alias("date"),
        _unescape("home_team").alias("home_name"),
        _unescape("away_team").alias("away_name"),
        goals(1).alias("home_goals"),
        goals(2).alias("away_goals"),
        number("home_xg", "double").alias("home_xg"),
        number("away_xg", "double").alias("away_xg"),
    )


def pages_without_schedule(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Pages whose layout changed: no schedule table with a body."""
    return pages.filter(F.regexp_extract("html", TABLE, 1) == "").select(*keep)


def page_links(pages: DataFrame) -> DataFrame:
    """Link targets in page order, by the same whole-text scan the schedule uses."""
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("pos", "href")
    )


def read_stamps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return snapshot_stamps(spark.read.text(paths))


def snapshot_stamps(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct 14-digit stamps of an archive index listing."""
    return (
        lines.select(*keep, F.trim("value").alias("stamp"))
        .filter(F.col("stamp").rlike(STAMP))
        .distinct()
    )


def newest_stamps(stamps: DataFrame, n: int | None = None) -> DataFrame:
    """Stamps from the newest on; all of them unless `n` is given."""
    ordered = stamps.orderBy(F.desc("stamp"))
    return ordered if n is None else ordered.limit(n)


def best_snapshot(snapshots: DataFrame, keys: list[str], newest: int | None = None) -> DataFrame:
    """Per key the newest complete snapshot, else the newest usable one; of the `newest` ones if given."""
    tried = snapshots
    if newest is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc("stamp"))
        tried = snapshots.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest)
    return (
        tried.filter("usable")
        .groupBy(*keys)
        .agg(F.max(F.struct("has_xg", "stamp")).alias("best"))
        .select(*keys, "best.stamp", "best.has_xg")
    )
