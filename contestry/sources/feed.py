"""Nested JSON league feeds: one document per text, contests in an inner list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys under which a feed may wrap its list, first one present wins.
ENVELOPE_KEYS = ("datesData", "matchesData", "matches", "dates")
ENTRY = (
    "struct<id:string,isResult:boolean,h:struct<title:string>,a:struct<title:string>,"
    "goals:struct<h:string,a:string>,xG:struct<h:string,a:string>,datetime:string>"
)
_LIST = f"array<{ENTRY}>"
_ENVELOPE = "struct<" + ",".join(f"{k}:{_LIST}" for k in ENVELOPE_KEYS) + ">"


def _entries(text: str) -> Column:
    listed = F.from_json(text, _LIST)
    wrapped = F.from_json(text, _ENVELOPE)
    inner = F.coalesce(*[wrapped[k] for k in ENVELOPE_KEYS])
    return F.when(F.ltrim(F.col(text)).startswith("["), listed).otherwise(inner)


def feeds_without_list(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Documents that are not JSON or hold no contest list under any known key."""
    return docs.filter(_entries("text").isNull()).select(*keep)


def parse_feed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Finished contests with both sides' expected goals; numbers may come as strings."""
    checked = F.coalesce(_entries("text"), F.raise_error(F.lit("feed without a contest list")))
    e = docs.select(*keep, F.explode(checked).alias("e")).filter(F.coalesce("e.isResult", F.lit(False)))
    return e.select(
        *keep,
        F.col("e.id").alias("feed_id"),
        F.to_timestamp("e.datetime", "yyyy-MM-dd HH:mm:ss").cast("date").alias("date"),
        F.col("e.h.title").alias("home_name"),
        F.col("e.a.title").alias("away_name"),
        F.col("e.goals.h").cast("int").alias("home_goals"),
        F.col("e.goals.a").cast("int").alias("away_goals"),
        F.col("e.xG.h").cast("double").alias("home_xg"),
        F.col("e.xG.a").cast("double").alias("away_xg"),
    )
