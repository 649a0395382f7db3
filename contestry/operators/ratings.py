"""Own ratings: a sequential update per league, cut into blocks that run in parallel.

Each update needs the two teams' ratings after their previous contests, so a league is a chain. It is cut
into blocks of bounded size, in contest order. All blocks run from assumed start ratings; the ratings at
the block borders are then carried forward, and blocks whose start changed run again, until every border
is equal to the last bit. Block k is settled after k rounds at the latest, mostly much sooner, and the
result is that of the single chain, whatever the block size. A league of one block has no border. A task reads
its block as a stream in contest order and holds the teams' ratings only.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.bounded import materialise
from contestry.settings import RatingSettings

BLOCK_ROWS = 1_000_000
POSTS = ("rating_own_home_post", "rating_own_away_post")
RATINGS = ("rating_own_home", "rating_own_away", *POSTS)
_BLOCK = ["league_id", "block"]


def chained(batches: Iterator[pa.RecordBatch], cfg: RatingSettings, ends: bool) -> Iterator[pa.RecordBatch]:
    """Ratings before and after each contest, or with `ends` each block's last ratings of the teams that met in it.

    Rows come block after block: first what is known of teams (home_id, rating), then the contests in order. A
    contest without goals changes nothing and has no ratings after it. Only the teams' ratings are held."""
    here, level, met = None, {}, set()
    types: dict[str, pa.DataType] = {}

    def last() -> pa.RecordBatch:
        head = {"league_id": [here[0]] * len(met), "block": [here[1]] * len(met), "home_id": list(met)}
        arrays = [pa.array(v, types[c]) for c, v in head.items()]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([level[t] for t in met], pa.float64())], names=["league_id", "block", "team_id", "rating"])

    for b in batches:
        types = types or {f.name: f.type for f in b.schema}
        out = array("d")
        lists = (b.column(c).to_pylist() for c in (*_BLOCK, "contest", "home_id", "away_id", "home_goals", "away_goals", "rating"))
        for league, block, contest, home, away, home_goals, away_goals, rating in zip(*lists, strict=True):
            if here != (league, block):
                if ends and met:
                    yield last()
                here, level, met = (league, block), {}, set()
            if not contest:
                level[home] = rating
                continue
            before = level.setdefault(home, cfg.initial), level.setdefault(away, cfg.initial)
            margin = np.nan if home_goals is None or away_goals is None else home_goals - away_goals
            after = (np.nan, np.nan)
            if margin == margin:
                gap = before[0] + cfg.home_advantage - before[1]
                won = 1.0 if margin > 0 else 0.5 if margin == 0 else 0.0
                gain = cfg.k * (won - 1.0 / (1.0 + 10.0 ** (-gap / 400.0)))
                after = before[0] + gain, before[1] - gain
                level[home], level[away] = after
            if ends:
                met.update((home, away))
            else:
                out.extend((*before, *after))
        if not ends:
            found = b.filter(b.column("contest"))
            values = np.array(out, float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([found.column("league_id"), found.column("match_id"), *map(pa.array, values.T.copy())], names=["league_id", "match_id", *RATINGS])
    if ends and met:
        yield last()


def with_blocks(contests: DataFrame, block_rows: int) -> DataFrame:
    """Block number per contest: the league's contests before it, divided by the block size; a day may be cut."""
    daily = contests.groupBy("league_id", "date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("league_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    upto = daily.select("league_id", "date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    of_day = F.row_number().over(Window.partitionBy("league_id", "date").orderBy("match_id")) - 1
    placed = contests.withColumn("__day", of_day).join(upto, ["league_id", "date"])
    return placed.withColumn("block", F.floor((F.col("__before") + F.col("__day")) / block_rows).cast("int")).drop("__before", "__day")


def own_ratings(contests: DataFrame, cfg: RatingSettings, block_rows: int = BLOCK_ROWS, start: DataFrame | None = None) -> DataFrame:
    """Ratings before and after every contest; unplayed contests get the ratings before only.

    `start` (league_id, team_id, rating): ratings known before the first contest."""
    need = contests.select("league_id", "match_id", "date", "home_id", "away_id", "home_goals", "away_goals")
    match_type, team_type = (contests.schema[c].dataType.simpleString() for c in ("match_id", "home_id"))
    out_schema = f"league_id bigint, match_id {match_type}, {', '.join(f'{c} double' for c in RATINGS)}"
    state_schema = f"league_id bigint, block int, team_id {team_type}, rating double"
    spark = contests.sparkSession
    first = start if start is not None else spark.createDataFrame([], "league_id bigint, team_id int, rating double")
    first = first.select("league_id", F.lit(0).alias("block"), F.col("team_id").cast(team_type).alias("team_id"), "rating")

    def run(rows: DataFrame, known: DataFrame | None, ends: bool = False) -> DataFrame:
        """Streams each block through a task in order, its start ratings first, whatever its size."""
        both = rows.select(*_BLOCK, F.lit(True).alias("contest"), *need.columns[1:], F.lit(None).cast("double").alias("rating"))
        if known is not None:
            both = both.unionByName(known.select(*_BLOCK, F.lit(False).alias("contest"), F.col("team_id").alias("home_id"), "rating"), allowMissingColumns=True)
        inside = ["contest", F.asc_nulls_last("date"), F.asc_nulls_last("match_id")]
        dealt = both.withColumn("league_id", F.col("league_id").cast("bigint")).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, *inside)
        return dealt.mapInArrow(lambda batches: chained(batches, cfg, ends), state_schema if ends else out_schema)

    def told(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in POSTS})

    largest = need.groupBy("league_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= block_rows and start is None:  # one block a league, so no border to settle
        return told(run(need.withColumn("block", F.lit(0)), None))
    if largest <= block_rows:
        return told(run(need.withColumn("block", F.lit(0)), first))
    blocked = materialise(with_blocks(need, block_rows))
    blocks = materialise(blocked.select(*_BLOCK).distinct())
    teams = blocked.select("league_id", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    grid = materialise(blocks.join(teams.union(first.select("league_id", "team_id")).distinct(), "league_id"))
    finals = materialise(run(blocked, first, ends=True))
    known = first
    order = Window.partitionBy("league_id", "team_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        left = grid.join(finals, [*_BLOCK, "team_id"], "left")
        base = first.select("league_id", "team_id", F.col("rating").alias("__first"))
        carried = left.withColumn("rating", F.last("rating", ignorenulls=True).over(order)).join(base, ["league_id", "team_id"], "left")
        carried = carried.select(*_BLOCK, "team_id", F.coalesce("rating", "__first").alias("rating")).filter("rating is not null")
        new = materialise(carried)
        old = known.withColumnRenamed("rating", "__old")
        moved = new.join(old, [*_BLOCK, "team_id"], "left").filter("not (rating <=> __old)")
        todo = materialise(moved.select(*_BLOCK).distinct())
        known = new
        if todo.isEmpty():
            return told(run(blocked, known))
        again = run(blocked.join(todo, _BLOCK, "left_semi"), known.join(todo, _BLOCK, "left_semi"), ends=True)
        finals = materialise(finals.join(todo, _BLOCK, "left_anti").unionByName(again))


def rating_log(contests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings after each contest as log rows, two per played contest, rounded for storage.

    `rating_kind` keeps them apart from external ratings of the same day.
    """
    dated = contests.select("match_id", "date", "home_id", "away_id").join(ratings, "match_id")
    rows = dated.filter(F.col("rating_own_home_post").isNotNull()).select(
        "league_id", "match_id", "date",
        F.inline(
            F.array(
                F.struct(F.col("home_id").alias("team_id"), F.col("rating_own_home_post").alias("r")),
                F.struct(F.col("away_id").alias("team_id"), F.col("rating_own_away_post").alias("r")),
            )
        ),
    )
    return rows.select(
        "league_id", "team_id", "date", "match_id", F.round("r", 2).alias("rating"), F.lit("own").alias("rating_kind")
    )


def latest_of_day(log: DataFrame) -> DataFrame:
    """One row per (league, team, date): the last contest of the day decides."""
    return log.groupBy("league_id", "team_id", "date", "rating_kind").agg(
        F.max_by("rating", "match_id").alias("rating")
    )
