"""Ratings in blocks equal the chain to the bit; incremental ratings equal the batch job, however rows arrive."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contestry.functions.bounded import scratch_dir
from contestry.operators import ratings
from contestry.operators.ratings import RATINGS, own_ratings
from contestry.settings import RatingSettings
from contestry.streaming.ratings import RatingTables

SCHEMA = "league_id long, match_id long, date date, home_id int, away_id int, home_goals int, away_goals int"
CFG = RatingSettings()


def contests(n: int = 300, seed: int = 1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        home, away = r.sample(range(8), 2)
        goals = (None, None) if r.random() < 0.05 else (r.randrange(4), r.randrange(4))
        out.append((1 + k % 2, k, date(2020, 1, 1) + timedelta(days=r.randrange(700)), home, away, *goals))
    return out


def as_set(df):
    return {tuple(r) for r in df.select("league_id", "match_id", *RATINGS).collect()}


def test_blocks_equal_the_chain_to_the_bit(spark):
    df = spark.createDataFrame([(lg, m, date(2020, 1, 1 + m % 3), h, a, x, y) for lg, m, _, h, a, x, y in contests()], SCHEMA)
    whole = as_set(own_ratings(df, CFG))
    assert whole == as_set(own_ratings(df, CFG, block_rows=40)) and len(whole) == 300


def test_start_continues_a_chain(spark):
    df = spark.createDataFrame(contests(), SCHEMA)
    cut = date(2021, 1, 1)
    sides = [F.struct(F.col(f"{s}_id").alias("team_id"), F.col(f"rating_own_{s}_post").alias("r")) for s in ("home", "away")]
    early = own_ratings(df, CFG).join(df.filter(F.col("date") < F.lit(cut)), ["league_id", "match_id"])
    start = early.select("league_id", "date", "match_id", F.inline(F.array(*sides))).filter("r is not null")
    start = start.groupBy("league_id", "team_id").agg(F.max_by("r", F.struct("date", "match_id")).alias("rating"))
    late = df.filter(F.col("date") >= F.lit(cut))
    want = {r for r in as_set(own_ratings(df, CFG)) if r[1] in {x["match_id"] for x in late.select("match_id").collect()}}
    for size in (25, 10_000):
        assert as_set(own_ratings(late, CFG, block_rows=size, start=start)) == want


@pytest.mark.parametrize("seed", [1])
def test_out_of_order_batches_equal_the_batch_job(spark, seed):
    rows = contests(160, seed)
    r = random.Random(seed)
    r.shuffle(rows)
    batches = [rows[:60], rows[60:61], rows[61:150], rows[150:]]
    state = RatingTables(spark, scratch_dir(spark), spark.createDataFrame([], SCHEMA).schema)
    for k, batch in enumerate(batches):
        state.apply(spark.createDataFrame(batch, SCHEMA), CFG, tag=f"batch{k}")
    state.apply(spark.createDataFrame(batches[1], SCHEMA), CFG, tag="batch1")  # delivered again
    assert as_set(state.ratings.read()) == as_set(own_ratings(spark.createDataFrame(rows, SCHEMA), CFG))
    # a corrected result, and a contest moved to another quarter
    lg, m, day, h, a, x, y = rows[3]
    fixed = [(lg, m, day + timedelta(days=200), h, a, 9, 0), (*rows[4][:5], 0, 9)]
    state.apply(spark.createDataFrame(fixed, SCHEMA), CFG, tag="batch9")
    now = fixed + [x for x in rows if x[1] not in (fixed[0][1], fixed[1][1])]
    assert as_set(state.ratings.read()) == as_set(own_ratings(spark.createDataFrame(now, SCHEMA), CFG))


@pytest.mark.parametrize("ends", [False, True])
def test_a_task_holds_no_more_than_one_batch_of_a_block(ends):
    pulled = []

    def batches():
        for k in range(50):
            pulled.append(k)
            one = {"league_id": k // 25, "block": 0, "contest": True, "match_id": k, "home_id": 1, "away_id": 2, "home_goals": 1, "away_goals": 0, "rating": None}
            yield pa.RecordBatch.from_pylist([one])

    first = next(ratings.chained(batches(), CFG, ends))
    assert first.num_rows == (2 if ends else 1) and len(pulled) == (26 if ends else 1)


def test_days_without_date_come_last_and_block_starts_first(spark):
    rows = [(1, 1, None, 3, 4, 2, 0), (1, 2, date(2020, 1, 1), 3, 4, 0, 1), (1, 3, date(2020, 1, 2), 3, 4, None, None)]
    start = spark.createDataFrame([(1, 3, 1700.0), (2, 3, 9.0)], "league_id long, team_id int, rating double")
    got = {r["match_id"]: r for r in own_ratings(spark.createDataFrame(rows, SCHEMA), CFG, start=start).collect()}
    assert got[2]["rating_own_home"] == 1700.0 and got[2]["rating_own_away"] == CFG.initial
    assert got[3]["rating_own_home"] == got[2]["rating_own_home_post"] == got[1]["rating_own_home"] and got[3]["rating_own_home_post"] is None
