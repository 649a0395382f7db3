"""Pool, training, prediction, backtest and ablation on two small leagues, one of two seasons only."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contestry.functions.bounded import materialise, scratch_dir
from contestry.functions.columns import PROBS
from contestry.operators import keys, logit
from contestry.plans import ablation, backtest, bundles, walkforward
from contestry.plans.features import build_features, feature_blocks
from contestry.settings import FeatureSettings, LinearSettings, ModelSettings, ScoreModelSettings, Settings, TreeSettings

SETTINGS = Settings(
    features=FeatureSettings(windows=(5, 10)),
    models=ModelSettings(
        score=ScoreModelSettings(xi_grid=(0.001, 0.003)), linear=LinearSettings(c_grid=(0.3, 1.0)),
        trees=TreeSettings(rounds=3, min_leaf=5, max_bins=8), weight_step=0.25,
    ),
)
CONTEST = (
    "match_id long, league_id long, season string, date date, home_id int, away_id int, status string, "
    "home_goals int, away_goals int, home_xg double, away_xg double, matchday int"
)


def contests(flip_last: bool = False):
    r, rows = random.Random(11), []
    for league, seasons in ((1, 4), (2, 2)):
        for s in range(seasons):
            pairs = [(h, a) for h in range(6) for a in range(6) if h != a]
            r.shuffle(pairs)
            for k, (h, a) in enumerate(pairs):
                hg, ag = min(5, int(r.expovariate(0.5 + 0.1 * h))), min(5, int(r.expovariate(0.7 + 0.1 * a)))
                if flip_last and s == seasons - 1:
                    hg, ag = ag, hg
                day = dt.date(2018 + s, 8, 1) + dt.timedelta(days=7 * (k // 3))
                rows.append((league * 1000 + s * 100 + k, league, str(2018 + s), day, h, a, "finished", hg, ag, hg + 0.2, ag + 0.1, k // 3 + 1))
    return rows


def features(spark, rows):
    base = materialise(spark.createDataFrame(rows, CONTEST))
    ratings = spark.createDataFrame([(t, dt.date(2018, 1, 1), 1400.0 + 30 * t) for t in range(6)], "team_id int, date date, rating double")
    prices = base.select(
        "match_id", F.lit("market_avg").alias("bookmaker"), (F.lit(1.5) + F.col("match_id") % 7).alias("open_h"),
        F.lit(3.4).alias("open_d"), (F.lit(1.8) + F.col("match_id") % 5).alias("open_a"),
    )
    return materialise(build_features(base, ratings, prices.filter("match_id % 9 <> 0"), SETTINGS.features, include_scheduled=True))


@pytest.fixture(scope="module")
def frame(spark):
    return features(spark, contests())


@pytest.fixture(scope="module")
def pool(frame):
    return walkforward.season_pool(frame, SETTINGS)


@pytest.fixture(scope="module")
def bundle(frame, pool):
    return walkforward.train(frame, SETTINGS, pool=pool)


def sums_to_one(df):
    return df.filter(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) > 1e-9).isEmpty()


def test_pool_holds_every_season_but_the_first(pool):
    assert sums_to_one(pool)
    n = {(r["component"], r["candidate"]): r["count"] for r in pool.groupBy("component", "candidate").count().collect()}
    assert set(n.values()) == {30 * (3 + 1)} and len(n) == 2 + 2 + 1 + 2
    assert pool.filter("season = '2018'").isEmpty()


def test_pool_of_early_seasons_does_not_see_the_last(spark, pool):
    other = walkforward.season_pool(features(spark, contests(flip_last=True)), SETTINGS, variants=(keys.NO_MARKET,))
    early = ["league_id = 1 and season < '2021' and component in ('trees_no_market', 'linear')"]
    key = ["match_id", "component", "candidate"]
    a, b = (p.filter(early[0]).select(*key, *PROBS) for p in (pool, other))
    assert a.count() == b.count() == 60 * 3
    joined = a.join(b.toDF(*key, "h", "d", "w"), key)
    assert joined.filter("abs(p_home - h) + abs(p_draw - d) + abs(p_away - w) > 1e-9").isEmpty()


def test_training_validates_a_league_of_two_seasons(bundle):
    rows = {(r["league_id"], r["model"]) for r in bundle.validation.collect()}
    assert {m for lg, m in rows if lg == 2} == {m for lg, m in rows if lg == 1} and len(rows) == 8
    final = bundle.weights.groupBy("league_id", "variant").agg(F.sum("weight").alias("w")).collect()
    assert len(final) == 4 and all(r["w"] == pytest.approx(1.0) for r in final)


def test_reloaded_bundle_predicts_the_same(spark, frame, bundle):
    folder = scratch_dir(spark)
    bundles.save(bundle, folder, "v1")
    last = frame.filter("season = '2021'")
    for variant in (keys.NO_MARKET, keys.WITH_MARKET):
        direct, again = (
            walkforward.predict(b, last, variant).select("match_id", "pred_result", "pred_score", *PROBS) for b in (bundle, bundles.load(spark, folder, "v1"))
        )
        assert sums_to_one(direct) and direct.count() == 30
        assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in again.collect()}


@pytest.mark.parametrize("refit", ["round", "season"])
def test_backtest_scores_every_model_on_every_contest(frame, pool, refit):
    out = backtest.run_backtest(frame, SETTINGS, 1, pool=pool, tree_refit=refit)
    assert sums_to_one(out)
    n = {r["model"]: r["count"] for r in out.groupBy("model").count().collect()}
    assert n == dict.fromkeys(("score_model", "linear", "trees_no_market", "trees_with_market", "ensemble_no_market", "ensemble_with_market"), 30)


def test_ablation_removes_each_block(frame):
    rows = {r["block"]: r for r in ablation.run_ablation(frame, SETTINGS, 1).collect()}
    sizes = {b: rows[b]["n_removed"] for b in feature_blocks(SETTINGS.features)}
    assert sizes == {"ratings": 6, "xg": 24, "form": 16, "rest": 2, "context": 7}
    full = rows[ablation.FULL]
    assert full["n_removed"] == 0 and full["delta"] == 0
    assert all(r["delta"] == pytest.approx(r["log_loss"] - full["log_loss"]) for r in rows.values())


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_logistic_settles_for_any_split(spark, frame, parts, monkeypatch):
    monkeypatch.setattr(logit, "MAX_PASSES", 10)
    rows = walkforward.with_linear_inputs(frame).withColumn("ord", F.col("season").cast("int"))
    cuts = spark.createDataFrame([(1, "f", 2021, 1.0)], "league_id long, fold string, cut int, c double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        fit = logit.fit_cuts(rows, cuts, walkforward.LINEAR, impute=True).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(fit["beta"]) == 3 * (len(walkforward.LINEAR) + 1)
