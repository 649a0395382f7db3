"""Hand cases, invariants and leakage checks of the relational operators."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from contestry.functions.bounded import materialise
from contestry.functions.columns import merged_tag, season_code, season_span
from contestry.operators import aggregates, form, joins, keys, odds, ratings, scenarios, score_model, stacking
from contestry.settings import FeatureSettings, LeagueSettings, RatingSettings

CONTEST = (
    "match_id string, league_id long, season string, date date, home_id string, away_id string, "
    "status string, home_goals int, away_goals int, home_xg double, away_xg double"
)


def day(n: int) -> dt.date:
    return dt.date(2018, 8, 18) + dt.timedelta(days=n)


def contests(spark, rows):
    """rows: (id, day, home, away, hg, ag)"""
    return spark.createDataFrame(
        [(i, 0, "2018-19", day(d), h, a, "finished" if hg is not None else "scheduled", hg, ag,
          None if hg is None else hg + 0.25, None if ag is None else ag + 0.5) for i, d, h, a, hg, ag in rows],
        CONTEST,
    )


def random_league(spark, n=160, seed=4, per_day=6, teams="abcde"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, a = rng.sample(teams, 2)
        played = rng.random() > 0.08
        rows.append((f"m{i:04d}", i // per_day, h, a, rng.randint(0, 3) if played else None, rng.randint(0, 3) if played else None))
    return contests(spark, rows)


def as_dict(df, key="match_id"):
    return {r[key]: r for r in df.collect()}


def test_metric_hand_cases(spark):
    df = spark.createDataFrame([("H", 0.5, 0.3, 0.2)], "result string, p_home double, p_draw double, p_away double")
    r = df.agg(*aggregates.evaluation()).first()
    assert r["brier"] == pytest.approx(0.38) and r["rps"] == pytest.approx(0.145) and r["accuracy"] == 1.0
    third = spark.createDataFrame([("D", 1 / 3, 1 / 3, 1 / 3)], df.schema)
    assert third.agg(aggregates.log_loss().alias("v")).first()["v"] == pytest.approx(math.log(3))


def test_standings_hand_case(spark):
    df = contests(spark, [("1", 0, "a", "b", 2, 0), ("2", 1, "b", "c", 1, 1), ("3", 2, "c", "a", 2, 0)])
    t = as_dict(aggregates.standings(df), "team_id")
    assert (t["a"]["points"], t["a"]["goal_diff"]) == (3, 0)
    assert (t["b"]["points"], t["b"]["goal_diff"]) == (1, -2)
    assert (t["c"]["points"], t["c"]["goal_diff"]) == (4, 2)


def test_rating_hand_case(spark):
    df = contests(spark, [("1", 0, "a", "b", 2, 0), ("2", 1, "b", "a", None, None)])
    r = as_dict(ratings.own_ratings(df, RatingSettings()))
    assert r["1"]["rating_own_home_post"] == pytest.approx(1508.290, abs=1e-3)
    assert r["1"]["rating_own_away_post"] == pytest.approx(1491.710, abs=1e-3)
    assert r["2"]["rating_own_home"] == r["1"]["rating_own_away_post"]
    assert r["2"]["rating_own_home_post"] is None


def test_rating_blocks_equal_single_chain(spark):
    df = materialise(random_league(spark, 400))
    whole = as_dict(ratings.own_ratings(df, RatingSettings()))
    cut = as_dict(ratings.own_ratings(df, RatingSettings(), block_rows=60))
    for k, r in whole.items():
        assert cut[k]["rating_own_home"] == pytest.approx(r["rating_own_home"], abs=1e-6)
        assert cut[k]["rating_own_away"] == pytest.approx(r["rating_own_away"], abs=1e-6)


def brute_streaks(rows, team):
    out, run = {}, 0
    for r in rows:
        if team not in (r["home_id"], r["away_id"]):
            continue
        out[r["match_id"]] = run
        gf, ga = (r["home_goals"], r["away_goals"]) if r["home_id"] == team else (r["away_goals"], r["home_goals"])
        if gf is not None:
            run = run + 1 if gf > ga else 0
    return out


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_streaks_and_trailing_mean_against_brute_force(spark, mode):
    df = materialise(random_league(spark))
    rows = sorted(df.collect(), key=lambda r: (r["date"], r["match_id"]))
    got = form.side_form(form.side_rows(df), (5, 10), mode=mode, bucket_rows=12).collect()
    by = {(r["match_id"], r["team"]): r for r in got}
    assert len(by) == 2 * len(rows)
    for team in "abcde":
        for m, run in brute_streaks(rows, team).items():
            assert by[(m, team)]["win_streak"] == run
        mine = [r for r in rows if team in (r["home_id"], r["away_id"])]
        for i, r in enumerate(mine):
            last = [x["home_goals"] if x["home_id"] == team else x["away_goals"] for x in mine[max(0, i - 5) : i]]
            last = [v for v in last if v is not None]
            want = sum(last) / len(last) if last else None
            assert by[(r["match_id"], team)]["goals_for_ma5"] == (pytest.approx(want) if want is not None else None)
            rest = (r["date"] - mine[i - 1]["date"]).days if i else None
            assert by[(r["match_id"], team)]["rest_days"] == rest


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_head_to_head_skips_unplayed(spark, mode):
    df = materialise(random_league(spark))
    rows = sorted(df.collect(), key=lambda r: (r["date"], r["match_id"]))
    got = as_dict(form.head_to_head(df, 5, mode=mode, bucket_rows=5))
    seen: dict = {}
    for r in rows:
        past = seen.setdefault(frozenset((r["home_id"], r["away_id"])), [])
        pts = [p[r["home_id"]] for p in past[-5:]]
        want = sum(pts) / len(pts) if pts else None
        assert got[r["match_id"]]["h2h_home_ppg"] == (pytest.approx(want) if pts else None)
        if r["home_goals"] is not None:
            d = r["home_goals"] - r["away_goals"]
            past.append({r["home_id"]: 3 if d > 0 else d == 0, r["away_id"]: 3 if d < 0 else d == 0})


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_postponed_contest_matchdays(spark, mode):
    rows = [("m1", 0, "a", "b", 1, 0), ("m2", 0, "c", "d", 1, 0), ("m3", 7, "a", "c", 1, 0),
            ("m4", 14, "a", "d", 1, 0), ("m5", 14, "b", "c", 1, 0), ("m6", 20, "b", "d", 1, 0)]
    got = as_dict(form.counted_matchdays(contests(spark, rows), mode=mode))
    assert [got[m]["matchday"] for m in ("m1", "m2", "m3", "m4", "m5", "m6")] == [1, 1, 2, 3, 3, 3]


def _features(spark, df):
    from contestry.plans.features import build_features

    log = spark.createDataFrame([("a", day(-5), 1550.0), ("a", day(3), 1558.0), ("b", day(0), 1400.0)], "team_id string, date date, rating double")
    prices = spark.createDataFrame(
        [("m0001", "bet365", 2.0, 3.0, 4.0), ("m0001", "market_avg", 2.0, None, 4.0)],
        "match_id string, bookmaker string, open_h double, open_d double, open_a double",
    )
    cfg = FeatureSettings(no_crowd_seasons=("2018-19",), derbies=(("a", "b"),))
    df = materialise(df.join(form.counted_matchdays(df), "match_id"))
    return build_features(df, log, prices, cfg, include_scheduled=True, mode="plain")


def test_features_do_not_leak(spark):
    """Changing the last contests changes no feature of an earlier one, nor their own."""
    df = materialise(random_league(spark, 60))
    cut = sorted(r["match_id"] for r in df.collect())[-6]
    later = F.col("match_id") >= cut
    changed = df.withColumns({
        "home_goals": F.when(later, F.lit(9)).otherwise(F.col("home_goals")),
        "home_xg": F.when(later, F.lit(9.5)).otherwise(F.col("home_xg")),
    })
    one, two = as_dict(_features(spark, df)), as_dict(_features(spark, changed))
    cols = keys.feature_columns(list(next(iter(one.values())).asDict()))
    assert len(cols) == 70
    for m, r in one.items():
        if m <= cut:
            assert [r[c] for c in cols] == [two[m][c] for c in cols], m


def test_as_of_is_inclusive_of_the_day_before(spark):
    df = contests(spark, [("m1", 0, "a", "b", 1, 0), ("m2", 4, "a", "b", 1, 0), ("m3", 3, "a", "b", 1, 0)])
    log = spark.createDataFrame([("a", day(-5), 1550.0), ("a", day(3), 1558.0)], "team_id string, date date, rating double")
    r = as_dict(joins.external_ratings(df, log))
    assert r["m1"]["rating_ext_home"] == 1550.0 and r["m2"]["rating_ext_home"] == 1558.0
    assert r["m3"]["rating_ext_home"] == 1550.0 and r["m1"]["rating_ext_away"] is None


def test_score_grid_hand_case(spark):
    df = spark.createDataFrame([("m", 1.2, 0.8, -0.1)], "match_id string, lam double, mu double, rho double")
    cells = {(r["hg"], r["ag"]): r["p"] for r in score_model.grid_rows(df, ["match_id"]).collect()}
    want = {(0, 0): 0.14832747, (0, 1): 0.09527604, (1, 0): 0.14941015, (1, 1): 0.14291406, (2, 1): 0.07795312}
    for k, v in want.items():
        assert cells[k] == pytest.approx(v, abs=1e-6)
    assert sum(cells.values()) == pytest.approx(1.0)
    out = score_model.with_score_columns(df, likely=True, margins=True).first()
    assert out["p_home"] + out["p_draw"] + out["p_away"] == pytest.approx(1.0)
    assert out["pred_score"] == "1-0" and out["pred_score_prob"] == pytest.approx(cells[(1, 0)])
    assert sum(out["home_margin"]) == pytest.approx(1.0) and sum(out["away_margin"]) == pytest.approx(1.0)


def test_scenarios_keep_invariants(spark):
    remaining = spark.createDataFrame(
        [(0, "s", f"r{i}", h, a, 0.5, 0.3, 0.2, [0.6, 0.4] + [0.0] * 8, [1.0] + [0.0] * 9)
         for i, (h, a) in enumerate([("a", "b"), ("c", "d"), ("a", "c")])],
        "league_id long, season string, match_id string, home_id string, away_id string, p_home double, "
        "p_draw double, p_away double, home_margin array<double>, away_margin array<double>",
    )
    played = spark.createDataFrame([(0, "s", "a", "b", 5, 0)] * 9, "league_id long, season string, home_id string, away_id string, home_goals int, away_goals int")
    teams = spark.createDataFrame([(0, "s", t) for t in "abcde"], "league_id long, season string, team_id string")
    table = scenarios.remaining_table(remaining)

    def counts(tasks):
        ranked = scenarios.ranked_scenarios(scenarios.scenario_tables(table, played, teams, 600, tasks=tasks))
        return sorted(map(tuple, scenarios.position_counts(ranked).collect()))

    rows = counts(3)
    assert rows == counts(7)  # the draw does not depend on partitioning
    by_team, by_pos = {}, {}
    for _l, _s, team, pos, n, _p in rows:
        by_team[team] = by_team.get(team, 0) + n
        by_pos[pos] = by_pos.get(pos, 0) + n
    assert set(by_team.values()) == {600} and set(by_pos.values()) == {600} and len(by_team) == 5
    leader = sum(n for _l, _s, team, pos, n, _p in rows if team == "a" and pos == 1)
    assert leader / 600 > 0.98
    share = scenarios.scenario_draws(table, 600).filter("match_id = 'r0' and outcome = 'H'").count() / 600
    assert share == pytest.approx(0.5, abs=0.08)


def test_scenarios_of_one_league_are_dealt_to_all_tasks(spark):
    """One league and one chunk of scenarios: the draws of its contests are not one task's work."""
    table = spark.range(400).selectExpr(
        "0L as league_id", "'s' as season", "id as match_id", "id % 5 as home_id", "(id + 1) % 5 as away_id", "0.5D as p_home", "0.3D as p_draw", "0.2D as p_away",
        "array(0.6D, 0.4D, 0D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) as home_margin", "array(1D, 0D, 0D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) as away_margin",
    )
    table = scenarios.remaining_table(table)
    drawn = scenarios.scenario_draws(table, 20, tasks=4)
    by_task = [r["count"] for r in drawn.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 8000 and len(by_task) == 4 and max(by_task) < 4000
    played = spark.createDataFrame([], "league_id long, season string, home_id long, away_id long, home_goals int, away_goals int")
    teams = spark.range(6).selectExpr("0L as league_id", "'s' as season", "id as team_id")
    sums = scenarios.scenario_tables(table, played, teams, 20, tasks=4)
    by_hand = {(s, t): [0, 0] for s in range(20) for t in range(6)}
    for r in drawn.collect():
        home, away = by_hand[r["sim"], r["home_id"]], by_hand[r["sim"], r["away_id"]]
        points = {"H": (3, 0), "D": (1, 1), "A": (0, 3)}[r["outcome"]]
        home[0], away[0], home[1], away[1] = home[0] + points[0], away[0] + points[1], home[1] + r["goal_diff"], away[1] - r["goal_diff"]
    assert {(r["sim"], r["team_id"]): [r["points"], r["goal_diff"]] for r in sums.collect()} == by_hand


def test_stacking_is_never_worse_than_a_component(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        res = rng.choice("HDA")
        for c, sharp in (("a", 0.5), ("b", 0.2), ("c", 0.05)):
            p = [1 / 3 - sharp / 3] * 3
            p["HDA".index(res) if rng.random() < 0.8 else rng.randrange(3)] += sharp
            rows.append((0, f"m{i}", c, res, *p))
    df = spark.createDataFrame(rows, "league_id long, match_id string, component string, result string, p_home double, p_draw double, p_away double")
    w = stacking.optimal_weights(df, ["league_id"], ("a", "b", "c")).collect()
    assert sum(r["weight"] for r in w) == pytest.approx(1.0)
    single = min(r["v"] for r in df.groupBy("component").agg(aggregates.log_loss().alias("v")).collect())
    assert w[0]["loss"] <= single + 1e-12
    assert stacking._grid_losses(stacking.true_class_probs(df, ["league_id"], ("a", "b", "c")), ["league_id"], 20, 3).count() == 231


def test_reliability_hand_case_and_edges(spark):
    df = spark.createDataFrame(
        [("H", 0.85, 0.1, 0.05), ("A", 0.85, 0.1, 0.05), ("H", 0.3, 0.6, 0.1)],
        "result string, p_home double, p_draw double, p_away double",
    )
    t = {(r["class"], r["bin"]): r for r in aggregates.reliability(df).collect()}
    assert t[("H", 8)]["n"] == 2 and t[("H", 8)]["observed"] == 0.5
    assert ("H", 2) in t and ("D", 5) in t  # 0.3 and 0.6 fall below their edges in doubles


def test_closing_price_falls_back_per_leg(spark):
    df = spark.createDataFrame(
        [("m", "market_avg", 2.0, 4.0, 4.0, 1.9, None, 4.1)],
        "match_id string, bookmaker string, open_h double, open_d double, open_a double, close_h double, close_d double, close_a double",
    )
    r = odds.closing_probabilities(df).first()
    total = 1 / 1.9 + 1 / 4.0 + 1 / 4.1
    assert r["p_draw"] == pytest.approx(0.25 / total)


def test_promotion_and_labels(spark):
    df = spark.createDataFrame(
        [("1", 0, "2018-19", "a", "b"), ("2", 0, "2019-20", "a", "c")],
        "match_id string, league_id long, season string, home_id string, away_id string",
    )
    r = as_dict(joins.promoted_flags(df))
    assert (r["1"]["promoted_home"], r["2"]["promoted_home"], r["2"]["promoted_away"]) == (0, 0, 1)
    one = spark.createDataFrame([("2018-19",)], "season string").select(season_code("season"), season_span("season")).first()
    assert tuple(one) == ("1819", "2018-2019")
    tag = spark.createDataFrame([("x+y", "y"), ("x", "y"), (None, "y")], "o string, n string")
    assert [r[0] for r in tag.select(merged_tag("o", "n")).collect()] == ["x+y", "x+y", "y"]


def test_check_suite_on_a_complete_league(spark):
    teams = "abcd"
    rows, d = [], 0
    for i, h in enumerate(teams):
        for j, a in enumerate(teams):
            if h != a:
                rows.append((f"m{i}{j}", d, h, a, 1, 0))
                d += 7
    c = contests(spark, rows)
    c = c.join(form.counted_matchdays(c), "match_id")
    side = c.select("match_id", F.lit(1.0).alias("xg")).union(c.select("match_id", F.lit(1.0)))
    log = spark.createDataFrame([(t,) for t in teams], "team_id string")
    seasons = spark.createDataFrame([(0, "2018-19"), (0, "2030-31")], "league_id long, season string")
    out = aggregates.check_suite(c, side, c.select("match_id"), log, seasons, LeagueSettings(teams_per_season=4)).collect()
    good = [r for r in out if "2030" not in r["name"]]
    assert len(good) == 9 and all(r["passed"] for r in good), good
    assert [r["passed"] for r in out if "2030" in r["name"]] == [False]
