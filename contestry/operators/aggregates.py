"""Tables, coverage checks, probability scores and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.columns import (
    OUTCOMES,
    PROBS,
    col,
    first_argmax,
    indicator,
    prob_of,
)
from contestry.settings import LeagueSettings

_LOG_FLOOR = 1e-15


# --- tables ------------------------------------------------------------------------------------


def standings(played: DataFrame, keys: tuple[str, ...] = ("league_id", "season")) -> DataFrame:
    """Points 3/1/0, goal difference and contests played per team."""
    gd = F.col("home_goals") - F.col("away_goals")
    home_pts = F.when(gd > 0, 3).when(gd == 0, 1).otherwise(0)
    away_pts = F.when(gd < 0, 3).when(gd == 0, 1).otherwise(0)
    sides = played.filter(gd.isNotNull()).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("home_id").alias("team_id"), home_pts.alias("p"), gd.alias("g")),
                F.struct(F.col("away_id").alias("team_id"), away_pts.alias("p"), (-gd).alias("g")),
            )
        ),
    )
    return sides.groupBy(*keys, "team_id").agg(
        F.count("*").alias("played"), F.sum("p").alias("points"), F.sum("g").alias("goal_diff")
    )


def ranked_standings(played: DataFrame, keys: tuple[str, ...] = ("league_id", "season")) -> DataFrame:
    table = standings(played, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc("goal_diff"), "team_id")
    return table.withColumn("pos", F.row_number().over(w))


def with_team_names(rows: DataFrame, teams: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a display name per id column; an unknown id shows as itself."""
    out = rows
    for id_col, target in columns.items():
        names = teams.select(F.col("team_id").alias(id_col), F.col("name").alias("__name"))
        out = (
            out.join(names, id_col, "left")
            .withColumn(target, F.coalesce(F.col("__name"), F.col(id_col).cast("string")))
            .drop("__name")
        )
    return out


# --- coverage and checks -----------------------------------------------------------------------


def _sides(contests: DataFrame) -> DataFrame:
    return contests.select("league_id", "season", F.explode(F.array("home_id", "away_id")).alias("team_id"))


def teams_per_season(contests: DataFrame) -> DataFrame:
    distinct = _sides(contests).distinct()
    return distinct.groupBy("league_id", "season").agg(F.count("*").alias("n_teams"))


def off_schedule_teams(contests: DataFrame, expected: int) -> DataFrame:
    """Teams whose number of contests in a season is not the expected one."""
    counts = _sides(contests).groupBy("league_id", "season", "team_id").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") != expected)


def value_checks(contests: DataFrame, rounds: int) -> DataFrame:
    """Missing goals, matchdays out of range and implausible scores in one pass."""
    h, a, md = F.col("home_goals"), F.col("away_goals"), F.col("matchday")
    return contests.groupBy("league_id", "season").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("status") == "finished") & (h.isNull() | a.isNull())).alias("null_goals"),
        F.count_if(md.isNull() | (md < 1) | (md > rounds)).alias("bad_matchday"),
        F.count_if((h < 0) | (a < 0) | (h > 15) | (a > 15)).alias("weird_scores"),
    )


def coverage(contests: DataFrame, side_stats: DataFrame, odds: DataFrame) -> DataFrame:
    """Per season: side rows with expected goals, contests with both, contests with any price."""
    xg = side_stats.groupBy("match_id").agg(F.count("xg").alias("xg_rows"))
    priced = odds.select("match_id").distinct().withColumn("priced", F.lit(1))
    joined = contests.select("match_id", "league_id", "season").join(xg, "match_id", "left").join(
        priced, "match_id", "left"
    )
    return joined.groupBy("league_id", "season").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("xg_rows"), F.lit(0)).alias("xg_rows"),
        F.count_if(F.col("xg_rows") == 2).alias("xg_contests"),
        F.count("priced").alias("odds_contests"),
    )


def check_suite(
    contests: DataFrame,
    side_stats: DataFrame,
    odds: DataFrame,
    ratings: DataFrame,
    seasons: DataFrame,
    league: LeagueSettings,
) -> DataFrame:
    """Every integrity check as (name, passed, detail) rows.

    `seasons` lists the expected (league_id, season) pairs; a season without contests yields
    only its count check.
    """
    key = ["league_id", "season"]
    n_exp, r_exp, t_exp = league.contests_per_season, league.rounds, league.teams_per_season
    off = off_schedule_teams(contests, r_exp).groupBy(*key).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("team_id", "n"))),
                lambda s: F.concat_ws("=", s["team_id"], s["n"]),
            ),
            ", ",
        ).alias("off_teams")
    )
    summary = (
        seasons.join(value_checks(contests, r_exp), key, "left")
        .join(teams_per_season(contests), key, "left")
        .join(off, key, "left")
        .join(coverage(contests, side_stats, odds).drop("n"), key, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )

    def check(name: str, passed: Column, detail: Column, always: bool = False) -> Column:
        row = F.struct(
            F.concat(F.lit("["), F.col("season"), F.lit(f"] {name}")).alias("name"),
            passed.alias("passed"),
            detail.cast("string").alias("detail"),
        )
        return row if always else F.when(F.col("n") > 0, row)

    def of(have: str, want) -> Column:
        return F.concat_ws("/", F.col(have), col(want) if isinstance(want, str) else F.lit(want))

    per_season = summary.withColumn("n2", 2 * F.col("n")).select(
        "league_id",
        F.explode(
            F.filter(
                F.array(
                    check("contests", F.col("n") == n_exp, of("n", n_exp), always=True),
                    check("teams", F.col("n_teams") == t_exp, of("n_teams", t_exp)),
                    check(
                        "contests per team",
                        F.col("off_teams").isNull(),
                        F.coalesce("off_teams", F.lit(f"all play {r_exp}")),
                    ),
                    check(
                        "goals known",
                        F.col("null_goals") == 0,
                        F.concat(F.col("null_goals"), F.lit(" rows with NULL")),
                    ),
                    check(
                        f"matchdays within 1-{r_exp}",
                        F.col("bad_matchday") == 0,
                        F.concat(F.col("bad_matchday"), F.lit(" out of range")),
                    ),
                    check("xg coverage", F.col("xg_rows") == F.col("n2"), of("xg_rows", "n2")),
                    check("odds coverage", F.col("odds_contests") == F.col("n"), of("odds_contests", "n")),
                ),
                lambda r: r.isNotNull(),
            )
        ).alias("c"),
    ).select("league_id", "c.name", "c.passed", "c.detail")

    from contestry.operators.joins import teams_without_rating

    unrated = teams_without_rating(contests, ratings).agg(
        F.sort_array(F.collect_set(F.col("team_id").cast("string"))).alias("t")
    )
    unrated_row = unrated.select(
        F.lit(None).cast("long").alias("league_id"),
        F.lit("[all] rating for every team").alias("name"),
        (F.size("t") == 0).alias("passed"),
        F.when(F.size("t") == 0, "ok")
        .otherwise(F.concat(F.lit("unrated: "), F.array_join("t", ", ")))
        .alias("detail"),
    )
    weird = contests.agg(
        F.count_if(
            (F.col("home_goals") < 0) | (F.col("away_goals") < 0)
            | (F.col("home_goals") > 15) | (F.col("away_goals") > 15)
        ).alias("n")
    ).select(
        F.lit(None).cast("long").alias("league_id"),
        F.lit("[all] plausible scores").alias("name"),
        (F.col("n") == 0).alias("passed"),
        F.concat(F.col("n"), F.lit(" suspicious")).alias("detail"),
    )
    return per_season.unionByName(unrated_row).unionByName(weird)


def result_mismatches(results: DataFrame) -> DataFrame:
    """Rows whose own result letter contradicts their goals."""
    from contestry.functions.columns import outcome

    return results.filter(~F.col("file_result").eqNullSafe(outcome("home_goals", "away_goals")))


# --- probability scores ------------------------------------------------------------------------


def log_loss(result="result", probs=PROBS) -> Column:
    return F.avg(-F.ln(F.greatest(prob_of(result, *probs), F.lit(_LOG_FLOOR))))


def brier(result="result", probs=PROBS) -> Column:
    terms = [(col(p) - indicator(result, o)) ** 2 for p, o in zip(probs, OUTCOMES, strict=True)]
    return F.avg(terms[0] + terms[1] + terms[2])


def ranked_probability(result="result", probs=PROBS) -> Column:
    first = col(probs[0]) - indicator(result, "H")
    second = first + col(probs[1]) - indicator(result, "D")
    return F.avg((first**2 + second**2) / 2)


def accuracy(result="result", probs=PROBS) -> Column:
    return F.avg((first_argmax(*probs) == col(result)).cast("double"))


def evaluation(result="result", probs=PROBS) -> list[Column]:
    return [
        log_loss(result, probs).alias("log_loss"),
        brier(result, probs).alias("brier"),
        ranked_probability(result, probs).alias("rps"),
        accuracy(result, probs).alias("accuracy"),
    ]


def evaluate(predictions: DataFrame, keys: list[str]) -> DataFrame:
    known = predictions.filter(F.col("result").isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), *evaluation())


def focus_evaluation(predictions: DataFrame, keys: list[str], focus) -> DataFrame:
    """Scores per key plus accuracy and count on one team's contests."""
    is_focus = (F.col("home_id") == F.lit(focus)) | (F.col("away_id") == F.lit(focus))
    hit = (first_argmax() == F.col("result")).cast("double")
    return (
        predictions.filter(F.col("result").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            *evaluation(),
            F.avg(F.when(is_focus, hit)).alias("focus_accuracy"),
            F.count_if(is_focus).alias("focus_n"),
        )
    )


def mean_of_seasons(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted mean of the season scores (not a pooled mean)."""
    names = ("log_loss", "brier", "rps", "accuracy")
    return scores.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def outcome_frequencies(labelled: DataFrame) -> DataFrame:
    """Training frequencies for every season at once: running totals over earlier seasons."""
    per_season = labelled.filter(F.col("result").isNotNull()).groupBy("league_id", "season").agg(
        *[F.count_if(F.col("result") == o).alias(f"n_{o}") for o in OUTCOMES]
    )
    w = Window.partitionBy("league_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(f"n_{o}").over(w) for o in OUTCOMES]
    total = sums[0] + sums[1] + sums[2]
    return per_season.select(
        "league_id", "season", total.alias("n_train"),
        *[(s / total).alias(p) for s, p in zip(sums, PROBS, strict=True)],
    ).filter(F.col("n_train").isNotNull())


def expanding_statistics(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean and population deviation of earlier seasons, per season."""
    per_season = frame.groupBy("league_id", "season").agg(
        *[F.count(c).alias(f"{c}_n") for c in columns],
        *[F.sum(c).alias(f"{c}_s") for c in columns],
        *[F.sum(F.col(c) * F.col(c)).alias(f"{c}_q") for c in columns],
    )
    w = Window.partitionBy("league_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for c in columns:
        n, s, q = (F.sum(f"{c}_{k}").over(w) for k in "nsq")
        out += [
            F.coalesce(n, F.lit(0)).alias(f"{c}_n"),
            F.try_divide(s, n).alias(f"{c}_mean"),
            F.when(
                n > 0, F.sqrt(F.greatest(q / n - F.try_divide(s, n) ** 2, F.lit(0.0)))
            ).alias(f"{c}_std"),
        ]
    return per_season.select("league_id", "season", *out)


def reliability(predictions: DataFrame, keys: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """Mean predicted probability against observed frequency by class and bin.

    A bin is the number of edges at or below the probability; the edges are i * (1 / bins), the
    exact doubles an evenly spaced grid has.
    """
    step = 1.0 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    p = F.col("p")
    raw = sum((F.when(p >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)) - 1
    long = predictions.filter(F.col("result").isNotNull()).select(
        *keys,
        "result",
        F.inline(
            F.array(*[F.struct(F.lit(o).alias("class"), F.col(c).alias("p")) for o, c in zip(OUTCOMES, PROBS, strict=True)])
        ),
    )
    return (
        long.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)))
        .groupBy(*keys, "class", "bin")
        .agg(
            F.count("*").alias("n"),
            F.avg("p").alias("mean_predicted"),
            F.avg((F.col("result") == F.col("class")).cast("double")).alias("observed"),
        )
    )


def acceptance(model_means: DataFrame, baseline_means: DataFrame) -> DataFrame:
    """Gate rows: own model beats the rating baseline; market model is within 0.01 of closing."""

    def loss(df: DataFrame, name_col: str, name: str) -> Column:
        return F.max(F.when(F.col(name_col) == name, F.col("log_loss")))

    ours = model_means.groupBy("league_id").agg(
        loss(model_means, "model", "ensemble_no_market").alias("no_market"),
        loss(model_means, "model", "ensemble_with_market").alias("with_market"),
    )
    theirs = baseline_means.groupBy("league_id").agg(
        loss(baseline_means, "baseline", "rating").alias("rating"),
        loss(baseline_means, "baseline", "closing_odds").alias("closing"),
    )
    return ours.join(theirs, "league_id").select(
        "league_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit("ensemble without market < rating baseline").alias("gate"),
                    F.col("no_market").alias("ours"),
                    F.col("rating").alias("limit"),
                    (F.col("no_market") < F.col("rating")).alias("passed"),
                ),
                F.struct(
                    F.lit("ensemble with market <= closing odds + 0.01").alias("gate"),
                    F.col("with_market").alias("ours"),
                    (F.col("closing") + 0.01).alias("limit"),
                    (F.col("with_market") <= F.col("closing") + 0.01).alias("passed"),
                ),
            )
        ),
    ).filter(F.col("ours").isNotNull() & F.col("limit").isNotNull())


def hit_rate(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.filter(F.col("hit").isNotNull()).groupBy(*keys).agg(
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("resolved")
    )
