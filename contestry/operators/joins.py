"""Joins: side folds, as-of ratings, alias resolution, reconciliation and set filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.columns import merged_tag


def attach_side_xg(contests: DataFrame, side_stats: DataFrame) -> DataFrame:
    """Both sides' expected goals with one aggregate and one join instead of two scans."""
    folded = side_stats.groupBy("match_id").agg(
        F.max(F.when(F.col("is_home") == 1, F.col("xg"))).alias("home_xg"),
        F.max(F.when(F.col("is_home") == 0, F.col("xg"))).alias("away_xg"),
    )
    return contests.drop("home_xg", "away_xg").join(folded, "match_id", "left")


def asof_by_date(
    probes: DataFrame, log: DataFrame, key: str, probe_date: str, log_date: str, value: str
) -> DataFrame:
    """Latest log value per key on or before the probe's date, for date-typed columns.

    The window runs over distinct (key, date) pairs only: per key that is bounded by the
    calendar, so one key with very many probes costs no more than any other. The probes meet
    the result in an equi-join.
    """
    asked = probes.select(F.col(key), F.col(probe_date).alias("__d")).distinct()
    events = asked.select(
        key, "__d", F.lit(1).alias("__ask"), F.lit(None).cast(log.schema[value].dataType).alias(value)
    ).unionByName(
        log.filter(F.col(value).isNotNull()).select(
            F.col(key), F.col(log_date).alias("__d"), F.lit(0).alias("__ask"), F.col(value)
        )
    )
    w = Window.partitionBy(key).orderBy("__d", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    answers = (
        events.withColumn("__v", F.last(value, ignorenulls=True).over(w))
        .filter(F.col("__ask") == 1)
        .select(F.col(key), F.col("__d").alias(probe_date), F.col("__v").alias(value))
    )
    return probes.join(answers, [key, probe_date], "left")


def asof_by_time(
    probes: DataFrame, log: DataFrame, key: str, time: str, tie: str, value: str
) -> DataFrame:
    """As-of join on timestamps: local window per (key, day) plus a carry over earlier days.

    Among log rows of one instant the highest `tie` wins.
    """
    cols = [key, time, tie]
    both = probes.select(*cols, F.lit(None).cast(log.schema[value].dataType).alias("__v"), F.lit(1).alias("__ask")).unionByName(
        log.select(*cols, F.col(value).alias("__v"), F.lit(0).alias("__ask"))
    ).withColumn("__day", F.to_date(time))
    local = (
        Window.partitionBy(key, "__day")
        .orderBy(time, "__ask", tie)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = both.withColumn("__in_day", F.last("__v", ignorenulls=True).over(local))
    daily = both.groupBy(key, "__day").agg(
        F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(time, tie))).alias("__last")
    )
    days = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carry = daily.select(key, "__day", F.last("__last", ignorenulls=True).over(days).alias("__carry"))
    return (
        rows.filter(F.col("__ask") == 1)
        .join(carry, [key, "__day"])
        .select(*cols, F.coalesce("__in_day", "__carry").alias(value))
    )


def external_ratings(contests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Both sides' external rating as of the day before the contest.

    Home and away probes share one distinct (team, date) table, so the log is scanned once.
    """
    probes = contests.select("match_id", F.date_sub("date", 1).alias("as_of"), "home_id", "away_id")
    sides = probes.select(
        "match_id", "as_of",
        F.inline(
            F.array(
                F.struct(F.col("home_id").alias("team_id"), F.lit(True).alias("is_home")),
                F.struct(F.col("away_id").alias("team_id"), F.lit(False).alias("is_home")),
            )
        ),
    )
    rated = asof_by_date(sides, ratings, "team_id", "as_of", "date", "rating")
    return rated.groupBy("match_id").agg(
        F.max(F.when(F.col("is_home"), F.col("rating"))).alias("rating_ext_home"),
        F.max(F.when(~F.col("is_home"), F.col("rating"))).alias("rating_ext_away"),
    )


def resolve_names(rows: DataFrame, aliases: DataFrame, source: str, columns: dict[str, str]) -> DataFrame:
    """Source spellings to team ids; `columns` maps name column to id column. Unknown is NULL."""
    names = aliases.filter(F.col("source") == source)
    out = rows
    for name, target in columns.items():
        lookup = names.select(F.col("alias").alias("__alias"), F.col("team_id").alias(target))
        out = out.join(lookup, F.trim(name) == F.col("__alias"), "left").drop("__alias")
    return out


def unknown_names(rows: DataFrame, aliases: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """Every spelling without a team, once, so that all can be reported together."""
    names = aliases.filter(F.col("source") == source).select(F.col("alias").alias("name"))
    seen = rows.select(F.explode(F.array(*[F.trim(c) for c in columns])).alias("name")).distinct()
    return seen.join(names, "name", "left_anti")


class UnknownNames(ValueError):
    """Spellings that no team has in a source, all of them."""

    def __init__(self, source: str, names: list[str]):
        super().__init__(f"{len(names)} names of source {source} belong to no team: {', '.join(names)}")
        self.source, self.names = source, names


def require_known(rows: DataFrame, aliases: DataFrame, source: str, columns: list[str]) -> None:
    """Raises UnknownNames with every unknown spelling, sorted; null names are not looked up."""
    found = unknown_names(rows, aliases, source, columns).filter("name is not null")
    names = found.agg(F.sort_array(F.collect_set("name")).alias("names")).first()["names"]
    if names:
        raise UnknownNames(source, names)


def reconcile(
    base: DataFrame, other: DataFrame, key: str = "match_id", missing_is_error: bool = True
) -> DataFrame:
    """Rows of `other` that contradict `base`: missing, different score, or over a day apart."""
    b = base.select(
        key,
        F.col("date").alias("base_date"),
        F.col("home_goals").alias("base_home"),
        F.col("away_goals").alias("base_away"),
        F.lit(True).alias("__known"),
    )
    same = F.col("base_home").eqNullSafe(F.col("home_goals")) & F.col("base_away").eqNullSafe(
        F.col("away_goals")
    )
    checked = other.join(b, key, "left").withColumn(
        "violation",
        F.when(F.col("__known").isNull(), F.lit("missing") if missing_is_error else F.lit(None))
        .when(~same, "score")
        .when(F.abs(F.datediff("base_date", "date")) > 1, "date"),
    )
    return checked.filter(F.col("violation").isNotNull()).drop("__known")


class Contradiction(ValueError):
    """Rows of a source that contradict what is stored; `n` of them, the first ones as examples."""

    def __init__(self, n: int, examples: list[tuple]):
        told = "; ".join(f"{match} ({why})" for match, why in examples)
        super().__init__(f"{n} rows contradict the stored contests: {told}")
        self.n, self.examples = n, examples


def require_agreement(violations: DataFrame, shown: int = 20) -> None:
    """Raises Contradiction if reconcile() found rows; the count is whole, the message holds the first by match_id."""
    n = violations.count()
    if n:
        first = violations.select("match_id", "violation").orderBy("match_id", "violation").limit(shown).collect()
        raise Contradiction(n, [tuple(r) for r in first])


def official_matchdays(contests: DataFrame, schedule: DataFrame) -> DataFrame:
    """The official matchday replaces the counted one wherever it is known."""
    official = (
        schedule.filter(F.col("matchday").isNotNull())
        .groupBy("match_id")
        .agg(F.max("matchday").alias("__official"))
    )
    return (
        contests.join(official, "match_id", "left")
        .withColumn("matchday", F.coalesce("__official", "matchday"))
        .drop("__official")
    )


def fill_missing_xg(contests: DataFrame, filler: DataFrame, tag: str) -> DataFrame:
    """Second source fills contests lacking any side's expected goals, and only those.

    `contests` carries home_xg, away_xg and source. Pending is per contest: if one side is
    missing, both sides are taken from the filler.
    """
    f = (
        filler.filter(F.col("home_xg").isNotNull() & F.col("away_xg").isNotNull())
        .groupBy("match_id")
        .agg(F.max("home_xg").alias("__h"), F.max("away_xg").alias("__a"))
    )
    pending = F.col("home_xg").isNull() | F.col("away_xg").isNull()
    use = pending & F.col("__h").isNotNull()
    return (
        contests.join(f, "match_id", "left")
        .withColumn("__use", use)
        .withColumns(
            {
                "home_xg": F.when(F.col("__use"), F.col("__h")).otherwise(F.col("home_xg")),
                "away_xg": F.when(F.col("__use"), F.col("__a")).otherwise(F.col("away_xg")),
                "source": F.when(F.col("__use"), merged_tag("source", F.lit(tag))).otherwise(
                    F.col("source")
                ),
            }
        )
        .drop("__h", "__a", "__use")
    )


def team_promotions(contests: DataFrame) -> DataFrame:
    """Per league, season and team a flag: absent from the league's previous present season; 0 in the first season."""
    team_seasons = contests.select(
        "league_id", "season", F.explode(F.array("home_id", "away_id")).alias("team")
    ).distinct()
    order = Window.partitionBy("league_id").orderBy("season")
    seasons = team_seasons.select("league_id", "season").distinct().withColumn(
        "prev", F.lag("season").over(order)
    )
    before = team_seasons.select("league_id", F.col("season").alias("prev"), "team", F.lit(1).alias("__was"))
    return (
        team_seasons.join(seasons, ["league_id", "season"])
        .join(before, ["league_id", "prev", "team"], "left")
        .select(
            "league_id", "season", "team",
            F.when(F.col("prev").isNull() | F.col("__was").isNotNull(), 0).otherwise(1).alias("flag"),
        )
    )


def promoted_flags(contests: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Both teams' promotion flags, from the contests' own teams or from known `flags` (team_promotions)."""
    flags = team_promotions(contests) if flags is None else flags
    home = flags.select("league_id", "season", F.col("team").alias("home_id"), F.col("flag").alias("promoted_home"))
    away = flags.select("league_id", "season", F.col("team").alias("away_id"), F.col("flag").alias("promoted_away"))
    return contests.join(home, ["league_id", "season", "home_id"]).join(
        away, ["league_id", "season", "away_id"]
    )


def teams_without_rating(contests: DataFrame, ratings: DataFrame) -> DataFrame:
    teams = contests.select(F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct()
    return teams.join(ratings.select("team_id").distinct(), "team_id", "left_anti")


def earlier_seasons(seasons: DataFrame) -> DataFrame:
    """Walk-forward pairing: every test season with each season before it."""
    s = seasons.select("league_id", "season").distinct()
    w = Window.partitionBy("league_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    listed = s.withColumn("__earlier", F.collect_list("season").over(w))
    return listed.select(
        "league_id",
        F.col("season").alias("test_season"),
        F.explode("__earlier").alias("train_season"),
    )
