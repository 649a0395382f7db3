"""Side-grain windows: trailing form, rest, streaks, head-to-head and counted matchdays.

Every frame ends before the current row, so no row sees its own contest or a later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.bounded import (
    BUCKET_ROWS,
    GROUP_LIMIT,
    dense_position,
    needs_split,
    with_halo,
)

FORM_STATS = ("points", "goals_for", "goals_against", "xg_for", "xg_against", "g_minus_xg")
TEAM = ["league_id", "team"]


def side_rows(contests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One contest row to its two side rows in a single scan."""

    def side(me: str, other: str, is_home: bool):
        return F.struct(
            F.col(f"{me}_id").alias("team"),
            F.col(f"{other}_id").alias("opponent"),
            F.lit(is_home).alias("is_home"),
            F.col(f"{me}_goals").alias("goals_for"),
            F.col(f"{other}_goals").alias("goals_against"),
            F.col(f"{me}_xg").alias("xg_for"),
            F.col(f"{other}_xg").alias("xg_against"),
        )

    rows = contests.select(
        "match_id", "league_id", "season", "date", *keep,
        F.inline(F.array(side("home", "away", True), side("away", "home", False))),
    )
    gf, ga = F.col("goals_for"), F.col("goals_against")
    played = gf.isNotNull() & ga.isNotNull()
    return rows.withColumns(
        {
            "points": F.when(played, F.when(gf > ga, 3.0).when(gf == ga, 1.0).otherwise(0.0)),
            "won": F.when(played, (gf > ga).cast("int")),
            "lost": F.when(played, (gf < ga).cast("int")),
            "g_minus_xg": gf - F.col("xg_for"),
        }
    )


def rolling_columns(windows: tuple[int, ...], stats=FORM_STATS) -> list[str]:
    return [f"{s}{v}_ma{w}" for w in windows for s in stats for v in ("", "_venue")]


def side_form(
    sides: DataFrame,
    windows: tuple[int, ...] = (5, 10),
    stats: tuple[str, ...] = FORM_STATS,
    mode: str = "auto",
    limit: int = GROUP_LIMIT,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Trailing means (all contests and same venue), rest days and streaks per side row."""
    if needs_split(sides, TEAM, mode, limit):
        return _side_form_split(sides, windows, stats, bucket_rows)
    order = ["date", "match_id"]
    team = Window.partitionBy(*TEAM).orderBy(*order)
    venue = Window.partitionBy(*TEAM, "is_home").orderBy(*order)
    out = sides
    trailing = {}
    for w in windows:
        for s in stats:
            trailing[f"{s}_ma{w}"] = F.avg(s).over(team.rowsBetween(-w, -1))
    trailing["rest_days"] = F.datediff("date", F.lag("date").over(team))
    seen, past = team.rowsBetween(Window.unboundedPreceding, 0), team.rowsBetween(Window.unboundedPreceding, -1)
    for flag, name in (("won", "win"), ("lost", "loss")):
        trailing[f"__{name}_run"] = F.coalesce(F.sum(flag).over(seen), F.lit(0))
    out = out.withColumns(trailing)
    breaks = {}
    for flag, name in (("won", "win"), ("lost", "loss")):
        before = F.coalesce(F.sum(flag).over(past), F.lit(0))
        broken = F.max(F.when(F.col(flag) == 0, F.col(f"__{name}_run"))).over(past)
        breaks[f"{name}_streak"] = (before - F.coalesce(broken, F.lit(0))).cast("int")
    out = out.withColumns(breaks).drop("__win_run", "__loss_run")
    return out.withColumns(
        {
            f"{s}_venue_ma{w}": F.avg(s).over(venue.rowsBetween(-w, -1))
            for w in windows
            for s in stats
        }
    )


def _side_form_split(sides, windows, stats, bucket_rows) -> DataFrame:
    """The same columns when one team may hold more rows than a task should.

    Exact: dense positions give every frame a fixed reach, so a bucket of positions plus the
    `max(windows)` rows before it is all a trailing mean needs. Streaks come from daily run
    summaries folded over the calendar.
    """
    rows = sides.withColumns({"__one": F.lit(1), "__home1": F.col("is_home").cast("int")})
    rows = rows.withColumn("__away1", 1 - F.col("__home1"))
    rows = dense_position(
        rows, TEAM, "date", "match_id",
        {"__pos": "__one", "__posh": "__home1", "__posa": "__away1"},
    )
    rows = rows.withColumn(
        "__posv", F.when(F.col("is_home"), F.col("__posh")).otherwise(F.col("__posa"))
    ).drop("__one", "__home1", "__away1", "__posh", "__posa")
    rows = _streaks_split(rows)
    reach = max(windows)

    haloed = with_halo(rows, "__pos", reach, bucket_rows)
    w_all = Window.partitionBy(*TEAM, "__bucket").orderBy("__pos")
    cols = {
        f"{s}_ma{w}": F.avg(s).over(w_all.rowsBetween(-w, -1)) for w in windows for s in stats
    }
    cols["rest_days"] = F.datediff("date", F.lag("date").over(w_all))
    rows = haloed.withColumns(cols).filter("__own").drop("__own", "__bucket", "__pos")

    haloed = with_halo(rows, "__posv", reach, bucket_rows)
    w_venue = Window.partitionBy(*TEAM, "is_home", "__bucket").orderBy("__posv")
    cols = {
        f"{s}_venue_ma{w}": F.avg(s).over(w_venue.rowsBetween(-w, -1))
        for w in windows
        for s in stats
    }
    return haloed.withColumns(cols).filter("__own").drop("__own", "__bucket", "__posv")


def _streaks_split(rows: DataFrame) -> DataFrame:
    """Streak before each row: run inside the day plus the run carried over earlier days."""
    day = Window.partitionBy(*TEAM, "date").orderBy("match_id")
    seen, past = day.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(Window.unboundedPreceding, -1)
    flags = (("won", "win"), ("lost", "loss"))
    out = rows.withColumns(
        {f"__{n}_run": F.coalesce(F.sum(f).over(seen), F.lit(0)) for f, n in flags}
    )
    local = {}
    for f, n in flags:
        local[f"__{n}_before"] = F.coalesce(F.sum(f).over(past), F.lit(0))
        local[f"__{n}_break"] = F.max(F.when(F.col(f) == 0, F.col(f"__{n}_run"))).over(past)
    out = out.withColumns(local)
    daily = out.groupBy(*TEAM, "date").agg(
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f"{n}_sum") for f, n in flags],
        *[F.max(F.when(F.col(f) == 0, F.col(f"__{n}_run"))).alias(f"{n}_last_break") for f, n in flags],
    )
    days = Window.partitionBy(*TEAM).orderBy("date")
    upto = days.rowsBetween(Window.unboundedPreceding, 0)
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumns({f"{n}_total": F.sum(f"{n}_sum").over(upto) for _, n in flags})
    daily = daily.withColumns(
        {
            f"{n}_level": F.col(f"{n}_total") - F.col(f"{n}_sum") + F.col(f"{n}_last_break")
            for _, n in flags
        }
    )
    carried = daily.select(
        *TEAM,
        "date",
        *[
            (
                F.coalesce(F.sum(f"{n}_sum").over(earlier), F.lit(0))
                - F.coalesce(F.max(f"{n}_level").over(earlier), F.lit(0))
            ).alias(f"__{n}_carry")
            for _, n in flags
        ],
    )
    out = out.join(carried, [*TEAM, "date"])
    for _, n in flags:
        out = out.withColumn(
            f"{n}_streak",
            F.when(
                F.col(f"__{n}_break").isNull(), F.col(f"__{n}_carry") + F.col(f"__{n}_before")
            )
            .otherwise(F.col(f"__{n}_before") - F.col(f"__{n}_break"))
            .cast("int"),
        )
    return out.drop(*[c for c in out.columns if c.startswith(("__win_", "__loss_"))])


def head_to_head(
    contests: DataFrame,
    window: int = 5,
    mode: str = "auto",
    limit: int = GROUP_LIMIT,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Home side's points per game over the last `window` played meetings of the pairing.

    Rows are numbered by played meetings before them, so a value frame over that number skips
    unplayed rows without letting them use up a slot.
    """
    pair = ["league_id", "__lo", "__hi"]
    h, a = F.col("home_goals"), F.col("away_goals")
    played = h.isNotNull() & a.isNotNull()
    home_pts = F.when(h > a, 3.0).when(h == a, 1.0).otherwise(0.0)
    away_pts = F.when(a > h, 3.0).when(h == a, 1.0).otherwise(0.0)
    home_is_lo = F.col("home_id") == F.col("__lo")
    rows = contests.withColumns(
        {"__lo": F.least("home_id", "away_id"), "__hi": F.greatest("home_id", "away_id")}
    ).withColumns(
        {
            "__played": played.cast("int"),
            "__pts_lo": F.when(played, F.when(home_is_lo, home_pts).otherwise(away_pts)),
            "__pts_hi": F.when(played, F.when(home_is_lo, away_pts).otherwise(home_pts)),
        }
    )
    if needs_split(rows, pair, mode, limit):
        rows = dense_position(rows, pair, "date", "match_id", {"__met": "__played"})
        rows = with_halo(rows, "__met", window, bucket_rows)
        rows = rows.filter(F.col("__own") | (F.col("__played") == 1))
        group = [*pair, "__bucket"]
    else:
        order = Window.partitionBy(*pair).orderBy("date", "match_id")
        past = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__met", F.coalesce(F.sum("__played").over(past), F.lit(0)))
        group = pair
    frame = Window.partitionBy(*group).orderBy("__met").rangeBetween(-window, -1)
    rows = rows.withColumn(
        "h2h_home_ppg",
        F.when(home_is_lo, F.avg("__pts_lo").over(frame)).otherwise(F.avg("__pts_hi").over(frame)),
    )
    if "__bucket" in rows.columns:
        rows = rows.filter("__own").drop("__own", "__bucket")
    return rows.drop("__lo", "__hi", "__played", "__pts_lo", "__pts_hi", "__met")


def counted_matchdays(
    contests: DataFrame, mode: str = "auto", limit: int = GROUP_LIMIT
) -> DataFrame:
    """match_id with the larger of both sides' running contest numbers in the season."""
    key = ["league_id", "season", "team"]
    sides = contests.select(
        "match_id", "league_id", "season", "date",
        F.explode(F.array("home_id", "away_id")).alias("team"),
    )
    if needs_split(sides, key, mode, limit):
        sides = dense_position(
            sides.withColumn("__one", F.lit(1)), key, "date", "match_id", {"__n": "__one"}
        ).withColumn("n", F.col("__n") + 1)
    else:
        order = Window.partitionBy(*key).orderBy("date", "match_id")
        sides = sides.withColumn("n", F.row_number().over(order))
    return sides.groupBy("match_id").agg(F.max("n").cast("int").alias("matchday"))


def fold_to_contests(sides: DataFrame, columns: list[str]) -> DataFrame:
    """Both side rows back to one contest row in a single shuffle: home_* and away_* columns."""
    return sides.groupBy("match_id").agg(
        *[
            F.max(F.when(F.col("is_home") == flag, F.col(c))).alias(f"{prefix}_{c}")
            for prefix, flag in (("home", True), ("away", False))
            for c in columns
        ]
    )
