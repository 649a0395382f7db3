"""Maps a star schema of orders and line items onto the contest model.

One order is one contest: the customer's nation plays at home, the visiting side comes from the
order key, and goals and expected goals come from line-item return flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.settings import FeatureSettings, ModelSettings, ScoreModelSettings, Settings

BOOKMAKERS = ("bet365", "pinnacle", "market_max", "market_avg")
FIRST_SEASON = "1995"
HOME_EFFECT = 0.25
RHO = -0.1
# One multiplier per bookmaker and leg, all prime, so that prices differ between them.
LEG_STEPS = {
    "bet365": (7, 11, 13),
    "pinnacle": (17, 19, 23),
    "market_max": (29, 31, 37),
    "market_avg": (41, 43, 47),
}
SCHEDULED_FROM = "2001-06-01"
CURRENT_SEASON = "2001"


def demo_settings(**models) -> Settings:
    return Settings(
        focus_team=3,
        current_season=CURRENT_SEASON,
        seasons=("1995", "1996", "1997", "1998", "1999", "2000", "2001"),
        history_start="1995-01-01",
        features=FeatureSettings(
            no_crowd_seasons=("1997",), derbies=((3, 7), (12, 5), (20, 21))
        ),
        models=ModelSettings(
            score=ScoreModelSettings(xi_grid=(0.0005, 0.001, 0.0019, 0.0035)), **models
        ),
    )


class ContestTables:
    """The adapted tables of one data folder, each built lazily on request."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def version(self) -> tuple:
        """Name, length and time of every data file, so that stored results can tell when the data change."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(path, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(found))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def contests(self) -> DataFrame:
        flag = F.col("l_returnflag")
        lines = (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("match_id"))
            .agg(
                F.count_if(flag == "R").alias("r"),
                F.count_if(flag == "A").alias("a"),
                F.count_if(flag == "N").alias("n"),
            )
        )
        day = F.to_date("o_orderdate")
        scheduled = (F.col("o_orderstatus") == "P") & (day >= F.to_date(F.lit(SCHEDULED_FROM)))
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_custkey").alias("c_custkey"),
            (F.col("o_custkey") % 4).alias("league_id"),
            F.year(day).cast("string").alias("season"),
            day.alias("date"),
            (F.col("o_orderkey") % 25).cast("int").alias("away_id"),
            F.when(scheduled, "scheduled").otherwise("finished").alias("status"),
        )
        homes = self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("home_id"))
        played = F.col("status") == "finished"
        return (
            orders.join(homes, "c_custkey")
            .filter(F.col("home_id") != F.col("away_id"))
            .join(lines, "match_id", "left")
            .select(
                "match_id",
                "league_id",
                "season",
                "date",
                "home_id",
                "away_id",
                "status",
                F.when(played, F.coalesce(F.col("r"), F.lit(0))).cast("int").alias("home_goals"),
                F.when(played, F.coalesce(F.col("a"), F.lit(0))).cast("int").alias("away_goals"),
                (0.5 * F.col("r") + 0.25 * F.col("n")).alias("home_xg"),
                (0.5 * F.col("a") + 0.25 * F.col("n")).alias("away_xg"),
            )
        )

    def finished(self) -> DataFrame:
        return self.contests().filter(F.col("status") == "finished")

    def side_stats(self) -> DataFrame:
        """One row per contest side with its expected goals."""
        return self.contests().select(
            "match_id",
            "league_id",
            "season",
            F.explode(
                F.array(
                    F.struct(F.col("home_id").alias("team_id"), F.lit(1).alias("is_home"), F.col("home_xg").alias("xg")),
                    F.struct(F.col("away_id").alias("team_id"), F.lit(0).alias("is_home"), F.col("away_xg").alias("xg")),
                )
            ).alias("s"),
        ).select("match_id", "league_id", "season", "s.team_id", "s.is_home", "s.xg")

    def ratings(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
        nations = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("team_id"))
        return (
            lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("team_id", F.to_date("l_shipdate").alias("date"))
            .agg((F.lit(1300) + 10 * F.max("l_quantity")).alias("rating"))
        )

    def odds_wide(self) -> DataFrame:
        """One row per contest with a price column per bookmaker, moment and leg."""
        k = F.col("match_id")

        def price(step: int, shift: int):
            return F.lit(1) + ((k * step + shift) % 400 + 5) / F.lit(100.0)

        cols = []
        for b in BOOKMAKERS:
            for leg, step in zip("hda", LEG_STEPS[b], strict=True):
                opening, closing = price(step, 0), price(step, 7)
                if b == "market_avg":
                    opening = F.when(k % 7 != 0, opening)
                closing = F.when(F.col("season") != FIRST_SEASON, closing)
                if leg == "d":
                    closing = F.when(k % 11 != 0, closing)
                cols += [opening.alias(f"{b}_open_{leg}"), closing.alias(f"{b}_close_{leg}")]
        return self.contests().filter(k % 13 != 0).select("match_id", "league_id", "season", *cols)

    def odds(self) -> DataFrame:
        wide = self.odds_wide()
        legs = [f"{m}_{x}" for m in ("open", "close") for x in "hda"]
        structs = [
            F.struct(F.lit(b).alias("bookmaker"), *[F.col(f"{b}_{x}").alias(x) for x in legs])
            for b in BOOKMAKERS
        ]
        return wide.select("match_id", F.inline(F.array(*structs)))

    def probs(self) -> DataFrame:
        """Three integer-derived probability components per finished contest."""
        k = F.col("match_id")
        parts = {
            "score_model": (1 + k % 7, 1 + k % 5, 1 + k % 3),
            "trees": (1 + k % 5, 1 + k % 4, 1 + k % 6),
            "third": (1 + k % 4, 1 + k % 3, 1 + k % 8),
        }
        structs = []
        for name, (a, b, c) in parts.items():
            total = a + b + c
            structs.append(
                F.struct(
                    F.lit(name).alias("component"),
                    (a / total).alias("p_home"),
                    (b / total).alias("p_draw"),
                    (c / total).alias("p_away"),
                )
            )
        from contestry.functions.columns import outcome

        return self.finished().select(
            "match_id",
            "league_id",
            "season",
            "home_id",
            "away_id",
            outcome("home_goals", "away_goals").alias("result"),
            F.inline(F.array(*structs)),
        )

    def params(self) -> DataFrame:
        """Attack and defence in eighths; some teams are missing on purpose."""
        teams = self.contests().select(
            "league_id", F.explode(F.array("home_id", "away_id")).alias("team_id")
        ).distinct()
        t, lg = F.col("team_id"), F.col("league_id")
        return teams.filter((t + lg) % 12 != 0).select(
            "league_id",
            "team_id",
            (((t * 3 + lg) % 9 - 4) / 8.0).alias("attack"),
            (((t * 5 + lg) % 7 - 3) / 8.0).alias("defence"),
        )

    def alias_config(self) -> DataFrame:
        """Nested alias settings: per team a map from source to its list of names."""
        n = F.col("n_name")
        return self.raw("nation").select(
            F.col("n_nationkey").alias("team_id"),
            n.alias("name"),
            F.create_map(
                F.lit("results"), F.array(n),
                F.lit("schedule"), F.when(F.col("n_nationkey") != 24, F.array(F.lower(n), F.concat(n, F.lit(" FC")))).otherwise(F.array(F.concat(n, F.lit(" FC")))),
                F.lit("feed"), F.array(F.initcap(F.lower(n))),
            ).alias("aliases"),
        )

    def second_source(self) -> DataFrame:
        """Contests as a second source tells them: other names, some errors, few expected goals."""
        k = F.col("match_id")
        names = self.raw("nation").select("n_nationkey", F.lower("n_name").alias("alias"))
        base = self.finished()
        pad = F.concat(F.lit("  "), F.col("alias"))
        home = names.select(F.col("n_nationkey").alias("home_id"), pad.alias("home_name"))
        away = names.select(F.col("n_nationkey").alias("away_id"), F.col("alias").alias("away_name"))
        return base.join(home, "home_id").join(away, "away_id").select(
            "match_id",
            "league_id",
            "season",
            "home_name",
            "away_name",
            F.when(k % 89 == 0, F.date_add("date", 3)).otherwise(F.col("date")).alias("date"),
            (F.col("home_goals") + F.when(k % 97 == 0, 1).otherwise(0)).alias("home_goals"),
            "away_goals",
            F.when(k % 5 == 0, F.col("home_xg")).alias("home_xg"),
            F.when(k % 5 == 0, F.col("away_xg")).alias("away_xg"),
            F.when(k % 3 == 0, (k % 38 + 1).cast("int")).alias("matchday"),
        )
