"""Season result files: contests, side statistics and bookmaker prices."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the result files and the bookmakers kept.
REQUIRED = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR")
BOOKMAKER_PREFIXES = {"B365": "bet365", "PS": "pinnacle", "Max": "market_max", "Avg": "market_avg"}
SIDE_STATS = {
    "shots": ("HS", "AS"),
    "shots_on_target": ("HST", "AST"),
    "fouls": ("HF", "AF"),
    "corners": ("HC", "AC"),
    "cards_yellow": ("HY", "AY"),
    "cards_red": ("HR", "AR"),
}


class LayoutError(ValueError):
    """A source no longer has the expected layout."""


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw text columns by name; older files are not valid UTF-8, hence the encoding.

    Files of different seasons differ in their columns. Those with one header are read together, and
    a column that a file lacks is null in its rows.
    """
    raw = None
    for group in _by_header(spark, paths):
        part = spark.read.csv(group, header=True, encoding="ISO-8859-1", enforceSchema=False)
        missing = sorted(set(REQUIRED) - set(part.columns))
        if missing:
            raise LayoutError(f"result file lacks the columns {missing}: {group}")
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    return raw


def _by_header(spark: SparkSession, paths: str | list[str]) -> list[str | list[str]]:
    """The files in groups of one first line each; the paths as given where there is but one group."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(paths).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
    )
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "line").alias("header"))
    groups: dict[str, list[str]] = {}
    for path, header in sorted(first.collect()):
        groups.setdefault(header.rstrip("\r"), []).append(unquote(path))
    return list(groups.values()) if len(groups) > 1 else [paths]


def _text(name: str) -> Column:
    return F.trim(F.col(name))


def _day(name: str) -> Column:
    """Four-digit years, or two-digit ones read as 1969 to 2068."""
    d = _text(name)
    short = F.try_to_date(d, "dd/MM/yy")
    turned = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(F.try_to_date(d, "dd/MM/yyyy"), turned)


def _whole(name: str) -> Column:
    """Counts may be written 3 or 3.0; the fraction is dropped."""
    return _text(name).try_cast("double").cast("int")


def _filled(raw: DataFrame) -> DataFrame:
    return raw.filter(F.coalesce(_text("HomeTeam"), F.lit("")) != "")


def _optional(raw: DataFrame, name: str, as_type: str) -> Column:
    if name not in raw.columns:
        return F.lit(None).cast(as_type)
    return _whole(name) if as_type == "int" else F.nanvl(_text(name).try_cast("double"), F.lit(None))


def invalid_results(raw: DataFrame) -> DataFrame:
    """Rows with a home team whose date or goals cannot be read."""
    bad = _day("Date").isNull() | _whole("FTHG").isNull() | _whole("FTAG").isNull()
    return _filled(raw).filter(bad)


def parse_results(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed contest rows; a row that cannot be read stops the job with its content."""
    shown = F.concat_ws(",", *[F.col(c) for c in REQUIRED])

    def must(value: Column) -> Column:
        return F.coalesce(value, F.raise_error(F.concat(F.lit("unreadable result row: "), shown)).cast("string").cast("int"))

    day = _day("Date")
    checked_day = F.when(day.isNotNull(), day).otherwise(
        F.raise_error(F.concat(F.lit("unreadable result row: "), shown)).cast("string").cast("date")
    )
    stats = {
        f"{side}_{name}": _optional(raw, cols[i], "int")
        for name, cols in SIDE_STATS.items()
        for i, side in enumerate(("home", "away"))
    }
    return _filled(raw).select(
        *keep,
        checked_day.alias("date"),
        _text("HomeTeam").alias("home_name"),
        _text("AwayTeam").alias("away_name"),
        must(_whole("FTHG")).alias("home_goals"),
        must(_whole("FTAG")).alias("away_goals"),
        _text("FTR").alias("file_result"),
        *[c.alias(n) for n, c in stats.items()],
    )


def price_rows(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per contest and bookmaker; a triplet counts only when all three legs parse."""

    def triplet(prefix: str) -> list[Column]:
        legs = [_optional(raw, f"{prefix}{x}", "double") for x in "HDA"]
        whole = legs[0].isNotNull() & legs[1].isNotNull() & legs[2].isNotNull()
        return [F.when(whole, leg) for leg in legs]

    structs = []
    for prefix, bookmaker in BOOKMAKER_PREFIXES.items():
        opening, closing = triplet(prefix), triplet(f"{prefix}C")
        structs.append(
            F.struct(
                F.lit(bookmaker).alias("bookmaker"),
                *[c.alias(f"open_{x}") for c, x in zip(opening, "hda", strict=True)],
                *[c.alias(f"close_{x}") for c, x in zip(closing, "hda", strict=True)],
            )
        )
    rows = _filled(raw).select(*keep, F.inline(F.array(*structs)))
    return rows.filter(F.col("open_h").isNotNull() | F.col("close_h").isNotNull())


def side_rows_of_results(contests: DataFrame) -> DataFrame:
    """Home and away statistic rows of resolved contests, exploded in one scan."""

    def side(me: str, flag: int):
        return F.struct(
            F.col(f"{me}_id").alias("team_id"),
            F.lit(flag).alias("is_home"),
            *[F.col(f"{me}_{name}").alias(name) for name in SIDE_STATS],
        )

    return contests.select("match_id", F.inline(F.array(side("home", 1), side("away", 0))))


def require_rows(frame: DataFrame, message: str) -> DataFrame:
    """Stops at once when a source delivered nothing."""
    if frame.isEmpty():
        raise LayoutError(message)
    return frame
