"""Bookmaker prices to probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import normalised_inverse

# Preferred bookmakers, best first.
PREFERRED = ("market_avg", "bet365")


def _best_price(odds: DataFrame, legs: tuple[str, str, str], names: tuple[str, str, str]) -> DataFrame:
    """One complete triplet per contest, by bookmaker preference; one combined aggregate."""
    complete = odds.filter(F.col("bookmaker").isin(list(PREFERRED)))
    for leg in legs:
        complete = complete.filter(F.col(leg).isNotNull())
    priority = F.when(F.col("bookmaker") == PREFERRED[0], 0).otherwise(1)
    best = complete.groupBy("match_id").agg(F.min_by(F.struct(*legs), priority).alias("best"))
    h, d, a = normalised_inverse(*[F.col(f"best.{leg}") for leg in legs])
    return best.select("match_id", h.alias(names[0]), d.alias(names[1]), a.alias(names[2]))


def opening_probabilities(odds: DataFrame) -> DataFrame:
    return _best_price(odds, ("open_h", "open_d", "open_a"), ("imp_home", "imp_draw", "imp_away"))


def closing_probabilities(odds: DataFrame) -> DataFrame:
    """Closing price per leg, falling back to the opening price of that leg."""
    best = odds.withColumns(
        {f"best_{x}": F.coalesce(f"close_{x}", f"open_{x}") for x in "hda"}
    )
    return _best_price(best, ("best_h", "best_d", "best_a"), ("p_home", "p_draw", "p_away"))


def market_or_fallback(
    frame: DataFrame,
    fallback: tuple[str, str, str],
    names: tuple[str, str, str] = ("p_home", "p_draw", "p_away"),
) -> DataFrame:
    """Market probabilities, or all three fallback columns where any of them is missing."""
    market = ("imp_home", "imp_draw", "imp_away")
    missing = F.col(market[0]).isNull() | F.col(market[1]).isNull() | F.col(market[2]).isNull()
    return frame.withColumns(
        {
            n: F.when(missing, F.col(f)).otherwise(F.col(m))
            for n, f, m in zip(names, fallback, market, strict=True)
        }
    )
