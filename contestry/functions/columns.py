"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class order, which the ranked probability score depends on.
OUTCOMES = ("H", "D", "A")
PROBS = ("p_home", "p_draw", "p_away")

_HEX_DIGITS = 13
_HEX_RANGE = float(16**_HEX_DIGITS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def outcome(home_goals: Column | str, away_goals: Column | str) -> Column:
    """H / D / A seen from the home side; NULL until both goals are known."""
    h, a = col(home_goals), col(away_goals)
    return (
        F.when(h.isNull() | a.isNull(), F.lit(None))
        .when(h > a, "H")
        .when(h == a, "D")
        .otherwise("A")
    )


def first_argmax(p_home="p_home", p_draw="p_draw", p_away="p_away") -> Column:
    """Most probable class; ties go to the earlier class in H, D, A order."""
    h, d, a = col(p_home), col(p_draw), col(p_away)
    return F.when(h >= F.greatest(d, a), "H").when(d >= a, "D").otherwise("A")


def prob_of(result="result", p_home="p_home", p_draw="p_draw", p_away="p_away") -> Column:
    r = col(result)
    return F.when(r == "H", col(p_home)).when(r == "D", col(p_draw)).otherwise(col(p_away))


def indicator(result: Column | str, label: str) -> Column:
    return (col(result) == label).cast("double")


def normalised_inverse(h, d, a) -> tuple[Column, Column, Column]:
    """Odds to probabilities: inverse, then scaled so that the three sum to one."""
    inv = [F.try_divide(F.lit(1.0), col(x)) for x in (h, d, a)]
    total = inv[0] + inv[1] + inv[2]
    return tuple(F.try_divide(i, total) for i in inv)


def md5_uniform(*parts: Column | str | int) -> Column:
    """Repeatable uniform in [0, 1) from a key; independent of partitioning."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, int) else col(p) for p in parts])
    digits = F.substring(F.md5(text), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(_HEX_RANGE)


def season_code(season: Column | str) -> Column:
    """2018-19 becomes 1819."""
    parts = F.split(col(season), "-")
    return F.concat(F.right(parts[0], F.lit(2)), parts[1])


def season_start(season: Column | str) -> Column:
    """2018-19 becomes 2018."""
    return F.split(col(season), "-")[0].cast("int")


def season_span(season: Column | str) -> Column:
    """2018-19 becomes 2018-2019."""
    start = season_start(season)
    return F.concat_ws("-", start, start + 1)


def natural_key(season="season", home="home_id", away="away_id") -> Column:
    return F.concat_ws("_", col(season), col(home), col(away))


def merged_tag(old: Column | str, new: Column | str) -> Column:
    """Provenance tags joined with +, each once, old order first."""
    o, n = col(old), col(new)
    return (
        F.when(o.isNull() | (o == ""), n)
        .when(F.array_contains(F.split(o, "[+]"), n), o)
        .otherwise(F.concat_ws("+", o, n))
    )
