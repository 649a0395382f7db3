"""The complete feature set: one row per contest, nothing later than the day before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.operators import form, joins, keys, odds
from contestry.operators.ratings import own_ratings
from contestry.settings import FeatureSettings

RATING_COLUMNS = (
    "rating_own_home", "rating_own_away", "rating_own_diff",
    "rating_ext_home", "rating_ext_away", "rating_ext_diff",
)
CONTEXT_COLUMNS = ("matchday", "month", "no_crowd", "derby", "promoted_home", "promoted_away", "h2h_home_ppg")


XG_STATS = tuple(s for s in form.FORM_STATS if "xg" in s)


def feature_blocks(cfg: FeatureSettings) -> dict[str, set[str]]:
    """Columns by the step that makes them, for ablation.

    The form block holds means over all contests and streaks; venue means of points and goals are in no block."""

    def both_sides(names: list[str]) -> set[str]:
        return {f"{side}_{n}" for n in names for side in ("home", "away")}

    goals = [f"{s}_ma{w}" for s in form.FORM_STATS if s not in XG_STATS for w in cfg.windows]
    return {
        "ratings": set(RATING_COLUMNS),
        "xg": both_sides(form.rolling_columns(cfg.windows, XG_STATS)),
        "form": both_sides([*goals, "win_streak", "loss_streak"]),
        "rest": both_sides(["rest_days"]),
        "context": set(CONTEXT_COLUMNS),
    }


def build_features(
    contests: DataFrame,
    ratings: DataFrame,
    prices: DataFrame,
    cfg: FeatureSettings,
    include_scheduled: bool = False,
    mode: str = "auto",
    own: DataFrame | None = None,
    promotions: DataFrame | None = None,
) -> DataFrame:
    """Lazy feature frame; persisting it is a separate step.

    A contest's features come from all contests of its two teams, apart from own ratings and promotions, which
    depend on the whole league. Where `contests` are only some teams' histories, those two have to be given.

    The blocks meet on match_id after each has been folded to one row per contest, so every
    block is shuffled once on its own key and once on the contest. `contests` should be a stored
    table: each block reads only the columns it needs from it.
    """
    base = keys.with_status(contests, include_scheduled)
    context = keys.with_derby(
        keys.with_calendar(keys.with_label(form.head_to_head(base, cfg.h2h_window, mode)), cfg.no_crowd_seasons),
        cfg.derbies,
    )
    context = joins.promoted_flags(context, promotions)
    sides = form.side_form(form.side_rows(base), cfg.windows, mode=mode)
    folded = form.fold_to_contests(
        sides, [*form.rolling_columns(cfg.windows), "rest_days", "win_streak", "loss_streak"]
    )
    own = own_ratings(base, cfg.rating) if own is None else own
    own = own.select("match_id", "rating_own_home", "rating_own_away")
    external = joins.external_ratings(base, ratings)
    market = odds.opening_probabilities(prices)
    out = (
        context.join(own, "match_id")
        .join(external, "match_id", "left")
        .join(folded, "match_id", "left")
        .join(market, "match_id", "left")
    )
    return keys.with_differences(
        out,
        {
            "rating_own_diff": ("rating_own_home", "rating_own_away"),
            "rating_ext_diff": ("rating_ext_home", "rating_ext_away"),
        },
    )
