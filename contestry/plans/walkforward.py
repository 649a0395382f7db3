"""Walk-forward fits, candidate choice, calibration, stacking and prediction.

Everything between a fit and a score is one long probability frame:
(league_id, season, match_id, component, candidate, p_home, p_draw, p_away, result).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.bounded import materialise
from contestry.functions.columns import PROBS, first_argmax
from contestry.operators import aggregates, boosting, calibrate, keys, logit, odds, score_model, stacking, trees
from contestry.operators.selection import best_candidate
from contestry.settings import Settings

LINEAR = list(keys.LINEAR_DIFFERENCES)
COMPONENTS = {
    keys.WITH_MARKET: ("score_model", "trees_with_market", "market"),
    keys.NO_MARKET: ("score_model", "trees_no_market", "linear"),
}
POOL = ["league_id", "season", "match_id", "home_id", "away_id", "component", "candidate", *PROBS, "result"]


def _pool_rows(scored: DataFrame, component: str, candidate=0.0) -> DataFrame:
    cand = candidate if not isinstance(candidate, float) else F.lit(candidate)
    return scored.withColumns({"component": F.lit(component), "candidate": cand}).select(*POOL)


def with_linear_inputs(features: DataFrame) -> DataFrame:
    return keys.with_differences(features, keys.LINEAR_DIFFERENCES)


def score_model_fits(features: DataFrame, folds: DataFrame, settings: Settings, xis=None) -> DataFrame:
    """`features` carries ord; weights are anchored at the calendar date of the last contest."""
    cfg = settings.models.score
    anchor = str(features.agg(F.max("date")).first()[0])
    sums = score_model.pair_sums(features, tuple(xis or cfg.candidates), anchor)
    return score_model.fit_score_model(sums, folds, cfg, xis)


def score_model_probs(rows: DataFrame, fitted: DataFrame, fit_keys: list[str], max_goals: int) -> DataFrame:
    params, fits = score_model.split_fit(fitted, fit_keys)
    return score_model.scored(rows, params, fits, fit_keys, max_goals)


def tree_columns(features: DataFrame, variant: str) -> list[str]:
    skip = {"ord", *LINEAR} - {"rating_ext_diff", "rating_own_diff"}
    return [c for c in keys.variant_columns(features.columns, variant) if c not in skip]


def season_pool(features: DataFrame, settings: Settings, variants=(keys.WITH_MARKET, keys.NO_MARKET)) -> DataFrame:
    """Out-of-fold pool: each season from the second on, predicted by fits on earlier seasons."""
    known = features.filter(F.col("result").isNotNull())
    order = logit.season_order(known)
    rows = materialise(with_linear_inputs(known).join(order, ["league_id", "season"]))
    folds = order.filter(F.col("ord") > 1).select("league_id", F.col("season").alias("fold"), F.col("ord").alias("cut"))
    test = rows.join(order.filter(F.col("ord") > 1).select("league_id", "season"), ["league_id", "season"], "left_semi")

    fitted = materialise(score_model_fits(rows, folds, settings)).withColumnRenamed("fold", "season")
    xis = F.array(*[F.lit(float(v)) for v in settings.models.score.candidates])
    asked = test.select("league_id", "season", "match_id", "home_id", "away_id", "result", F.explode(xis).alias("xi"))
    scored = score_model_probs(asked, fitted, ["league_id", "season", "xi"], settings.models.score.max_goals)
    parts = [_pool_rows(scored, "score_model", F.col("xi"))]

    cuts = folds.withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in settings.models.linear.candidates])))
    linear = logit.fit_cuts(rows, cuts, LINEAR, impute=True, scale=True)
    parts.append(_pool_rows(logit.predict_folds(test, linear, LINEAR), "linear", F.col("c")))

    first_xi = settings.models.score.candidates[0]
    fallback = parts[0].filter(F.col("candidate") == first_xi).select("match_id", *[F.col(p).alias(f"f_{p}") for p in PROBS])
    market = odds.market_or_fallback(test.join(fallback, "match_id"), tuple(f"f_{p}" for p in PROBS))
    if keys.WITH_MARKET in variants:
        parts.append(_pool_rows(market, "market"))

    for v in variants:
        cols = tree_columns(rows, v)
        asked = test.select("league_id", F.col("season").alias("fold"), "match_id", *[c for c in cols if c != "season"])
        found = boosting.fit_predict(rows, folds, asked, cols, settings.models.trees, write=False)  # written with the pool
        mine = test.drop(*PROBS).join(found.drop("league_id", "fold"), "match_id")
        parts.append(_pool_rows(mine, f"trees_{v}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialise(out)


def scoped(pool: DataFrame, scopes: DataFrame) -> DataFrame:
    """Pool rows under every scope they may inform: `scopes` (league_id, scope, before)."""
    return pool.join(scopes, "league_id").filter(F.col("season") < F.col("before")).drop("before")


def choose_candidates(scoped_pool: DataFrame) -> DataFrame:
    """Per scope and component the candidate with the lowest mean season loss."""
    group = ["league_id", "scope", "component", "candidate"]
    means = aggregates.mean_of_seasons(aggregates.evaluate(scoped_pool, [*group, "season"]), group)
    return best_candidate(means.withColumn("ordinal", F.col("candidate")), group[:3], "candidate", "ordinal", "log_loss").drop("log_loss")


def calibrate_and_weigh(scoped_pool: DataFrame, settings: Settings, variants=(keys.WITH_MARKET, keys.NO_MARKET)):
    """(chosen candidates, calibrators, weights) for all scopes at once.

    Weights are searched on components calibrated without the season they are scored on; the
    calibrators handed back are fitted on the whole scope. A one-season scope stays raw.
    """
    scope = ["league_id", "scope"]
    chosen = materialise(choose_candidates(scoped_pool))
    # Spread evenly once: every row is looked up among thresholds below.
    spread = int(scoped_pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool = materialise(scoped_pool.join(chosen, [*scope, "component", "candidate"], "left_semi").repartition(spread))
    loso = materialise(calibrate.fit_leave_one_out(pool, scope, [*scope, "component"])).withColumnRenamed("held_out", "season")
    on = [*scope, "component", "season"]
    honest = calibrate.apply_isotonic(pool, loso, on).select("scope", *POOL)
    single = pool.join(loso.select(*on), on, "left_anti").select("scope", *POOL)
    honest = materialise(honest.unionByName(single))
    calibrators = materialise(calibrate.fit_isotonic(pool, [*scope, "component"]))
    weights = None
    for v in variants:
        w = stacking.optimal_weights(honest, scope, COMPONENTS[v], settings.models.weight_step).withColumn("variant", F.lit(v))
        weights = w if weights is None else weights.unionByName(w)
    return chosen, calibrators, materialise(weights)


def blended(raw: DataFrame, calibrators: DataFrame, weights: DataFrame, variants, carry: list[str]) -> DataFrame:
    """Calibrated components (per component) and their blends, in one long frame with `model`."""
    scope = ["league_id", "scope"]
    calibrated = calibrate.apply_isotonic(raw, calibrators, [*scope, "component"])
    plain = raw.join(calibrators.select(*scope, "component"), [*scope, "component"], "left_anti")
    calibrated = calibrated.select(*raw.columns).unionByName(plain)  # what has no calibrator stays as it is
    out = None
    for v in variants:
        part = calibrated.filter(F.col("component").isin(list(COMPONENTS[v])))
        mix = stacking.blend(part, weights.filter(F.col("variant") == v), scope, carry).withColumn("model", F.lit(f"ensemble_{v}"))
        own = calibrated.filter(F.col("component") == f"trees_{v}").withColumn("model", F.col("component"))
        cols = [*scope, "match_id", *carry, "model", *PROBS]
        both = mix.select(*cols).unionByName(own.select(*cols))
        out = both if out is None else out.unionByName(both)
    return out


def market_component(raw_score: DataFrame, rows: DataFrame, calibrators: DataFrame, carry: list[str]) -> DataFrame:
    """Opening-price component; contests without prices take the calibrated score model."""
    fixed = calibrate.apply_isotonic(raw_score, calibrators, ["league_id", "scope", "component"])
    prices = rows.select("match_id", *keys.MARKET_COLUMNS)
    joined = fixed.join(prices, "match_id")
    return odds.market_or_fallback(joined, PROBS).withColumn("component", F.lit("market")).select(
        "league_id", "scope", "match_id", *carry, "component", *PROBS
    )


def untried(pool: DataFrame, settings: Settings, variants) -> tuple[DataFrame, DataFrame]:
    """(candidates, weights) for validating a league whose pool is its last season alone.

    Nothing earlier can choose or weigh there: the first candidates and equal weights, uncalibrated."""
    lone = pool.groupBy("league_id").agg(F.count_distinct("season").alias("n")).filter("n = 1").select("league_id", F.lit("validation").alias("scope"))
    first = {"score_model": settings.models.score.candidates[0], "linear": settings.models.linear.candidates[0]}
    names = sorted({c for v in variants for c in COMPONENTS[v]})
    candidates = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(float(first.get(c, 0.0))).alias("candidate")) for c in names])
    equal = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), F.lit(c).alias("component"), F.lit(1 / len(COMPONENTS[v])).alias("weight"))
            for v in variants
            for c in COMPONENTS[v]
        ]
    )
    weights = lone.select("league_id", "scope", F.inline(equal)).withColumn("loss", F.lit(None).cast("double"))
    return lone.select("league_id", "scope", F.inline(candidates)), weights


@dataclass
class Bundle:
    """A complete training result: small tables, tree models and validation scores."""

    settings: Settings
    score_fit: DataFrame
    linear_fit: DataFrame
    tree_models: dict[str, trees.TreeModel]
    calibrators: DataFrame
    weights: DataFrame
    chosen: DataFrame
    validation: DataFrame
    variants: tuple[str, ...]


def train(features: DataFrame, settings: Settings, variants=(keys.WITH_MARKET, keys.NO_MARKET), pool: DataFrame | None = None) -> Bundle:
    """Validation on the last season with everything fitted before it, then the final refit."""
    known = features.filter(F.col("result").isNotNull())
    if known.groupBy("league_id").agg(F.count_distinct("season").alias("n")).filter(F.col("n") < 2).isEmpty() is False:
        raise ValueError("every league needs at least two seasons to validate in time order")
    pool = season_pool(features, settings, variants) if pool is None else pool
    last = pool.groupBy("league_id").agg(F.max("season").alias("last"))
    scopes = last.select(
        "league_id",
        F.inline(
            F.array(
                F.struct(F.lit("validation").alias("scope"), F.col("last").alias("before")),
                F.struct(F.lit("final").alias("scope"), F.lit("~").alias("before")),
            )
        ),
    )
    chosen, calibrators, weights = calibrate_and_weigh(scoped(pool, scopes), settings, variants)
    first_chosen, equal = untried(pool, settings, variants)
    chosen, weights = chosen.unionByName(first_chosen), weights.unionByName(equal)

    carry = ["season", "home_id", "away_id", "result"]
    val_pool = pool.join(last.withColumnRenamed("last", "season"), ["league_id", "season"], "left_semi")
    val_chosen = chosen.filter(F.col("scope") == "validation")
    val_raw = val_pool.join(val_chosen, ["league_id", "component", "candidate"]).select("league_id", "scope", "match_id", *carry, "component", *PROBS)
    validation = aggregates.evaluate(blended(val_raw, calibrators, weights, variants, carry), ["league_id", "model"])

    final = chosen.filter(F.col("scope") == "final").select("league_id", "component", "candidate")
    rows = materialise(with_linear_inputs(known).withColumn("ord", F.lit(0)))
    fold = rows.select("league_id").distinct().select("league_id", F.lit("final").alias("fold"), F.lit(1).alias("cut"))
    picked_xi = final.filter(F.col("component") == "score_model").select("league_id", F.col("candidate").alias("xi"))
    score_fit = score_model_fits(rows, fold, settings).join(picked_xi, ["league_id", "xi"], "left_semi")
    picked_c = final.filter(F.col("component") == "linear").select("league_id", F.col("candidate").alias("c"))
    linear_fit = logit.fit_cuts(rows, fold.join(picked_c, "league_id"), LINEAR, impute=True, scale=True)
    tree_models = trees.fit_variants(rows, {v: tree_columns(rows, v) for v in variants}, settings.models.trees)
    only_final = lambda df: df.filter(F.col("scope") == "final")
    return Bundle(settings, materialise(score_fit), linear_fit, tree_models, only_final(calibrators), only_final(weights), chosen, validation, tuple(variants))


def predict(bundle: Bundle, rows: DataFrame, variant: str) -> DataFrame:
    """Full prediction row per contest: blended outcome, likely score and expected goals."""
    goals = bundle.settings.models.score.max_goals
    base = with_linear_inputs(rows)
    params, fits = score_model.split_fit(bundle.score_fit, ["league_id"])
    scored = score_model.scored(base, params, fits, ["league_id"], goals, likely=True, margins=True)
    scored = materialise(scored.withColumn("scope", F.lit("final")))
    carry = ["season", "date", "home_id", "away_id"]
    head = ["league_id", "scope", "match_id", *carry, "component", *PROBS]
    raw_score = scored.withColumn("component", F.lit("score_model")).select(*head)
    tree_rows = trees.predict_trees(bundle.tree_models[variant], base.withColumn("scope", F.lit("final")))
    parts = raw_score.unionByName(tree_rows.withColumn("component", F.lit(f"trees_{variant}")).select(*head))
    if variant == keys.WITH_MARKET:
        parts = parts.unionByName(market_component(raw_score, base, bundle.calibrators, carry).select(*head))
    else:
        third = logit.predict(base.withColumn("scope", F.lit("final")), bundle.linear_fit.drop("fold"), LINEAR, ["league_id"])
        parts = parts.unionByName(third.withColumn("component", F.lit("linear")).select(*head))
    mixed = blended(parts, bundle.calibrators, bundle.weights, (variant,), carry)
    mixed = mixed.filter(F.col("model") == f"ensemble_{variant}").drop("scope", "model")
    extra = scored.select(
        "match_id", "pred_score", "pred_score_prob", "home_margin", "away_margin",
        F.col("lam").alias("expected_goals_h"), F.col("mu").alias("expected_goals_a"),
        *(["matchday"] if "matchday" in scored.columns else []),
    )
    return mixed.withColumn("pred_result", first_argmax()).join(extra, "match_id")
