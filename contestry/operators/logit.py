"""Multinomial logistic models, many folds and penalties fitted together.

All fits of a job advance by one Newton step per pass over the rows. A task adds up, for its
rows, each fit's gradient and curvature; Spark sums those short arrays per fit. A pass therefore
shuffles a few hundred numbers per fit and task, however many rows there are, and the driver
holds coefficients only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.functions.bounded import exact_quantiles, materialise
from contestry.functions.columns import OUTCOMES, PROBS

MAX_PASSES = 25
TOLERANCE = 1e-8
_FIT = ["league_id", "fold", "c"]


def season_order(frame: DataFrame) -> DataFrame:
    """(league_id, season, ord): running number of each league's seasons."""
    w = Window.partitionBy("league_id").orderBy("season")
    return frame.select("league_id", "season").distinct().withColumn("ord", F.row_number().over(w))


def _numbers(rows: DataFrame, cuts: DataFrame, columns: list[str], impute: bool, scale: bool) -> DataFrame:
    """Per (league, fold): fill value, mean and population deviation of each column."""
    folds = cuts.select("league_id", "fold", "cut").distinct()
    long = rows.select(
        "league_id", "ord",
        F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("x")) for j, c in enumerate(columns)])),
    )
    # counted per distinct value first, so the fan-out over folds is over values, not rows
    valued = long.groupBy("league_id", "ord", "j", "x").agg(F.count("*").alias("m"))
    per_fold = valued.join(folds, "league_id").filter(F.col("ord") < F.col("cut"))
    keys = ["league_id", "fold", "j"]
    sums = per_fold.groupBy(*keys).agg(
        F.sum("m").alias("n"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("m"))), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.col("x") * F.col("m")), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("x") * F.col("x") * F.col("m")), F.lit(0.0)).alias("q"),
    )
    if impute:
        medians = exact_quantiles(per_fold.select(*keys, "x", "m"), keys, "x", [0.5], weight="m")
        sums = sums.join(medians, keys, "left").withColumn("fill", F.coalesce("q0", F.lit(0.0)))
    else:
        sums = sums.withColumn("fill", F.lit(0.0))
    gap = F.col("n") - F.col("known") if impute else F.lit(0)
    n = F.col("n") if impute else F.greatest(F.col("known"), F.lit(1))
    mean = (F.col("s") + gap * F.col("fill")) / n
    var = (F.col("q") + gap * F.col("fill") ** 2) / n - mean**2
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return sums.select(
        *keys,
        F.col("n").alias("n_train"),
        "fill",
        (mean if scale else F.lit(0.0)).alias("mean"),
        (F.when(std > 1e-12, std).otherwise(1.0) if scale else F.lit(1.0)).alias("std"),
    )


def fit_cuts(
    rows: DataFrame,
    cuts: DataFrame,
    columns: list[str],
    impute: bool = False,
    scale: bool = True,
) -> DataFrame:
    """Coefficients per fit.

    `rows` (league_id, ord, result, columns); `cuts` (league_id, fold, cut, c): a fit trains on
    rows with ord < cut under inverse penalty c. The penalty is the usual squared norm of the
    weights, intercepts free. Returns per fit the arrays fill, mean, std and beta, the last in
    class-major order with the intercept in front.
    """
    spark = rows.sparkSession
    labelled = rows.filter(F.col("result").isNotNull()).select("league_id", "ord", "result", *columns)
    if not impute:
        for c in columns:
            labelled = labelled.filter(F.col(c).isNotNull())
    d = len(columns) + 1
    size = 3 * d
    numbers = _numbers(labelled, cuts, columns, impute, scale).groupBy("league_id", "fold").agg(
        F.sort_array(F.collect_list(F.struct("j", "fill", "mean", "std", "n_train"))).alias("k")
    )
    plan = cuts.join(numbers, ["league_id", "fold"]).select(*_FIT, "cut", "k").collect()
    fits = {}
    for i, r in enumerate(plan):
        fits[i] = {
            "key": (r["league_id"], r["fold"], r["c"]),
            "cut": r["cut"],
            "c": r["c"],
            "fill": np.array([k["fill"] for k in r["k"]]),
            "mean": np.array([k["mean"] for k in r["k"]]),
            "std": np.array([k["std"] for k in r["k"]]),
            "beta": np.zeros((3, d)),
        }
    label = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("result")) - 1
    # every pass is arithmetic on these few columns, so they are spread evenly once
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = materialise(
        labelled.select(
            "league_id", "ord", label.cast("int").alias("y"),
            *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)],
        ).repartition(spread)
    )
    active = dict(fits)
    for _ in range(MAX_PASSES):
        if not active:
            break
        totals = _sums(data, active, len(columns))
        still = {}
        for row in totals:
            fit, v = active[row["fit"]], np.array(row["v"])
            beta, c = fit["beta"], fit["c"]
            grad = v[1 : 1 + size].reshape(3, d).copy()
            curve = v[1 + size :].reshape(size, size).copy()
            grad[:, 1:] += beta[:, 1:] / c
            penalty = np.tile(np.r_[0.0, np.ones(d - 1)], 3) / c
            curve[np.diag_indices(size)] += penalty
            # Shifting all intercepts alike changes nothing; that direction, curved by rounding alone, is cut off.
            step = np.linalg.lstsq(curve, -grad.ravel(), rcond=1e-9)[0]
            biggest = np.abs(step).max()
            if biggest > 5.0:
                step *= 5.0 / biggest
            fit["beta"] = beta + step.reshape(3, d)
            if biggest > TOLERANCE:
                still[row["fit"]] = fit
        active = still
    if active:
        raise RuntimeError(f"{len(active)} logistic fits did not settle in {MAX_PASSES} passes: {sorted(f['key'] for f in active.values())[:5]}")
    return _model_rows(spark, fits)


def _model_rows(spark: SparkSession, fits: dict) -> DataFrame:
    out = [
        (int(f["key"][0]), str(f["key"][1]), float(f["key"][2]), f["fill"].tolist(), f["mean"].tolist(), f["std"].tolist(), f["beta"].ravel().tolist())
        for f in fits.values()
    ]
    schema = "league_id bigint, fold string, c double, fill array<double>, mean array<double>, std array<double>, beta array<double>"
    return spark.createDataFrame(out, schema)


def _sums(data: DataFrame, fits: dict, width: int) -> list:
    """Loss, gradient and curvature per fit, summed over all tasks."""
    by_league: dict = {}
    for i, f in fits.items():
        by_league.setdefault(f["key"][0], []).append((i, f["cut"], f["fill"], f["mean"], f["std"], f["beta"]))
    d = width + 1
    names = [f"x{j}" for j in range(width)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for league, part in b.groupby("league_id"):
                raw = part[names].to_numpy(float)
                y = part["y"].to_numpy()
                order = part["ord"].to_numpy()
                hot = np.eye(3)[y]
                for i, cut, fill, mean, std, beta in by_league.get(league, ()):
                    use = order < cut
                    if not use.any():
                        continue
                    x = raw[use]
                    x = (np.where(np.isnan(x), fill, x) - mean) / std
                    x = np.hstack([np.ones((len(x), 1)), x])
                    z = x @ beta.T
                    z -= z.max(axis=1, keepdims=True)
                    p = np.exp(z)
                    p /= p.sum(axis=1, keepdims=True)
                    v = acc.get(i)
                    if v is None:
                        v = acc[i] = np.zeros(1 + 3 * d + 9 * d * d)
                    h = hot[use]
                    v[0] -= np.log(np.maximum((p * h).sum(axis=1), 1e-300)).sum()
                    v[1 : 1 + 3 * d] += ((p - h).T @ x).ravel()
                    curve = v[1 + 3 * d :].reshape(3, d, 3, d)
                    for k in range(3):
                        for m in range(3):
                            w = p[:, k] * ((k == m) - p[:, m])
                            curve[k, :, m, :] += x.T @ (x * w[:, None])
        if acc:
            yield pd.DataFrame({"fit": list(acc), "v": [v.tolist() for v in acc.values()]})

    parts = data.mapInPandas(add, "fit int, v array<double>")
    flat = parts.select("fit", F.posexplode("v").alias("k", "x")).groupBy("fit", "k").agg(F.sum("x").alias("x"))
    return (
        flat.groupBy("fit")
        .agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
        .select("fit", F.transform("s", lambda e: e["x"]).alias("v"))
        .collect()
    )


def predict(rows: DataFrame, models: DataFrame, columns: list[str], on: list[str], impute: bool = False) -> DataFrame:
    """Adds class probabilities; a missing value takes the fit's fill (0 when nothing is imputed)."""
    d = len(columns) + 1
    joined = rows.join(models, on)
    scaled = {
        f"__z{j}": (F.coalesce(F.col(c).cast("double"), F.col("fill")[j]) - F.col("mean")[j]) / F.col("std")[j]
        for j, c in enumerate(columns)
    }
    out = joined.withColumns(scaled)
    scores = {}
    for k in range(3):
        terms = [F.col("beta")[k * d + 1 + j] * F.col(f"__z{j}") for j in range(len(columns))]
        scores[f"__s{k}"] = F.exp(sum(terms, F.col("beta")[k * d]))
    out = out.withColumns(scores)
    total = F.col("__s0") + F.col("__s1") + F.col("__s2")
    return out.withColumns({p: F.col(f"__s{k}") / total for k, p in enumerate(PROBS)}).drop(
        "fill", "mean", "std", "beta", *scaled, *scores
    )


def fit_folds(
    rows: DataFrame, tests: DataFrame, columns: list[str], cs: tuple[float, ...], impute: bool = False, scale: bool = True
) -> DataFrame:
    """One fit per test season and penalty, trained on the league's earlier seasons."""
    order = season_order(rows)
    cuts = (
        tests.select("league_id", "season")
        .join(order, ["league_id", "season"])
        .select("league_id", F.col("season").alias("fold"), F.col("ord").alias("cut"))
        .withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in cs])))
    )
    return fit_cuts(rows.join(order, ["league_id", "season"]), cuts, columns, impute, scale)


def predict_folds(rows: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    return predict(rows, models.withColumnRenamed("fold", "season"), columns, ["league_id", "season"])
