"""Bivariate Poisson score model with the low-score correction of Dixon and Coles (1997).

Fitting needs one scan. For given decay and fold the likelihood depends on the contests only
through seven weighted sums per (home, away) pair, so the contests collapse to at most
teams x teams rows per league and time block before any optimiser runs. Scoring is row-local:
the grid of scores is an array column, never a join or a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.operators.selection import weakest_teams
from contestry.settings import ScoreModelSettings

# Parameter bounds, start of the home effect, floor of the correction factor.
STRENGTH_BOUND = 3.0
HOME_BOUND = 1.0
HOME_START = 0.25
TAU_FLOOR = 1e-10
PROXY_TEAMS = 3

PAIR_SUMS = ("w", "wx", "wy", "w00", "w01", "w10", "w11")


# --- scoring -----------------------------------------------------------------------------------


def time_weight(reference: Column | str, date: Column | str, xi: Column | float) -> Column:
    decay = xi if isinstance(xi, Column) else F.lit(float(xi))
    return F.exp(-decay * F.datediff(reference, date))


def proxies(params: DataFrame, keys: list[str]) -> DataFrame:
    """Mean strength of the weakest teams per fit, inherited by unseen teams."""
    return weakest_teams(params, keys, PROXY_TEAMS).groupBy(*keys).agg(
        F.avg("attack").alias("proxy_attack"), F.avg("defence").alias("proxy_defence")
    )


def expected_goals(contests: DataFrame, params: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds lam and mu. `params` has a row per (fit, team), `fits` home_effect and rho per fit."""
    base = fits.select(*keys, "home_effect", "rho").join(proxies(params, keys), keys, "left")
    home = params.select(
        *keys, F.col("team_id").alias("home_id"), F.col("attack").alias("__ah"), F.col("defence").alias("__dh")
    )
    away = params.select(
        *keys, F.col("team_id").alias("away_id"), F.col("attack").alias("__aa"), F.col("defence").alias("__da")
    )
    rows = (
        contests.join(base, keys)
        .join(home, [*keys, "home_id"], "left")
        .join(away, [*keys, "away_id"], "left")
    )
    ah, dh = F.coalesce("__ah", "proxy_attack"), F.coalesce("__dh", "proxy_defence")
    aa, da = F.coalesce("__aa", "proxy_attack"), F.coalesce("__da", "proxy_defence")
    return rows.withColumns(
        {"lam": F.exp(ah - da + F.col("home_effect")), "mu": F.exp(aa - dh)}
    ).drop("__ah", "__dh", "__aa", "__da", "proxy_attack", "proxy_defence", "home_effect")


def tau(i: Column, j: Column, lam: Column, mu: Column, rho: Column) -> Column:
    return (
        F.when((i == 0) & (j == 0), 1 - lam * mu * rho)
        .when((i == 0) & (j == 1), 1 + lam * rho)
        .when((i == 1) & (j == 0), 1 + mu * rho)
        .when((i == 1) & (j == 1), 1 - rho)
        .otherwise(1.0)
    )


def _cell(i: int, j: int) -> Column:
    """Unscaled probability of one score; the four low scores carry the correction."""
    return F.col(f"__c{i}{j}") if i < 2 and j < 2 else F.col(f"__h{i}") * F.col(f"__a{j}")


def with_marginals(rows: DataFrame, max_goals: int = 10) -> DataFrame:
    """Adds the two Poisson marginals, their running sums, the corrected low scores and class sums.

    Written out as plain columns: arithmetic stays in generated code, and what several
    expressions use is worked out once per row.
    """
    goals = range(max_goals + 1)
    lam, mu, rho = F.col("lam"), F.col("mu"), F.col("rho")
    marginals = {}
    for k in goals:
        marginals[f"__h{k}"] = F.exp(-lam) * F.pow(lam, F.lit(k)) / F.lit(float(math.factorial(k)))
        marginals[f"__a{k}"] = F.exp(-mu) * F.pow(mu, F.lit(k)) / F.lit(float(math.factorial(k)))
    out = rows.withColumns(marginals)
    derived = {}
    for i in (0, 1):
        for j in (0, 1):
            factor = tau(F.lit(i), F.lit(j), lam, mu, rho)
            derived[f"__c{i}{j}"] = F.greatest(F.col(f"__h{i}") * F.col(f"__a{j}") * factor, F.lit(0.0))
    for x in "ha":
        for k in range(1, max_goals):
            terms = [F.col(f"__{x}{m}") for m in range(k + 1)]
            derived[f"__{x}sum{k}"] = sum(terms[1:], terms[0])
    out = out.withColumns(derived)
    high = range(2, max_goals + 1)
    classes = {
        "__cls_home": sum((F.col(f"__h{i}") * F.col(f"__asum{i - 1}") for i in high), F.col("__c10")),
        "__cls_draw": sum((F.col(f"__h{i}") * F.col(f"__a{i}") for i in high), F.col("__c00") + F.col("__c11")),
        "__cls_away": sum((F.col(f"__a{j}") * F.col(f"__hsum{j - 1}") for j in high), F.col("__c01")),
    }
    out = out.withColumns(classes)
    return out.withColumn("__cls_all", F.col("__cls_home") + F.col("__cls_draw") + F.col("__cls_away"))


def _without_marginals(frame: DataFrame) -> DataFrame:
    return frame.drop(*[c for c in frame.columns if c.startswith(("__h", "__a", "__c"))])


def _grid(max_goals: int) -> Column:
    goals = range(max_goals + 1)
    return F.array(*[_cell(i, j) / F.col("__cls_all") for i in goals for j in goals])


def with_grid(rows: DataFrame, max_goals: int = 10) -> DataFrame:
    """Adds `grid`: score probabilities in row-major order, summing to one."""
    return _without_marginals(with_marginals(rows, max_goals).withColumn("grid", _grid(max_goals)))


def grid_rows(rows: DataFrame, keep: list[str], max_goals: int = 10) -> DataFrame:
    """Long form. Cell numbers are exploded, not the grid: exploding a computed array makes the
    optimizer push a size test of the whole expression below its inputs."""
    side = max_goals + 1
    cells = with_grid(rows, max_goals).select(
        *keep, "grid", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k")
    )
    return cells.select(
        *keep,
        F.floor(F.col("k") / side).cast("int").alias("hg"),
        (F.col("k") % side).alias("ag"),
        F.get("grid", F.col("k")).alias("p"),
    )


def _likely_score(frame: DataFrame, max_goals: int) -> DataFrame:
    """Most likely score; the first cell in row-major order wins a tie."""
    side = max_goals + 1
    gridded = frame.withColumn("__cells", _grid(max_goals)).withColumn("pred_score_prob", F.array_max("__cells"))
    found = gridded.withColumn("__at", F.array_position("__cells", F.col("pred_score_prob")).cast("int") - 1)
    score = F.concat_ws("-", F.floor(F.col("__at") / side).cast("int"), F.col("__at") % side)
    return found.withColumn("pred_score", score).drop("__cells", "__at")


def _margins(frame: DataFrame, max_goals: int) -> DataFrame:
    """Goal-difference distributions given a home win and given an away win.

    Entry g - 1 is the probability of a margin of g; without any mass the margin is one.
    """
    fallback = F.array(*[F.lit(1.0 if g == 0 else 0.0) for g in range(max_goals)])
    out = {}
    for name, total, home in (("home_margin", "__cls_home", True), ("away_margin", "__cls_away", False)):
        sums = []
        for g in range(1, max_goals + 1):
            cells = [_cell(j + g, j) if home else _cell(j, j + g) for j in range(max_goals + 1 - g)]
            sums.append(F.try_divide(sum(cells[1:], cells[0]), F.col(total)))
        out[name] = F.when(F.col(total) > 0, F.array(*sums)).otherwise(fallback)
    return frame.withColumns(out)


def with_score_columns(rows: DataFrame, max_goals: int = 10, likely: bool = False, margins: bool = False) -> DataFrame:
    """Adds outcome probabilities to rows with lam, mu and rho; on request likely score, margins."""
    out = with_marginals(rows, max_goals)
    out = out.withColumns({f"p_{c}": F.col(f"__cls_{c}") / F.col("__cls_all") for c in ("home", "draw", "away")})
    if likely:
        out = _likely_score(out, max_goals)
    if margins:
        out = _margins(out, max_goals)
    return _without_marginals(out)


def scored(
    contests: DataFrame,
    params: DataFrame,
    fits: DataFrame,
    keys: list[str],
    max_goals: int = 10,
    likely: bool = False,
    margins: bool = False,
) -> DataFrame:
    """Contests with lam, mu and outcome probabilities, on request likely score and margins.

    A grid depends on the fit and the pairing only, so it is worked out once per distinct
    pairing, of which a league has at most teams squared, and joined back.
    """
    pairings = contests.select(*keys, "home_id", "away_id").distinct()
    out = with_score_columns(expected_goals(pairings, params, fits, keys), max_goals, likely, margins)
    return contests.join(out.drop("rho"), [*keys, "home_id", "away_id"])


def negative_log_likelihood(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Weighted negative log-likelihood per fit of rows that carry lam, mu and rho."""
    x, y, lam, mu = F.col("home_goals"), F.col("away_goals"), F.col("lam"), F.col("mu")
    correction = F.greatest(tau(x, y, lam, mu, F.col("rho")), F.lit(TAU_FLOOR))
    ll = F.ln(correction) + x * F.ln(lam) - lam + y * F.ln(mu) - mu
    return rows.groupBy(*keys).agg((-F.sum(F.col(weight) * ll)).alias("nll"))


# --- fitting -----------------------------------------------------------------------------------


def pair_sums(contests: DataFrame, xis: tuple[float, ...], anchor: str) -> DataFrame:
    """Sufficient sums per (league, xi, block, home, away).

    `contests` carries `ord`, the block a contest belongs to. Weights are relative to a fixed
    anchor date: the scale of the weights does not move the maximum.
    """
    x, y = F.col("home_goals"), F.col("away_goals")
    decayed = contests.filter(x.isNotNull() & y.isNotNull()).withColumn(
        "xi", F.explode(F.array(*[F.lit(float(v)) for v in xis]))
    )
    w = time_weight(F.lit(anchor).cast("date"), F.col("date"), F.col("xi"))
    return (
        decayed.withColumn("w", w)
        .groupBy("league_id", "xi", "ord", "home_id", "away_id")
        .agg(
            F.sum("w").alias("w"),
            F.sum(F.col("w") * x).alias("wx"),
            F.sum(F.col("w") * y).alias("wy"),
            *[
                F.sum(F.when((x == i) & (y == j), F.col("w")).otherwise(0.0)).alias(f"w{i}{j}")
                for i in (0, 1)
                for j in (0, 1)
            ],
        )
    )


def _solve(pairs: pd.DataFrame, teams: np.ndarray, start: np.ndarray, rho_bound: float) -> np.ndarray:
    """Projected Newton ascent on the pair sums; parameters are attack, defence, home, rho."""
    n = len(teams)
    h = np.searchsorted(teams, pairs["home_id"].to_numpy())
    a = np.searchsorted(teams, pairs["away_id"].to_numpy())
    s = pairs[list(PAIR_SUMS)].to_numpy(float)
    s = s / s[:, 0].sum() * len(s)
    w, wx, wy, w00, w01, w10, w11 = s.T
    bound = np.concatenate([np.full(2 * n, STRENGTH_BOUND), [HOME_BOUND, rho_bound]])
    cols1 = np.stack([h, n + a, np.full_like(h, 2 * n)])
    cols2 = np.stack([a, n + h])
    sign1, sign2 = np.array([1.0, -1.0, 1.0]), np.array([1.0, -1.0])
    gauge = w.sum()

    def parts(theta):
        eta1 = theta[h] - theta[n + a] + theta[2 * n]
        eta2 = theta[a] - theta[n + h]
        lam, mu, rho = np.exp(eta1), np.exp(eta2), theta[2 * n + 1]
        t00 = np.maximum(1 - lam * mu * rho, TAU_FLOOR)
        t01 = np.maximum(1 + lam * rho, TAU_FLOOR)
        t10 = np.maximum(1 + mu * rho, TAU_FLOOR)
        t11 = max(1 - rho, TAU_FLOOR)
        return eta1, eta2, lam, mu, rho, t00, t01, t10, t11

    def loss(theta):
        eta1, eta2, lam, mu, _, t00, t01, t10, t11 = parts(theta)
        ll = wx * eta1 - w * lam + wy * eta2 - w * mu
        ll = ll + w00 * np.log(t00) + w01 * np.log(t01) + w10 * np.log(t10) + w11 * np.log(t11)
        return -ll.sum() + 0.5 * gauge * theta[:n].sum() ** 2

    def slopes(theta):
        _, _, lam, mu, rho, t00, t01, t10, t11 = parts(theta)
        c00 = -w00 * lam * mu / t00
        g1 = wx - w * lam + c00 * rho + w01 * lam * rho / t01
        g2 = wy - w * mu + c00 * rho + w10 * mu * rho / t10
        grad = np.zeros(2 * n + 2)
        for c, sg in zip(cols1, sign1, strict=True):
            np.add.at(grad, c, sg * g1)
        for c, sg in zip(cols2, sign2, strict=True):
            np.add.at(grad, c, sg * g2)
        grad[2 * n + 1] = (c00 + w01 * lam / t01 + w10 * mu / t10 - w11 / t11).sum()
        curve = np.zeros((2 * n + 2, 2 * n + 2))
        for ci, si in zip(cols1, sign1, strict=True):
            for cj, sj in zip(cols1, sign1, strict=True):
                np.add.at(curve, (ci, cj), si * sj * w * lam)
        for ci, si in zip(cols2, sign2, strict=True):
            for cj, sj in zip(cols2, sign2, strict=True):
                np.add.at(curve, (ci, cj), si * sj * w * mu)
        curve[2 * n + 1, 2 * n + 1] = (
            w00 * (lam * mu / t00) ** 2 + w01 * (lam / t01) ** 2 + w10 * (mu / t10) ** 2 + w11 / t11**2
        ).sum()
        grad = -grad
        grad[:n] += gauge * theta[:n].sum()
        curve[:n, :n] += gauge
        return grad, curve

    theta, value = np.clip(start, -bound, bound), None
    value = loss(theta)
    for _ in range(200):
        grad, curve = slopes(theta)
        held = ((theta >= bound) & (grad < 0)) | ((theta <= -bound) & (grad > 0))
        free = ~held
        block = curve[np.ix_(free, free)]
        block[np.diag_indices_from(block)] += 1e-9 * max(1.0, np.trace(block) / len(block))
        step = np.zeros_like(theta)
        step[free] = -np.linalg.solve(block, grad[free])
        scale, moved = 1.0, False
        while scale > 1e-8:
            trial = np.clip(theta + scale * step, -bound, bound)
            trial_value = loss(trial)
            if trial_value <= value + 1e-4 * (grad @ (trial - theta)):
                moved = True
                break
            scale /= 2
        if not moved:
            break
        change = np.abs(trial - theta).max()
        theta, value = trial, trial_value
        if change < 1e-10:
            break
    return theta


def fit_score_model(
    sums: DataFrame, folds: DataFrame, cfg: ScoreModelSettings, xis: tuple[float, ...] | None = None
) -> DataFrame:
    """One row per (league, xi, fold, team) with attack, defence, home_effect and rho.

    `folds` (league_id, fold, cut): a fold trains on all blocks with ord < cut. A league's folds
    are solved in time order inside one task, each from the previous solution; leagues and
    decay candidates run in parallel. A task sees pair sums, whose number depends on the
    league's teams and calendar only.
    """
    team_type = sums.schema["home_id"].dataType.simpleString()
    schema = (
        f"league_id bigint, xi double, fold string, team_id {team_type}, attack double, "
        "defence double, home_effect double, rho double"
    )
    rho_bound = cfg.rho_bound

    def fit(key: tuple, pairs: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        out, previous = [], {}
        if pairs.empty or cuts.empty:
            return pd.DataFrame(columns=["league_id", "xi", "fold", "team_id", "attack", "defence", "home_effect", "rho"])
        train, done = pairs.iloc[:0], -np.inf
        for cut, names in cuts.groupby("cut", sort=True):
            fresh = pairs[(pairs["ord"] < cut) & (pairs["ord"] >= done)]
            done = cut
            train = pd.concat([train, fresh]).groupby(["home_id", "away_id"], as_index=False)[list(PAIR_SUMS)].sum()
            if train.empty:
                continue
            teams = np.unique(np.concatenate([train["home_id"], train["away_id"]]))
            n = len(teams)
            start = np.zeros(2 * n + 2)
            start[2 * n] = previous.get("home", HOME_START)
            start[2 * n + 1] = previous.get("rho", 0.0)
            for i, team in enumerate(teams):
                start[i], start[n + i] = previous.get(("t", team), (0.0, 0.0))
            theta = _solve(train, teams, start, rho_bound)
            previous = {("t", t): (theta[i], theta[n + i]) for i, t in enumerate(teams)}
            previous.update(home=theta[2 * n], rho=theta[2 * n + 1])
            for fold in names["fold"]:
                out.append(
                    pd.DataFrame(
                        {
                            "league_id": key[0],
                            "xi": key[1],
                            "fold": fold,
                            "team_id": teams,
                            "attack": theta[:n],
                            "defence": theta[n : 2 * n],
                            "home_effect": theta[2 * n],
                            "rho": theta[2 * n + 1],
                        }
                    )
                )
        if not out:
            return pd.DataFrame(columns=["league_id", "xi", "fold", "team_id", "attack", "defence", "home_effect", "rho"])
        return pd.concat(out, ignore_index=True)

    candidates = F.array(*[F.lit(float(v)) for v in (xis or cfg.candidates)])
    # fresh column identities: sums and folds often come from the same contests
    cuts = folds.select(
        (F.col("league_id") + F.lit(0)).alias("league_id"),
        F.col("fold").alias("fold"),
        F.col("cut").cast("long").alias("cut"),
        F.explode(candidates).alias("xi"),
    )
    return (
        sums.groupBy("league_id", "xi")
        .cogroup(cuts.groupBy("league_id", "xi"))
        .applyInPandas(fit, schema)
    )


def split_fit(fitted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(params per team, fits) tables of a fitted score model."""
    fits = fitted.groupBy(*keys).agg(F.first("home_effect").alias("home_effect"), F.first("rho").alias("rho"))
    return fitted.select(*keys, "team_id", "attack", "defence"), fits
