"""Isotonic calibration: every fit of a job in one pass, applied as plain columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.bounded import materialise
from contestry.functions.columns import OUTCOMES, PROBS

# Calibrated probabilities never fall below the floor; small pools stay raw.
FLOOR = 0.01
MIN_ROWS = 300


def leave_one_out(pool: DataFrame, keys: tuple[str, ...] = ("league_id",)) -> DataFrame:
    """Every row under each season it is *not* part of, as `held_out`.

    The season list per key is a calendar-bounded array, so rows multiply by the number of
    seasons and no pair of rows is ever formed.
    """
    seasons = pool.groupBy(*keys).agg(F.collect_set("season").alias("__all"))
    return (
        pool.join(seasons, list(keys))
        .withColumn("held_out", F.explode(F.array_except("__all", F.array("season"))))
        .drop("__all")
    )


def _pool_blocks(rows: list[tuple]) -> list[list[float]]:
    """Adjacent pools [x_min, x_max, weight, sum] with rising means."""
    pools: list[list[float]] = []
    for lo, hi, w, s in rows:
        pools.append([lo, hi, w, s])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, hi_last, w_last, s_last = pools.pop()
            pools[-1][1] = hi_last
            pools[-1][2] += w_last
            pools[-1][3] += s_last
    return pools


def _joined(pools: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Columns [x_min, x_max, weight, sum] with those from one of `begins` up to the next made one."""
    lo, hi, w, s = pools
    ends = np.append(begins[1:], len(lo)) - 1
    return np.stack([lo[begins], hi[ends], np.add.reduceat(w, begins), np.add.reduceat(s, begins)])


def _pooled(pools: np.ndarray) -> np.ndarray:
    """_pool_blocks() of columns [x_min, x_max, weight, sum]: whole runs of falling means at once.

    Weights and sums are whole numbers, so the order of pooling does not show. What few runs are left goes one by one."""
    while pools.shape[1] > 1:
        _, _, w, s = pools
        begins = np.flatnonzero(np.r_[True, s[:-1] * w[1:] < s[1:] * w[:-1]])
        before = pools.shape[1]
        if len(begins) == before:
            return pools
        pools = _joined(pools, begins)
        if len(begins) > 0.9 * before:
            return np.array(_pool_blocks(list(map(tuple, pools.T.tolist())))).T
    return pools


def _long(rows: DataFrame, carry: list[str]) -> DataFrame:
    """A row per known result and class: the class's probability x, and whether it came true."""
    label = F.col("result")
    return rows.filter(label.isNotNull()).select(
        *carry,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(o).alias("class"), F.col(p).alias("x"), (label == o).cast("double").alias("y"))
                    for o, p in zip(OUTCOMES, PROBS, strict=True)
                ]
            )
        ),
    )


def _thresholds(pools: np.ndarray, min_rows: int) -> tuple[list[float], list[float]]:
    if pools[2].sum() < min_rows:
        return [0.0, 1.0], [0.0, 1.0]
    xs, ys = [], []
    for lo, hi, w, s in pools.T.tolist():
        for x in dict.fromkeys((lo, hi)):
            xs.append(x)
            ys.append(s / w)
    return xs, ys


def _by_class(fits: DataFrame, keys: list[str]) -> DataFrame:
    at = {o: F.col("class") == o for o in OUTCOMES}
    return fits.groupBy(*keys).agg(
        *[F.max(F.when(at[o], F.col(v))).alias(f"{v}_{o}") for o in OUTCOMES for v in ("xs", "ys")]
    )


_POOL = ["x_min", "x_max", "w", "s"]


def fit_isotonic(rows: DataFrame, keys: list[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Monotone fits of outcome on probability per key and class.

    Returns per key the threshold arrays xs_H, ys_H, ... . Equal probabilities are averaged
    first. Rows are then range-partitioned by (key, class, probability), which splits a large
    key over many tasks; each task pools its own stretch and only the pools meet again.
    Pooling stretches first gives the same fit. Keys with few rows get the identity.
    """
    group = [*keys, "class"]
    averaged = _long(rows, keys).groupBy(*group, "x").agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("s"))
    types = dict(averaged.dtypes)
    head = ", ".join(f"`{g}` {types[g]}" for g in group)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pools = None, np.empty((4, 0))

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*current, *p) for p in pools.T.tolist()], columns=[*group, *_POOL])

        for b in batches:
            for key, part in b.groupby(group, sort=False, dropna=False):
                if current is not None and key != current:
                    yield out()
                    pools = np.empty((4, 0))
                current = key
                pools = _pooled(np.hstack([pools, part[["x", "x", "w", "s"]].to_numpy(float).T]))
        if current is not None:
            yield out()

    def final(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x_min", kind="stable")
        xs, ys = _thresholds(_pooled(part[_POOL].to_numpy(float).T), min_rows)
        return pd.DataFrame([(*key, xs, ys)], columns=[*group, "xs", "ys"])

    ranged = averaged.repartitionByRange(*group, "x").sortWithinPartitions(*group, "x")
    pooled = ranged.mapInPandas(local, f"{head}, x_min double, x_max double, w double, s double")
    fits = pooled.groupBy(*group).applyInPandas(final, f"{head}, xs array<double>, ys array<double>")
    return _by_class(fits, keys)


def fit_leave_one_out(rows: DataFrame, scope: list[str], keys: list[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """fit_isotonic(leave_one_out(rows, scope), [*keys, "held_out"]); `keys` begin with those of `scope`.

    A row is not written once per season it is held for: a task pools its stretch without each of the
    seasons it has, and with all of them, which stands for the seasons it lacks.
    """
    seasons = rows.groupBy(*scope).agg(F.collect_set("season").alias("__all"))
    group = [*keys, "class"]
    counts = _long(rows.filter(F.expr(" and ".join(f"`{k}` is not null" for k in scope))), [*keys, "season"])
    # Read twice, once to find the ranges.
    averaged = materialise(counts.groupBy(*group, "season", "x").agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("s")))
    types = dict(averaged.dtypes)
    head = ", ".join(f"`{g}` {types[g]}" for g in group)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, current, tail, pools = TaskContext.get().partitionId(), None, None, {}

        def add(part: pd.DataFrame) -> None:
            if not len(part):
                return
            x, w, s = (part[c].to_numpy(float) for c in ("x", "w", "s"))
            codes, found = pd.factorize(part["season"])
            for season in found:  # until its first row a season's pools are those of all rows
                pools.setdefault(season, pools[None])
            for season in pools:
                own = codes != np.flatnonzero(found == season)[0] if season in found else np.ones(len(x), bool)
                if own.any():
                    points = np.stack([x, x, w, s])[:, own]
                    values = pd.Series(points[0])
                    same = (values == values.shift()) | (values.isna() & values.shift(fill_value=0.0).isna())
                    points = _joined(points, np.flatnonzero(~same.to_numpy()))
                    pools[season] = _pooled(np.hstack([pools[season], points]))

        def out() -> pd.DataFrame:
            # The first line of a season says that the stretch has it, even if nothing is left without it.
            lines = [(*current, task, season, *p) for season, own in pools.items() for p in [(0.0,) * 4, *own.T.tolist()]]
            return pd.DataFrame(lines, columns=[*group, "task", "held_out", *_POOL])

        for b in batches:
            for key, part in b.groupby(group, sort=False, dropna=False):
                if current is not None and key != current:
                    add(tail)
                    yield out()
                    tail = None
                if tail is None:
                    pools = {None: np.empty((4, 0))}
                else:
                    part = pd.concat([tail, part])
                current = key
                x = part["x"].to_numpy(float)
                upto = np.argmax(x == x[-1]) if x[-1] == x[-1] else 0  # more rows of the last value may follow
                add(part.iloc[:upto])
                tail = part.iloc[upto:]
        if current is not None:
            add(tail)
            yield out()

    def final(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        stretches = [own for _, own in part.groupby("task", sort=False)]
        out = []
        for season in part["__all"].iloc[0]:
            chosen = []
            for own in stretches:
                without = own["held_out"] == season
                chosen.append(own[without if without.any() else own["held_out"].isna()])
            pools = pd.concat(chosen)
            pools = pools[pools["w"] > 0].sort_values("x_min", kind="stable")
            if len(pools):
                out.append((*key, season, *_thresholds(_pooled(pools[_POOL].to_numpy(float).T), min_rows)))
        return pd.DataFrame(out, columns=[*group, "held_out", "xs", "ys"])

    kind = types["season"]
    ranged = averaged.repartitionByRange(*group, "x").sortWithinPartitions(*group, "x")
    pooled = ranged.mapInPandas(local, f"{head}, task int, held_out {kind}, x_min double, x_max double, w double, s double")
    fits = pooled.join(seasons, scope).groupBy(*group).applyInPandas(final, f"{head}, held_out {kind}, xs array<double>, ys array<double>")
    return _by_class(fits, [*keys, "held_out"])


def _upto(xs: str, p: Column) -> Column:
    return F.size(F.filter(F.col(xs), lambda t: t <= p))


def _interpolate(p: Column, xs: str, ys: str, below: Column) -> Column:
    """Piecewise linear through the thresholds, constant outside them; `below` counts those up to p."""
    x, y = F.col(xs), F.col(ys)
    x0, y0 = F.get(x, below - 1), F.get(y, below - 1)
    x1, y1 = F.get(x, below), F.get(y, below)
    return (
        F.when(below == 0, y[0])
        .when(below == F.size(x), y0)
        .otherwise(y0 + (y1 - y0) * F.try_divide(p - x0, x1 - x0))
    )


def apply_isotonic(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Calibrated probabilities in place: floored, then scaled to sum to one."""
    # A column of its own: inside the expression below it would be counted anew at every mention.
    counted = {f"__b{o}": _upto(f"xs_{o}", F.col(p)) for o, p in zip(OUTCOMES, PROBS, strict=True)}
    joined = rows.join(fits, keys).withColumns(counted)
    raw = {
        f"__c{o}": F.greatest(_interpolate(F.col(p), f"xs_{o}", f"ys_{o}", F.col(f"__b{o}")), F.lit(FLOOR))
        for o, p in zip(OUTCOMES, PROBS, strict=True)
    }
    out = joined.withColumns(raw)
    total = F.col("__cH") + F.col("__cD") + F.col("__cA")
    out = out.withColumns({p: F.col(f"__c{o}") / total for o, p in zip(OUTCOMES, PROBS, strict=True)})
    return out.drop(*raw, *counted, *[f"{v}_{o}" for v in ("xs", "ys") for o in OUTCOMES])
