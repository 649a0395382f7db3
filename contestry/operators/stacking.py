"""Blends of probability components and the search for their weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import PROBS, prob_of

_LOG_FLOOR = 1e-15


def true_class_probs(pool: DataFrame, keys: list[str], components: tuple[str, ...]) -> DataFrame:
    """One row per contest with each component's probability of what happened."""
    known = pool.filter(F.col("result").isNotNull())
    return known.groupBy(*keys, "match_id").agg(
        *[F.max(F.when(F.col("component") == c, prob_of())).alias(f"q{i}") for i, c in enumerate(components)]
    )


def _candidates(ticks: int, size: int) -> list[tuple[int, int]]:
    """Grid points (i, j) in search order; the last weight is what is left to one."""
    if size == 2:
        return [(i, 0) for i in range(ticks + 1)]
    return [(i, j) for i in range(ticks + 1) for j in range(ticks + 1 - i)]


def _grid_losses(rows: DataFrame, keys: list[str], ticks: int, size: int) -> DataFrame:
    """Mean loss per weight candidate.

    A batch of contests meets all candidates in one matrix product, and only the sums per
    candidate leave the task.
    """
    step = 1.0 / ticks
    grid = _candidates(ticks, size)
    i, j = np.array(grid).T
    w = np.stack([i * step, 1.0 - i * step] if size == 2 else [i * step, j * step, (ticks - i - j) * step])
    names = [f"q{k}" for k in range(size)]
    types = dict(rows.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(keys, sort=False) if keys else [((), b)]:
                loss = -np.log(np.maximum(part[names].to_numpy(float) @ w, _LOG_FLOOR))
                acc = sums.setdefault(key, np.zeros(len(grid) + 1))
                acc[:-1] += loss.sum(axis=0)
                acc[-1] += len(part)
        for key, acc in sums.items():
            fixed = {k: v for k, v in zip(keys, key, strict=True)}
            yield pd.DataFrame({**fixed, "i": i, "j": j, "s": acc[:-1], "n": acc[-1]})

    parts = rows.select(*keys, *names).mapInPandas(add, f"{head}i int, j int, s double, n double")
    return parts.groupBy(*keys, "i", "j").agg((F.sum("s") / F.sum("n")).alias("loss"))


def optimal_weights(pool: DataFrame, keys: list[str], components: tuple[str, str, str], step: float = 0.05) -> DataFrame:
    """Weights on the simplex grid with the lowest log-loss; the first candidate wins a tie."""
    ticks = round(1.0 / step)
    losses = _grid_losses(true_class_probs(pool, keys, components), keys, ticks, 3)
    best = F.min_by(F.struct("i", "j", "loss"), F.struct("loss", "i", "j")).alias("b")
    picked = losses.groupBy(*keys).agg(best) if keys else losses.agg(best)
    weights = picked.select(
        *keys,
        "b.loss",
        F.inline(
            F.array(
                F.struct(F.lit(components[0]).alias("component"), (F.col("b.i") * step).alias("weight")),
                F.struct(F.lit(components[1]).alias("component"), (F.col("b.j") * step).alias("weight")),
                F.struct(
                    F.lit(components[2]).alias("component"),
                    ((ticks - F.col("b.i") - F.col("b.j")) * step).alias("weight"),
                ),
            )
        ),
    )
    return weights


def optimal_weight(pool: DataFrame, keys: list[str], components: tuple[str, str], step: float = 0.05) -> DataFrame:
    """Weight of the first of two components."""
    losses = _grid_losses(true_class_probs(pool, keys, components), keys, round(1.0 / step), 2)
    best = F.min_by(F.struct("i", "loss"), F.struct("loss", "i")).alias("b")
    picked = losses.groupBy(*keys).agg(best) if keys else losses.agg(best)
    return picked.select(*keys, (F.col("b.i") * step).alias("weight"), "b.loss")


def blend_pair(frame: DataFrame, first: tuple, second: tuple, weight: float) -> DataFrame:
    return frame.withColumns(
        {n: weight * F.col(a) + (1.0 - weight) * F.col(b) for n, a, b in zip(PROBS, first, second, strict=True)}
    )


def blend(pool: DataFrame, weights: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Weighted sum over components, one row per contest; `carry` columns ride along.

    A contest that lacks a weighted component gets null probabilities, not a smaller sum.
    """
    needed = weights.groupBy(*keys).agg(F.countDistinct("component").alias("__needed"))
    sized = weights.select(*keys, "component", "weight").join(needed, keys)
    weighted = pool.join(sized, [*keys, "component"])
    whole = F.countDistinct("component") == F.max("__needed")
    return weighted.groupBy(*keys, "match_id").agg(
        *[F.first(c).alias(c) for c in carry],
        *[F.when(whole, F.sum(F.col("weight") * F.col(p))).alias(p) for p in PROBS],
    )
