"""Hard negatives against brute force; packed products against plain ones."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score string, copies string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def brute(rows, anchor):
    use = [
        (i, lab, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in use if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, own) for j, own, w in use if j != i)
        positives = [(j, -s) for s, j, own in scored if own == lab][:5]
        for p, ps in positives:
            hard = [(j, -s) for s, j, own in scored if own != lab and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(i, p, k + 1, j, ps, ns) for k, (j, ns) in enumerate(hard)]
    return sorted(out)


def result(df):
    return sorted(
        (r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
        for r in df.collect()
    )


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(300):
        v = r.normal(0, 0.2, 6).round(1).tolist()  # coarse values, so scores tie
        rows.append((k, int(r.integers(0, 4)), v))
    rows += [rows[20], rows[20], rows[31], rows[100]]  # repeated rows, one of them an anchor
    rows += [(1000, None, [0.1] * 6), (1001, 1, None), (1002, 1, [None] * 6), (1003, 1, [math.nan] * 6)]
    rows += [(1004, 1, [math.inf] * 6), (None, 1, [0.3] * 6), (1100, 2, [0.5, 0.5]), (1200, 9, [0.5] * 6), (1300, 1, [])]
    got = result(negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert got == brute(rows, lambda i: i % 100 == 0) and got


def test_empty_table_and_no_anchor(spark):
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine(frame(spark, [(1, 1, [0.5])]), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("size", [1, 40, 3000, 4_000_000])
def test_packed_scores_are_exact(size):
    r = np.random.default_rng(size)
    rows, anchors = r.integers(-size, size + 1, (37, 9)), r.integers(-size, size + 1, (5, 9))
    packed = negatives.Packed(rows, int(np.abs(anchors).sum(1).max()))
    assert (packed.scores(anchors) == anchors @ rows.T).all()
    assert packed.fields > 1 or size > 3000


def test_scores_too_wide_raise():
    with pytest.raises(OverflowError):
        negatives.Packed(np.full((2, 4), 1 << 30), 1 << 40)
