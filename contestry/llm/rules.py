"""Quality rules (3): a decision list over text statistics, learned by sequential covering.

A rule is a conjunction of thresholds that predicts low quality. It is grown on two thirds of the
labelled rows still uncovered, condition by condition with the largest information gain, and pruned
on the last third; rules are added while the pruned rule is more often right than wrong. The list
becomes one ordered conditional expression, so applying it is a plain Spark projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import batch, rows_of, table, texts, words, written

# Labelled rows that the list is learned from, about; chosen by hash.
SAMPLE = 20_000
# Distinct thresholds tried per statistic, conditions per rule, rules per list.
CUTS = 64
MOST_CONDITIONS = 4
MOST_RULES = 16
# A rule must be right on this share of the pruning rows it covers, and cover so many.
LEAST_PRECISION = 0.9
LEAST_COVER = 5
WINDOW = 3
SYMBOLS = "#*$%&|<>"
# Few words, or more than half of them in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_distinct", "n_marked")
# What rules may ask about: shares, so that a rule does not depend on the length of the text.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "marked_share": ("n_marked", "n_words"),
}
_MARKS = str.maketrans("", "", SYMBOLS)
_BLANKS = str.maketrans("", "", " \t\n\v\f\r")


def repeated_words(found: list[bytes], width: int = WINDOW) -> tuple[int, int]:
    """Words inside windows that occur twice or more, and distinct words."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found))
    n = len(ids) - width + 1
    if n < 2:
        return 0, len(index)
    key = ids[:n]
    for k in range(1, width):
        # Ranks keep the key exact: both factors stay below the number of words.
        key = np.unique(key * (len(index) + 1) + ids[k : n + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum()), len(index)


def measured(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    text = text or ""
    found = words(text)
    repeat, distinct = repeated_words(found)
    solid = text.translate(_BLANKS)
    lines = [x for x in text.split("\n") if words(x)]
    raw = text.encode("utf-8", "surrogatepass")
    ascii_upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marked = sum(w[-1] in b"#*$%&|<>!" for w in found)
    return (
        len(found), len(solid), len(solid) - len(solid.translate(_MARKS)), len(lines) - len(set(lines)), repeat,
        len(lines), ascii_upper, digits, distinct, marked,
    )


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text; null or empty text: zeros. Repeated rows repeat."""
    names = [*COUNTS, *MORE]
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in rows_of(batches, "doc_id", "text"):
            got = np.array([measured(t) for t in bodies], np.int64).reshape(len(bodies), len(names))
            yield batch({"doc_id": ids, **{n: got[:, k] for k, n in enumerate(names)}}, schema)

    return texts(documents).mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def ratio(name: str) -> Column:
    above, below = RATIOS[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return ratio(self.name) > self.cut if self.above else ratio(self.name) <= self.cut

    def holds(self, x: np.ndarray, at: int) -> np.ndarray:
        return x[:, at] > self.cut if self.above else x[:, at] <= self.cut


Rule = tuple[Condition, ...]
NAMES = tuple(RATIOS)


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, NAMES.index(c.name))
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition with the largest gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base = math.log2(p0 / (p0 + n0)) if p0 else 0.0
        best, gain = None, 1e-9
        for at, name in enumerate(NAMES):
            v = x[inside, at]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS)))
            mids = (cuts[1:] + cuts[:-1]) / 2
            order = np.argsort(v, kind="stable")
            upto = np.r_[0, np.cumsum(bad[inside][order])]
            k = np.searchsorted(v[order], mids, "right")
            for above, p, n in ((False, upto[k], k - upto[k]), (True, p0 - upto[k], (len(v) - k) - (p0 - upto[k]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
                if len(g) and g.max() > gain:
                    best, gain = Condition(name, above, float(mids[g.argmax()])), float(g.max())
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x, NAMES.index(best.name))
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best (right - wrong) / covered on the pruning rows."""

    def worth(r: Rule) -> float:
        got = covered(r, x)
        return (2 * (got & bad).sum() - got.sum()) / max(1, got.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Ordered rules for low quality; none if there are no low-quality rows."""
    found: list[Rule] = []
    left = np.ones(len(x), bool)
    third = np.random.default_rng(seed).permutation(len(x)) % 3 == 0
    while len(found) < MOST_RULES and (bad & left & ~third).any():
        rule = grow(x[left & ~third], bad[left & ~third])
        if not rule:
            break
        rule = prune(rule, x[left & third], bad[left & third])
        got = covered(rule, x) & left & third
        if got.sum() < LEAST_COVER or (got & bad).sum() < LEAST_PRECISION * got.sum():
            break
        found.append(rule)
        left &= ~covered(rule, x)
    return found


def sample(stats: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and low-quality flags of about `most` labelled rows (twice that at most), chosen by hash."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = 1 << 40
    take = share * most // max(most, known.count())
    rows = (
        stats.join(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < take), "doc_id")
        .select("doc_id", *[ratio(n).alias(n) for n in NAMES], "quality").limit(2 * most).collect()
    )
    rows.sort()
    x = np.array([[r[n] for n in NAMES] for r in rows], float).reshape(len(rows), len(NAMES))
    return x, np.array([r["quality"] == 0 for r in rows], bool)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        holds = F.lit(True)
        for c in rules[k - 1]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Counts, base_failed, rule (number of the learned rule that holds) and kept per row.

    Empty labels, or labels without low quality, leave only the base conditions. The statistics are
    written once and read by both the learner and the list.
    """
    stats, _ = written(statistics(documents))
    rules = learn(*sample(stats, labels, most))
    return stats.select(
        "doc_id", *COUNTS, *MORE, base_failed().alias("base_failed"), verdict(rules).alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "rule")
