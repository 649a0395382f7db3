"""Hard-negative mining (11): exact integer scores by Kronecker-packed products, best rows per anchor.

Several candidates share one 64-bit integer per component: each candidate's component is biased until it
is not negative and put into a field of its own. One product of that integer with an anchor's component
is then a product for every field at once, and the sum over components holds each candidate's score in
its field. Fields are as wide as the largest score of the task needs, so they never run into each other;
after the last component each is given an offset that makes it non-negative, and is cut out exactly.

Anchors are a stated query set that meets all rows, in blocks: anchors and rows are dealt to a grid by
hash, so a task holds a bounded number of both, whatever the table's size. A task sends on only the best
rows of each anchor, and windows over these pick the final ones. Positives come first, since they
set the score range in which a negative is hard; negatives are a second pass over the same grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.common import table, written

SCALE = 256
# Anchors and rows that one task may hold, and the fewest rows worth a task of their own.
ANCHORS = 1 << 18
ROWS = 1 << 19
LEAST_ROWS = 2048
# Anchors and rows scored together: the scores of one tile are held at a time.
TILE = (512, 4096)
# Widest field; 100 times a score must fit a signed 64-bit integer.
WIDEST = 56


class Packed:
    """Rows' components in separated fields of 64-bit integers, for anchors of at most `weight`.

    `weight` is the largest sum of an anchor's absolute components."""

    def __init__(self, rows: np.ndarray, weight: int):
        self.count = len(rows)
        self.bias = max(0, -int(rows.min(initial=0)))
        # No field's sum exceeds this in absolute value.
        self.offset = weight * (int(rows.max(initial=0)) + self.bias)
        self.width = max(1, (2 * self.offset).bit_length())
        if self.width > WIDEST:
            raise OverflowError(f"scores need {self.width} bits, more than {WIDEST}; scale the vectors down")
        self.fields = 64 // self.width
        words = -(-self.count // self.fields)
        padded = np.zeros((words * self.fields, rows.shape[1]), np.int64)
        padded[: self.count] = rows
        biased = (padded + self.bias).astype(np.uint64).reshape(words, self.fields, rows.shape[1])
        self.words = np.zeros((words, rows.shape[1]), np.uint64)
        self.lift = np.uint64(0)
        for f in range(self.fields):
            self.words |= biased[:, f] << np.uint64(f * self.width)
            self.lift += np.uint64(self.offset) << np.uint64(f * self.width)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, one line per anchor and one column per row."""
        # Sums wrap at 64 bits, which does no harm: lifted, the true sum lies in 0 .. 2^64 - 1.
        sums = np.einsum("ij,kj->ik", anchors.astype(np.int64).view(np.uint64), self.words) + self.lift
        mask = np.uint64((1 << self.width) - 1)
        out = np.empty((len(anchors), len(self.words), self.fields), np.int64)
        for f in range(self.fields):
            out[:, :, f] = (sums >> np.uint64(f * self.width)) & mask
        shift = self.offset + self.bias * anchors.astype(np.int64).sum(1)
        return out.reshape(len(anchors), -1)[:, : self.count] - shift[:, None]


def leaders(line: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first `most` entries of each line, by falling score, then rising tie."""
    order = np.lexsort((tie, -score, line))
    ordered = line[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else order
    within = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[within < most]


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the `most` highest allowed scores of each line, earlier columns first on ties."""
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    if masked.shape[1] > most:
        limit = np.partition(masked, masked.shape[1] - most, axis=1)[:, masked.shape[1] - most]
        allowed = allowed & (masked >= limit[:, None])
    line, column = np.nonzero(allowed)
    at = leaders(line, masked[line, column], column, most)
    return line[at], column[at]


def matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """A column of lists as lines of `wide` numbers; shorter lists end in zeros."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vec (whole components) and copies of each different row that takes part.

    Rows without vec_id, label or vector, or with a component that is null or not finite, take no part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(finite)
    return rows.select("vec_id", "label", whole.alias("vec")).groupBy("vec_id", "label", "vec").agg(F.count("*").alias("copies"))


class Grid:
    """Anchors and rows, dealt by hash to cells of bounded size."""

    def __init__(self, rows: DataFrame, is_anchor: Column):
        spark = rows.sparkSession
        size = rows.agg(
            F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("vec")).alias("wide")
        ).first()
        self.wide = size["wide"] or 0
        few = min(-(-size["rows"] // LEAST_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.slabs = max(1, few, -(-size["rows"] // ROWS))
        self.blocks = max(1, -(-size["anchors"] // ANCHORS))
        key = F.xxhash64("vec_id", "label", "vec")
        dealt = rows.withColumn("anchor", key)
        self.anchors = dealt.filter(is_anchor).withColumn("block", F.pmod(key, F.lit(self.blocks)).cast("int"))
        slab = F.pmod(F.xxhash64("anchor", F.lit(11)), F.lit(self.slabs)).cast("int")
        self.rows = rows.withColumn("anchor", key).select(
            slab.alias("slab"), "vec_id", "label", "vec", F.least("copies", F.lit(1 << 30)).cast("int").alias("copies")
        )

    def scan(self, anchors: DataFrame, pick, schema: str) -> DataFrame:
        """What `pick` sends on from each cell: (anchor columns, rows, scores of a tile) -> entries."""
        wide, out = self.wide, _arrow(schema)
        every = anchors.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(self.slabs - 1))))
        blocks = F.sequence(F.lit(0), F.lit(self.blocks - 1))
        rows = self.rows.select(F.explode(blocks).alias("block"), "*")

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            right = right.sort_by("vec_id")
            blocks = [left.slice(at, TILE[0]) for at in range(0, left.num_rows, TILE[0])]
            slices = [right.slice(at, TILE[1]) for at in range(0, right.num_rows, TILE[1])]
            heaviest = max(int(np.abs(matrix(b["vec"], wide)).sum(1).max()) for b in blocks)
            packs = [Packed(matrix(s["vec"], wide), heaviest) for s in slices]
            parts = []
            for block in blocks:
                vecs = matrix(block["vec"], wide)
                tiles = ((s, pack.scores(vecs)) for s, pack in zip(slices, packs, strict=True))
                parts.append(pick(block, tiles).cast(out))
            return pa.concat_tables(parts)

        rows = rows.toDF(*rows.columns)  # columns of its own, since both sides come from one table
        return every.groupBy("block", "slab").cogroup(rows.groupBy("block", "slab")).applyInArrow(cell, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _positives(most: int):
    """Picks each anchor's best rows of its own label."""

    def pick(mine: pa.Table, tiles) -> pa.Table:
        ids, labels = _numbers(mine, "vec_id"), _numbers(mine, "label")
        found = []
        for rows, scores in tiles:
            allowed = (_numbers(rows, "label") == labels[:, None]) & (_numbers(rows, "vec_id") != ids[:, None])
            line, column = best(scores, allowed, most)
            found.append((line, scores[line, column], _numbers(rows, "vec_id")[column], _numbers(rows, "copies")[column]))
        line, score, other, copies = (np.concatenate(x) for x in zip(*found, strict=True))
        at = leaders(line, score, other, most)
        return pa.table(
            {
                "anchor": _numbers(mine, "anchor")[line[at]], "anchor_id": ids[line[at]], "other_id": other[at],
                "score": score[at], "copies": copies[at],
            }
        )

    return pick


def _negatives(most: int, low: int, high: int):
    """Picks, for each positive of an anchor, the best rows of other labels inside its score range."""

    def pick(mine: pa.Table, tiles) -> pa.Table:
        ids, labels = _numbers(mine, "vec_id"), _numbers(mine, "label")
        goals = mine["goals"].to_pylist()
        places = max(map(len, goals), default=0)
        want = np.zeros((len(ids), places), np.int64)
        given = np.zeros((len(ids), places), bool)
        for k, g in enumerate(goals):
            want[k, : len(g)], given[k, : len(g)] = g, True
        found = [(np.empty(0, np.int64),) * 5]
        for rows, scores in tiles:
            other = (_numbers(rows, "label") != labels[:, None]) & (_numbers(rows, "vec_id") != ids[:, None])
            for place in range(places):
                goal = want[:, place, None]
                inside = (100 * scores >= low * goal) & (100 * scores <= high * goal) & given[:, place, None] & other
                line, column = best(scores, inside, most)
                found.append(
                    (line, np.full(len(line), place), scores[line, column], _numbers(rows, "vec_id")[column],
                     _numbers(rows, "copies")[column])
                )
        line, place, score, other, copies = (np.concatenate(x) for x in zip(*found, strict=True))
        at = leaders(line * max(places, 1) + place, score, other, most)
        return pa.table(
            {
                "anchor": _numbers(mine, "anchor")[line[at]], "anchor_id": ids[line[at]], "place": place[at],
                "other_id": other[at], "score": score[at], "copies": copies[at],
            }
        )

    return pick


def _ranked(entries: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first `most` entries of each key with their rank, a repeated row counting as often as it is there."""
    copies = F.sequence(F.lit(1), F.least("copies", F.lit(most)))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return (
        entries.withColumn("copy", F.explode(copies)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    )


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank, negative_id, negative_score for every anchor.

    vectors: vec_id, label, embedding; other columns are ignored. A component x counts as
    floor(scale * x) and a score is the whole inner product. Scores fall, ties go to the smaller vec_id.
    An anchor's positives are its best rows of the same label, its negatives under a positive the best
    rows of another label whose score is between `low` and `high` percent of the positive's.
    Rows without vec_id, label or vector, or with a null or infinite component, take no part. Rows of
    the anchor's vec_id are never its partners. A repeated row is as many partners as it is rows, and
    one anchor. Shorter vectors count as ending in zeros. No anchor or no partner: no rows. Scores of
    more than 55 bits raise OverflowError.
    """
    rows, _ = written(usable(vectors, scale))
    grid = Grid(rows, is_anchor)
    found = grid.scan(grid.anchors, _positives(positives), "anchor long, anchor_id long, other_id long, score long, copies int")
    goals, _ = written(_ranked(found, positives, "anchor", "anchor_id").drop("copy", "copies"))
    places = goals.groupBy("anchor", "anchor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda g: g["score"]).alias("goals")
    )
    wanted = grid.anchors.join(places.withColumnRenamed("anchor_id", "vec_id"), ["anchor", "vec_id"])
    hard = grid.scan(
        wanted, _negatives(negatives, low, high),
        "anchor long, anchor_id long, place int, other_id long, score long, copies int",
    )
    ranked = _ranked(hard, negatives, "anchor", "anchor_id", "place").select(
        "anchor", "anchor_id", (F.col("place") + 1).alias("place"), "rank", F.col("other_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    goals = goals.select(
        "anchor", "anchor_id", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return ranked.join(goals, ["anchor", "anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_sum([a.vec[i] * c.vec[i] FOR i IN range(1, len(a.vec) + 1)]) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 5
"""
