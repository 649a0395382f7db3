"""SimHash near-duplicates (5): fingerprints linked at few differing bits, through a Gray-order index.

Equal fingerprints are one row before anything is compared. Two fingerprints within `reach` bits agree
on at least one of `reach + 1` bit ranges; each range and its value make a bucket. Buckets are dealt to
tasks by their counted size, and one above the limit is cut into chunks that meet pairwise. A task sorts
its fingerprints by bucket and Gray rank and builds an index over them: a node holds the bits that all
rows below share, less those its parent holds already. A search adds up the differences on the way down
and drops a node, with all below it, once they exceed the reach. Links inside a task come out as a
spanning forest, never as all pairs; the components of these forests are then joined over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import batch, discard, rows_of, table, texts, words, written

SHINGLE = 4
SEED = 42
REACH = 4
# Fingerprints that one bucket chunk holds; a task gets at most about twice as many, or buckets adding up to it.
CHUNK = 20_000
# Children of an index node, and (row, node) pairs searched at a time.
FAN = 8
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text; a bit is set when it is set in over half the shingle hashes."""
    found = words(text)
    if not found:
        return 0
    found = [w.lower() for w in found]
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(found))
    h = xxhash.xxh64_intdigest
    hashes = np.array(
        [h(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    # Summed in blocks, so very long texts take bounded memory.
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long). Null or empty text: zero. Null ids stay null."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in rows_of(batches, "doc_id", "text"):
            fps = np.array([fingerprint(t, shingle) for t in bodies], np.uint64).view(np.int64)
            yield batch({"doc_id": ids, "fp": fps}, schema)

    return texts(documents).mapInArrow(run, "doc_id long, fp long")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each word in Gray-code order."""
    rank = bits.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class Forest:
    """Components of row numbers, merged by batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class GrayIndex:
    """Index over rows sorted by (bucket, Gray rank). A node never spans two buckets."""

    def __init__(self, bucket: np.ndarray, bits: np.ndarray):
        self.bits = bits
        n = len(bits)
        # Level 0 are the rows; each level above groups up to FAN neighbours of the same bucket.
        self.levels: list[dict[str, np.ndarray]] = [
            {"first": np.arange(n), "last": np.arange(n) + 1, "mask": np.full(n, ~np.uint64(0)), "bits": bits, "bucket": bucket}
        ]
        while True:
            low = self.levels[-1]
            own = low["bucket"]
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[begins, len(own)])
            within = np.arange(len(own)) - np.repeat(begins, sizes)
            first = np.flatnonzero(within % FAN == 0)
            if len(first) == len(own):
                break
            last = np.r_[first[1:], len(own)]
            both = np.bitwise_and.reduceat(low["bits"], first)
            either = np.bitwise_or.reduceat(low["bits"] & low["mask"], first)
            mask = np.bitwise_and.reduceat(low["mask"], first) & ~(either & ~both)
            self.levels.append({"first": first, "last": last, "mask": mask, "bits": both & mask, "bucket": own[first]})
        for up, low in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            parent = np.repeat(np.arange(len(up["first"])), up["last"] - up["first"])
            low["rest"] = low["mask"] & ~up["mask"][parent]
        self.levels[-1]["rest"] = self.levels[-1]["mask"]

    def links(self, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of one bucket within `reach` bits, each once, in batches."""
        top = len(self.levels) - 1
        root = self.levels[top]
        # At the top a bucket is one node; its rows are the queries.
        size = np.zeros(len(root["first"]), np.int64)
        edge = np.r_[0, len(self.bits)]
        last = root["last"]
        for level in range(top - 1, -1, -1):
            last = self.levels[level]["last"][last - 1]
        edge = np.r_[0, last]
        size = np.diff(edge)
        query = np.arange(len(self.bits))
        node = np.repeat(np.arange(len(size)), size)
        many = np.repeat(size, size) > 1
        query, node = query[many], node[many]
        stack = [(top, query, node, np.zeros(len(query), np.int8))]
        while stack:
            level, query, node, sofar = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack.append((level, query[half:], node[half:], sofar[half:]))
                stack.append((level, query[:half], node[:half], sofar[:half]))
                continue
            here = self.levels[level]
            sofar = sofar + np.bitwise_count((self.bits[query] ^ here["bits"][node]) & here["rest"][node]).astype(np.int8)
            near = sofar <= reach
            query, node, sofar = query[near], node[near], sofar[near]
            if level == 0:
                once = query < node
                if once.any():
                    yield query[once], node[once]
                continue
            below = self.levels[level - 1]
            first, n = here["first"][node], (here["last"] - here["first"])[node]
            # Rows before the query have met it already, as queries of their own.
            child = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q = np.repeat(query, n)
            s = np.repeat(sofar, n)
            ahead = self._last_row(level - 1)[child] > q
            stack.append((level - 1, q[ahead], child[ahead], s[ahead]))
            del below

    def _last_row(self, level: int) -> np.ndarray:
        here = self.levels[level]
        if "end" not in here:
            last = here["last"]
            for k in range(level - 1, -1, -1):
                last = self.levels[k]["last"][last - 1]
            here["end"] = last - 1 if level else np.arange(len(self.bits))
        return here["end"]


def ranges(reach: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of reach + 1 ranges that cover 64 bits."""
    cuts = [64 * i // (reach + 1) for i in range(reach + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_of(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def forest_links(distinct: DataFrame, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """(a, b) of fingerprints: a spanning forest, per task, of all links within `reach` bits."""
    buckets = [F.lit(k).alias("range") for k, _ in enumerate(ranges(reach))]
    spread = F.array(*[F.struct(b, bucket_of(F.col("fp"), *r).alias("value")) for b, r in zip(buckets, ranges(reach), strict=True)])
    rows = distinct.select("fp", F.inline(spread))
    # (reach + 1) * 2^13 rows at most for a reach of four: a bounded table.
    sizes = rows.groupBy("range", "value").count().filter("count > 1").withColumn(
        "chunks", F.ceil(F.col("count") / chunk).cast("long")
    )
    units = F.greatest(F.lit(1), F.ceil(F.sum("count") / chunk)).cast("long")
    total = sizes.agg(units.alias("units")).first()["units"] or 1
    own = rows.join(sizes, ["range", "value"])
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), "chunks")
    # A cut bucket's chunk c meets every other chunk; a whole bucket shares a unit with others.
    paired = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != F.col("mine"))
    )
    meeting = (
        own.withColumn("mine", mine)
        .withColumn("other", F.explode(paired))
        .select(
            "fp",
            "range",
            "value",
            F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("range", "value"), F.lit(total))).otherwise(F.lit(-1)).alias("unit"),
            F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.col("range")).alias("u_range"),
            F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.col("value")).alias("u_value"),
            F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.least("mine", "other")).alias("low"),
            F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.greatest("mine", "other")).alias("high"),
        )
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        bits = group["fp"].to_numpy(np.int64).view(np.uint64)
        bucket = (group["range"].to_numpy(np.int64) << 32) | group["value"].to_numpy(np.int64)
        order = np.lexsort((gray_rank(bits), bucket))
        bits, bucket = bits[order], bucket[order]
        forest = Forest(len(bits))
        for a, b in GrayIndex(bucket, bits).links(reach):
            forest.link(a, b)
        member = np.flatnonzero(forest.root != np.arange(len(bits)))
        signed = bits.view(np.int64)
        return pd.DataFrame({"a": signed[forest.root[member]], "b": signed[member]})

    return meeting.groupBy("unit", "u_range", "u_value", "low", "high").applyInPandas(search, "a long, b long")


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root) of every linked node; root is the smallest node reachable.

    Each round hooks a root under the smallest root it has a link to and follows one more step of
    every chain; links are rewritten to roots, so they vanish as components close. Rounds are few
    (logarithmic in the longest chain) and each is a written table.
    """
    spark = links.sparkSession
    edges = links.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).filter("a <> b").distinct()
    edges, path = written(edges)
    nodes = edges.select(F.col("a").alias("node")).distinct().union(edges.select("b").distinct()).distinct()
    labels, label_path = written(nodes.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        hooks, hook_path = written(_flat(hook))
        gone = [hook_path]
        renamed = labels.join(hooks, labels["root"] == hooks["node"], "left").select(
            labels["node"], F.coalesce(hooks["up"], labels["root"]).alias("root")
        )
        new_labels, new_label_path = written(renamed)
        h1, h2 = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = (
            edges.join(h1, "a", "left").join(h2, "b", "left")
            .select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        new_edges, new_path = written(moved)
        discard(spark, path, label_path, *gone)
        edges, path, labels, label_path = new_edges, new_path, new_labels, new_label_path
    discard(spark, path)
    return labels


def _flat(hook: DataFrame) -> DataFrame:
    """Chains of hooks (node under a smaller node) shortened to their end by doubling."""
    now, path = written(hook)
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"))
        longer, new_path = written(
            now.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        )
        moved = not longer.filter("moved").isEmpty()
        discard(now.sparkSession, path)
        now, path = longer.select("node", "up"), new_path
        if not moved:
            return now


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """doc_id, fp and component_id of every row.

    component_id is the smallest doc_id reachable over links; rows without text share fingerprint
    zero. A null doc_id never becomes a component's name unless no row there has one. Repeated rows
    repeat. An empty table gives no rows.
    """
    rows, _ = written(fingerprints(documents, shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    labels = components(forest_links(distinct.select("fp"), reach))
    named = distinct.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
