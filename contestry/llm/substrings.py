"""Substring dedup (4): repeated word spans through a compacted de Bruijn graph.

An edge is a window of `width` consecutive words. In a document, neighbouring edges that share their
minimizer (the least hash of the `core`-word runs inside) compact into one path; equal edges have equal
minimizers, so they always meet under the same one. A Spark join finds the minimizers that occur more
than once. Where all their paths spell the same words, the path does not branch and stays compact: every
occurrence but the one with the least source coordinates repeats it whole. Where they differ, one
occurrence of each spelling is expanded into its edges, and these are compared one by one. Edges and
paths are told by two 64-bit hashes of different kinds together (minimizer and words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import batch, discard, rows_of, table, texts, words, written

WIDTH = 20
CORE = 6
# Sorts documents without an id behind all others.
NO_ID = (1 << 63) - 1
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


class Spelled:
    """A text's words, joined by single blanks, and where each begins and ends."""

    def __init__(self, text: str | None):
        self.words = words(text)
        self.joined = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def hashed(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words first..last (inclusive) of each pair."""
        h, joined = xxhash.xxh3_64_intdigest, self.joined
        spans = zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)
        return np.array([h(joined[a:b]) for a, b in spans], np.uint64).view(np.int64)


def paths_of(s: Spelled, width: int = WIDTH, core: int = CORE) -> tuple[np.ndarray, ...] | None:
    """(start, edges, minimizer, words' hash) of a text's paths; None below `width` words."""
    n = len(s.words)
    if n < width:
        return None
    h = xxhash.xxh64_intdigest
    one = np.array([h(w) for w in s.words], np.uint64)
    value = np.zeros(n - core + 1, np.uint64)
    for k in range(core):
        value += one[k : n - core + 1 + k] * _FACTORS[k]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    at = np.arange(n - width + 1) + sliding_window_view(value, width - core + 1).argmin(1)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    edges = np.diff(np.r_[start, len(at)])
    return start, edges, value[at[start]].view(np.int64), s.hashed(start, start + edges + width - 2)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and what tells rows apart: the id for sorting and a hash of the text."""
    return texts(documents).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.hash("text").alias("tid")
    )


PATHS = pa.schema(
    [("doc", pa.int64()), ("tid", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("mini", pa.int64()), ("label", pa.int64())]
)


def paths(rows: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, tids, bodies in rows_of(batches, "doc", "tid", "text"):
            for at in range(0, len(docs), 500):
                got = []
                for d, t, body in zip(docs[at : at + 500], tids[at : at + 500], bodies[at : at + 500], strict=True):
                    if (found := paths_of(Spelled(body), width, core)) is not None:
                        k = len(found[0])
                        got.append((np.full(k, d), np.full(k, t), *found))
                if got:
                    columns = [np.concatenate(c) for c in zip(*got, strict=True)]
                    yield batch(dict(zip(PATHS.names, columns, strict=True)), PATHS)

    return rows.select("doc", "tid", "text").mapInArrow(run, "doc long, tid int, pos int, n int, mini long, label long")


def finished(s: Spelled, spans: list[tuple[int, int]], width: int) -> tuple[int, int, str]:
    """n_words, n_removed and kept_sha256 once the edges pos..pos+n-1 of each span are repeats."""
    gone = np.zeros(len(s.words) + 1, np.int64)
    for pos, n in spans:
        gone[pos] += 1
        gone[pos + n + width - 1] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    if keep.all():
        return len(s.words), 0, hashlib.sha256(s.joined).hexdigest()
    kept = b" ".join([w for w, k in zip(s.words, keep.tolist(), strict=True) if k])
    return len(s.words), int((~keep).sum()), hashlib.sha256(kept).hexdigest()


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeats(rows: DataFrame, width: int = WIDTH, core: int = CORE) -> tuple[DataFrame, list[str]]:
    """Per document with repeats: doc, tid and spans (pos, n edges, whole, mini); and the tables it reads.

    whole: an earlier occurrence spells the same path. Otherwise it is the first of its spelling under
    a branching minimizer, and its edges (under `mini`) are still to be compared one by one."""
    every, path = written(paths(rows, width, core))
    # Written, as `first` is, so that both sides of a join are plain shuffles and a hot key can be split.
    repeated, repeated_path = written(
        every.groupBy("mini").agg(F.count("*").alias("c"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        .filter("c > 1").select("mini", (F.col("l0") != F.col("l1")).alias("branching"))
    )
    hits, hits_path = written(every.join(repeated, "mini"))
    discard(rows.sparkSession, path, repeated_path)
    first, first_path = written(hits.groupBy("mini", "label").agg(F.min(F.struct("doc", "tid", "pos")).alias("first")))
    judged = hits.join(first, ["mini", "label"]).withColumn("whole", F.col("first") < F.struct("doc", "tid", "pos"))
    # Sets, so that repeated rows of one document add nothing.
    spans = (
        judged.filter("whole or branching")
        .groupBy("doc", "tid").agg(F.collect_set(F.struct("pos", "n", "whole", "mini")).alias("spans"))
    )
    return spans, [hits_path, first_path]


def remove_repeats(documents: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of documents.

    Null or empty texts have no words. Rows with the same doc_id and text count as one document and
    both keep what it keeps; with the same doc_id and other text they are ordered by a hash of it.
    Rows without an id come last in the order. An empty table gives no rows.
    """
    rows = keyed(documents)
    found, read = repeats(rows, width, core)
    spans = found.select(F.col("doc").alias("d"), F.col("tid").alias("t"), "spans")
    joined = rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("tid") == F.col("t")), "left").drop("d", "t")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in SETTLED.names}
            for r in b.select(["doc_id", "doc", "tid", "text", "spans"]).to_pylist():
                found = r["spans"] or []
                if all(x["whole"] for x in found):
                    done = finished(Spelled(r["text"]), [(x["pos"], x["n"]) for x in found], width)
                    values = [r["doc_id"], *done, None, None, None, None]
                else:
                    values = [r["doc_id"], None, None, None, r["doc"], r["tid"], r["text"], found]
                for n, v in zip(SETTLED.names, values, strict=True):
                    out[n].append(v)
            yield batch(out, SETTLED)

    kinds = RESULT + ", doc long, tid int, text string, spans array<struct<pos:int,n:int,whole:boolean,mini:long>>"
    settled, _ = written(joined.mapInArrow(settle, kinds))
    discard(rows.sparkSession, *read)
    done = settled.filter("doc is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    open_ = settled.filter("doc is not null").select("doc_id", "doc", "tid", "text", "spans")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Spelled(r["text"])
                branching = [x for x in r["spans"] if not x["whole"]]
                at = np.concatenate([np.arange(x["pos"], x["pos"] + x["n"]) for x in branching])
                minis = np.repeat([x["mini"] for x in branching], [x["n"] for x in branching])
                yield batch(
                    {"doc": np.full(len(at), r["doc"]), "tid": np.full(len(at), r["tid"]), "pos": at, "mini": minis, "edge": s.hashed(at, at + width - 1)},
                    EDGES,
                )

    # Repeated rows give equal edges with equal coordinates, which are never later than themselves.
    one, _ = written(open_.mapInArrow(edges, "doc long, tid int, pos int, mini long, edge long"))
    first = one.groupBy("mini", "edge").agg(F.min(F.struct("doc", "tid", "pos")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    later = (
        one.join(first, ["mini", "edge"]).filter(F.col("first") < F.struct("doc", "tid", "pos"))
        .groupBy(F.col("doc").alias("d"), F.col("tid").alias("t")).agg(F.collect_set("pos").alias("later"))
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for r in b.select(["doc_id", "text", "spans", "later"]).to_pylist():
                spans = [(x["pos"], x["n"]) for x in r["spans"] if x["whole"]] + [(p, 1) for p in r["later"] or []]
                got.append((r["doc_id"], *finished(Spelled(r["text"]), spans, width)))
            yield batch({n: [g[k] for g in got] for k, n in enumerate(FINAL.names)}, FINAL)

    rest = open_.join(later, (F.col("doc") == F.col("d")) & (F.col("tid") == F.col("t")), "left").drop("d", "t").mapInArrow(close, RESULT)
    return done.unionByName(rest)


FINAL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
SPAN = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_()), ("mini", pa.int64())]))
SETTLED = pa.schema([*FINAL, ("doc", pa.int64()), ("tid", pa.int32()), ("text", pa.string()), ("spans", SPAN)])
EDGES = pa.schema([("doc", pa.int64()), ("tid", pa.int32()), ("pos", pa.int32()), ("mini", pa.int64()), ("edge", pa.int64())])


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))
