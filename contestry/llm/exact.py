"""Exact dedup (13): a cuckoo-filter index of live digests that documents enter and leave.

A document's digest is the SHA-256 of its text after lower-casing A-Z. Digests are dealt to shards. A shard
is a cuckoo filter: buckets of four 16-bit fingerprints, each fingerprint in one of the two buckets that
the digest allows, beside the place of the stored key. A lookup that meets no fingerprint is a miss for
certain; a hit is verified against the full keys stored for that bucket. Inserting moves fingerprints to
their other bucket to make room; when that goes on too long the shard has overflowed and is rebuilt, twice
as large, from its stored keys. Deleting the last document of a digest takes its fingerprint out.

Tasks add up equal digests before the shuffle, so a text that makes up a third of all rows reaches its
shard as a few rows. Shards are sized by count, and dealt anew once they hold too many keys.
"""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import discard, table, written

SLOTS = 4
MOVES = 500
FULLEST = 0.9
# Keys that a shard is sized for; it is dealt anew at twice as many.
SHARD_KEYS = 50_000


class Cuckoo:
    """Digests with their live count and the id that stays; `buckets` is a power of two."""

    def __init__(self, buckets: int = 16):
        self.keys: list[bytes | None] = []
        self.counts: list[int] = []
        self.keeps: list[int | None] = []
        self.free: list[int] = []
        self._clear(buckets)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        need = max(1, int(keys / (SLOTS * FULLEST)) + 1)
        return cls(1 << (need - 1).bit_length())

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.fingers = array("H", bytes(2 * SLOTS * buckets))
        self.at = array("i", bytes(4 * SLOTS * buckets))

    def _home(self, key: bytes) -> tuple[int, int]:
        """Fingerprint (never 0, which marks a free slot) and first bucket."""
        return int.from_bytes(key[8:10], "little") or 1, int.from_bytes(key[:8], "little") & (self.buckets - 1)

    def _other(self, finger: int, bucket: int) -> int:
        return bucket ^ (finger * 0x5BD1E995 & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        """Slot of a stored key, or -1: fingerprints choose, the stored keys decide."""
        finger, bucket = self._home(key)
        other = self._other(finger, bucket)
        for b in (bucket,) if bucket == other else (bucket, other):
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if self.fingers[s] == finger and self.keys[self.at[s]] == key:
                    return s
        return -1

    def place(self, key: bytes) -> int:
        """Place of a key among the stored ones, or -1."""
        s = self._slot(key)
        return -1 if s < 0 else self.at[s]

    def _seat(self, key: bytes, place: int) -> bool:
        finger, bucket = self._home(key)
        for b in (bucket, self._other(finger, bucket)):
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if not self.fingers[s]:
                    self.fingers[s], self.at[s] = finger, place
                    return True
        for move in range(MOVES):
            s = SLOTS * bucket + move % SLOTS
            finger, self.fingers[s] = self.fingers[s], finger
            place, self.at[s] = self.at[s], place
            bucket = self._other(finger, bucket)
            for s in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.fingers[s]:
                    self.fingers[s], self.at[s] = finger, place
                    return True
        return False

    def _rebuild(self) -> None:
        """Twice the buckets, filled from the stored keys."""
        buckets = 2 * self.buckets
        while True:
            self._clear(buckets)
            if all(self._seat(key, p) for p, key in enumerate(self.keys) if key is not None):
                return
            buckets *= 2

    def insert(self, key: bytes, count: int, keep: int | None) -> None:
        """Adds `count` documents of one digest, `keep` the largest id among them."""
        p = self.place(key)
        if p >= 0:
            self.counts[p] += count
            if self.keeps[p] is None or (keep is not None and keep > self.keeps[p]):
                self.keeps[p] = keep
            return
        if self.free:
            p = self.free.pop()
            self.keys[p], self.counts[p], self.keeps[p] = key, count, keep
        else:
            p = len(self.keys)
            self.keys.append(key)
            self.counts.append(count)
            self.keeps.append(keep)
        if not self._seat(key, p):
            self._rebuild()

    def delete(self, key: bytes, count: int, keep: int | None) -> None:
        """Takes `count` documents of a digest out; `keep` is the largest id of those left."""
        s = self._slot(key)
        if s < 0 or self.counts[self.at[s]] < count:
            raise ValueError(f"{count} documents of digest {key.hex()} are not in the index")
        p = self.at[s]
        self.counts[p] -= count
        self.keeps[p] = keep
        if not self.counts[p]:
            self.fingers[s] = 0
            self.keys[p] = None
            self.free.append(p)

    def row(self, shard: int) -> dict:
        live = [p for p, key in enumerate(self.keys) if key is not None]
        renamed = dict(zip(live, range(len(live)), strict=True))
        at = array("i", [renamed.get(p, 0) if f else 0 for f, p in zip(self.fingers, self.at, strict=True)])
        return {
            "shard": shard, "buckets": self.buckets, "fingers": self.fingers.tobytes(), "places": at.tobytes(),
            "keys": [self.keys[p] for p in live], "counts": [self.counts[p] for p in live],
            "keeps": [self.keeps[p] for p in live],
        }

    @classmethod
    def read(cls, row: dict) -> Cuckoo:
        own = cls(row["buckets"])
        own.fingers, own.at = array("H"), array("i")
        own.fingers.frombytes(row["fingers"])
        own.at.frombytes(row["places"])
        own.keys, own.counts, own.keeps = list(row["keys"]), list(row["counts"]), list(row["keeps"])
        return own


SHARD = "shard int, buckets int, fingers binary, places binary, keys array<binary>, counts array<bigint>, keeps array<bigint>"
SHARD_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("buckets", pa.int32()), ("fingers", pa.binary()), ("places", pa.binary()),
        ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("keeps", pa.list_(pa.int64())),
    ]
)


def normalised(text: Column) -> Column:
    """A text as it is compared: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def members_of(documents: DataFrame) -> DataFrame:
    """doc_id, digest and n, the rows that have both."""
    digest = F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))


def _added_up(members: DataFrame, shards: int) -> DataFrame:
    """shard, digest, n and keep, equal digests of a batch as one row."""
    schema = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("keep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = pa.Table.from_batches([b]).group_by(["shard", "digest"]).aggregate([("n", "sum"), ("keep", "max")])
            sums = sums.select(["shard", "digest", "n_sum", "keep_max"]).rename_columns(schema.names)
            yield from sums.cast(schema).to_batches()

    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    return members.select(shard, "digest", "n", F.col("doc_id").alias("keep")).mapInArrow(
        run, "shard int, digest binary, n long, keep long"
    )


def _changed(shards: DataFrame, changes: DataFrame, remove: bool) -> DataFrame:
    """The shards after changes (shard, digest, n, keep)."""

    def merge(old: pa.Table, new: pa.Table) -> pa.Table:
        new_rows = new.num_rows
        filter_ = Cuckoo.read(old.to_pylist()[0]) if old.num_rows else Cuckoo.sized(new_rows)
        change = filter_.delete if remove else filter_.insert
        for b in new.to_batches(max_chunksize=8192):
            for digest, n, keep in zip(*[b.column(c).to_pylist() for c in ("digest", "n", "keep")], strict=True):
                change(digest, n, keep)
        shard = (old if old.num_rows else new)["shard"][0].as_py()
        return pa.Table.from_pylist([filter_.row(shard)], SHARD_ARROW)

    return shards.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(merge, SHARD)


@dataclass(frozen=True)
class Index:
    """Tables of an index: its shards, and the documents that are in it."""

    shards: DataFrame
    members: DataFrame
    count: int  # of shards

    def groups(self) -> DataFrame:
        """digest, keep_id and group_size of every live digest."""
        rows = F.arrays_zip("keys", "counts", "keeps")
        return self.shards.select(F.inline(rows)).toDF("digest", "group_size", "keep_id")

    def verdicts(self) -> DataFrame:
        """doc_id, digest, keep_id, group_size and kept, a row for each live document.

        Only digests of several documents are joined back; the others say it themselves."""
        several = self.groups().filter("group_size > 1")
        own = F.coalesce("group_size", F.lit(1).cast("long"))
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
        found = self.members.join(several, "digest", "left").withColumn("copy", copy)
        alone = F.col("group_size").isNull()
        return found.select(
            "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            own.alias("group_size"),
            ((F.col("copy") == 1) & (alone | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        )


def _shards_for(keys: int, shard_keys: int) -> int:
    return 1 << max(0, -(-keys // shard_keys) - 1).bit_length()


def _filled(spark: SparkSession, members: DataFrame, shard_keys: int) -> Index:
    count = _shards_for(members.count(), shard_keys)
    shards, _ = written(_changed(spark.createDataFrame([], SHARD), _added_up(members, count), remove=False))
    return Index(shards, members, count)


def build(documents: DataFrame, shard_keys: int = SHARD_KEYS) -> Index:
    """An index of doc_id and text; other columns are ignored. An empty table gives an empty index.

    Null texts are empty texts. A null doc_id is smaller than any other. Repeated rows are as many
    documents; of those with the largest id one stays. Texts are read whole, in the JVM."""
    members, _ = written(members_of(documents))
    return _filled(documents.sparkSession, members, shard_keys)


def insert(index: Index, documents: DataFrame, shard_keys: int = SHARD_KEYS) -> Index:
    """The index with more documents; shards that would hold too many keys are dealt anew from the members."""
    new, path = written(members_of(documents))
    both = index.members.unionByName(new).groupBy("doc_id", "digest").agg(F.sum("n").alias("n"))
    members, _ = written(both)
    spark = documents.sparkSession
    if members.count() > 2 * shard_keys * index.count:
        fuller = _filled(spark, members, shard_keys)
    else:
        shards, _ = written(_changed(index.shards, _added_up(new, index.count), remove=False))
        fuller = Index(shards, members, index.count)
    discard(spark, path)
    return fuller


def delete(index: Index, documents: DataFrame) -> Index:
    """The index without these documents (doc_id and text); one that is not in it raises an error.

    Where the document that stayed leaves, the largest id of those left takes its place."""
    gone, path = written(members_of(documents).withColumnRenamed("n", "out"))
    same = [index.members[c].eqNullSafe(gone[c]) for c in ("doc_id", "digest")]
    left = index.members.join(gone, same, "left").select(
        index.members["doc_id"], index.members["digest"], (F.col("n") - F.coalesce("out", F.lit(0))).alias("n")
    )
    members, _ = written(left.filter("n > 0"))
    out = gone.groupBy("digest").agg(F.sum("out").alias("n"))
    keeps = members.join(out.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep"))
    shard = F.pmod(F.xxhash64("digest"), F.lit(index.count)).cast("int").alias("shard")
    changes = out.join(keeps, "digest", "left").select(shard, "digest", "n", "keep")
    shards, _ = written(_changed(index.shards, changes, remove=True))
    discard(documents.sparkSession, path)
    return Index(shards, members, index.count)


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = build(table(spark, folder, "documents")).verdicts()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body FROM documents)
"""
