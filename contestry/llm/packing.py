"""Best-fit packing (10): token pieces of documents into sequences of bounded length.

Bounded-space online best-fit. A fixed number of bins is open. A bitset has one bit per amount of
free space, set while an open bin has that much; the smallest set bit at or above a piece's length
is the best fit. When a new bin would exceed the number of open ones, the fullest closes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import batch, table, texts, written

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
END = 2
OPEN_BINS = 512
# Pieces of a wave for each open bin. More would close bins before a short piece has come.
WAVE = 2
# Pieces that one packing task takes in.
PIECES_PER_TASK = 250_000
# Text chunks a Python worker remembers, and bytes of new chunks encoded at a time.
REMEMBERED = 500_000
ENCODED_AT_ONCE = 1 << 18

_OTHER_BLANK = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0  -     　]")
_DOUBLE = ("  ", " \n", "\n ", "\n\n")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    Byte-level pieces never reach from a word into the blank behind it. In texts whose blanks are
    single, each word with its leading blank is therefore encoded once and remembered. New words are
    encoded together; the byte length of each id tells where a word ends. Other texts go whole
    through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.byte_length[i] = len(piece)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: Iterable[str]) -> None:
        """Chunks start with a blank (or are one line end), so joined they are cut as they are alone."""
        group: list[str] = []
        size = 0
        for c in chunks:
            group.append(c)
            size += len(c)
            if size > ENCODED_AT_ONCE:
                self._learn(group)
                group, size = [], 0
        if group:
            self._learn(group)

    def _learn(self, group: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(c.encode()) for c in group])
        cuts = np.searchsorted(np.cumsum(self.byte_length[ids]), ends, "left") + 1
        data, start = ids.tobytes(), 0
        for c, cut in zip(group, cuts.tolist(), strict=True):
            self.known[c] = data[4 * start : 4 * cut]
            start = cut

    def plain(self, text: str) -> bool:
        return not (
            text[0] in " \n"
            or text[-1] in " \n"
            or any(s in text for s in _DOUBLE)
            or _OTHER_BLANK.search(text)
            or "\0" in text
            or any(s in text for s in self.special)
        )

    def encode(self, documents: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found: list[bytes | None] = [None] * len(documents)
        open_: list[tuple[int, list[str], list[bytes | None]]] = []
        get = self.known.get
        fresh: set[str] = set()
        for k, text in enumerate(documents):
            if not text:
                found[k] = b""
            elif self.plain(text):
                chunks = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
                ids = list(map(get, chunks))
                if None in ids:
                    fresh.update(c for c, x in zip(chunks, ids, strict=True) if x is None)
                    open_.append((k, chunks, ids))
                else:
                    found[k] = b"".join(ids)
            else:
                found[k] = self.whole(text)
        # The first word of a text has no leading blank; joined, it would run into the chunk before it.
        self.learn(sorted(c for c in fresh if c[0] in " \n"))
        for c in sorted(c for c in fresh if c[0] not in " \n"):
            self.known[c] = self.whole(c)
        for k, chunks, ids in open_:
            found[k] = b"".join([get(c) if x is None else x for c, x in zip(chunks, ids, strict=True)])
        return found


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def pieces(documents: DataFrame, tokenizer: str | None = None, limit: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Per document its ids and the end id; longer ones in pieces of `limit`, the first being shorter.

    A null or empty text is the end id alone. A repeated row is packed again. `keep_ids` adds the ids.
    """
    schema = PIECES if keep_ids else PIECES.remove(5)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer is None:
            import public_tokenizers

            enc = encoder(public_tokenizers.path(TOKENIZER))
        else:
            enc = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out: dict[str, list] = {n: [] for n in schema.names}
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, k = 0, 0
                    while start < n:
                        length = (n - start) % limit or limit
                        own = ids[4 * start : 4 * (start + length)]
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(own))
                        if keep_ids:
                            out["ids"].append(own)
                        start, k = start + length, k + 1
                yield batch(out, schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return texts(documents).mapInArrow(run, kinds)


class OpenBins:
    """At most `most` open bins; `free` bit f is set while a bin with f free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0
        self.opened = 0

    def _put(self, free: int, number: int) -> None:
        self.at[free].append(number)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        number = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to `capacity` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        if free > length:
            self._put(free - length, number)
        return number, self.capacity - free


def pack(parts: DataFrame, limit: int = SEQUENCE, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset. Each task packs about `per_task` pieces, in waves, the longest of a wave first.

    A wave is a share of the task's pieces taken by hash, so long and short ones come together; bins stay
    open from one wave to the next. The order within a wave is by length, then doc_id, piece and start,
    so a repeated task gives the same sequences; ids are the task's number with the bin's number within it.
    """
    total = parts.count()
    tasks = max(1, -(-total // per_task))
    waves = max(1, -(-total // (tasks * WAVE * open_bins)))
    names = parts.columns
    key = (F.coalesce("doc_id", F.lit(-1)), "piece", "start", "ids_crc32")
    by, wave = F.pmod(F.xxhash64(*key), F.lit(tasks)), F.pmod(F.xxhash64(*key, F.lit(WAVE)), F.lit(waves))
    dealt = parts.withColumn("__task", by.cast("int")).withColumn("__wave", wave).repartition(tasks, "__task").sortWithinPartitions(
        "__task", "__wave", F.desc("length"), "doc_id", "piece", "start", "ids_crc32"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = OpenBins(limit, open_bins), None
        for b in batches:
            numbers, offsets = [], []
            for t, n in zip(b.column("__task").to_pylist(), b.column("length").to_pylist(), strict=True):
                if t != task:
                    bins, task = OpenBins(limit, open_bins), t
                number, offset = bins.place(n)
                numbers.append((t << 40) + number)
                offsets.append(offset)
            kept = b.select(names)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def best_fit(documents: DataFrame, tokenizer: str | None = None, limit: int = SEQUENCE, open_bins: int = OPEN_BINS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place. An empty table gives no rows."""
    parts, _ = written(pieces(documents, tokenizer, limit, keep_ids))
    return pack(parts, limit, open_bins)


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit(table(spark, folder, "documents"))

