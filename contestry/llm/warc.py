"""WARC archives with a shared Zstandard dictionary (8).

An archive starts with a skippable frame that holds the dictionary, so it can be read on its own;
every record behind it is a frame of its own, so one record can be read without the others. The
dictionary is built from a bounded sample of payloads. Of records with the same payload, the one with
the smallest page_id keeps it and the others are revisits that name it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import batch, rows_of, table, work_folder, written

SKIPPABLE = 0x184D2A5D
# Payloads shorter than this are always stored.
LEAST_REVISIT = 100
# Payloads the dictionary is trained on at most, bytes taken of each, and its size.
SAMPLE_PAGES = 1_000
SAMPLE_BYTES = 8_192
DICTIONARY_BYTES = 65_536
# An archive closes once it holds so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
EMPTY_DATE = "1970-01-01T00:00:00Z"


def dictionary(pages: DataFrame, sample: int = SAMPLE_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on about `sample` payloads, chosen by hash; empty if there is too little text."""
    full = pages.filter(F.length("html") > 0)
    share = 1 << 40
    take = share * sample // max(sample, full.count())
    chosen = full.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(share)) < take).select(
        F.encode(F.substring("html", 1, SAMPLE_BYTES), "UTF-8").alias("body")
    ).limit(2 * sample)
    bodies = sorted(bytes(r["body"]) for r in chosen.collect())
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, bodies)) // 8)), bodies).as_bytes()
    except zstandard.ZstdError:
        return b""


def decisions(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest, bytes and refers_to (null for responses) of every row, without payloads."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes")
    )
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(first.filter("n > 1").drop("n"), "digest", "left")
    # Without a smallest id (all are null) every record stays a response.
    differs = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "digest", "bytes", F.when(differs, F.col("first")).alias("refers_to"))


def headers(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


class Writer:
    """One archive: a dictionary frame, then a frame per record. Appears under its name when closed."""

    def __init__(self, folder: str, trained: bytes):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.fs, self.path = fs.FileSystem.from_uri(self.name)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
        self.size = 0
        self.records = 0

    def add(self, head: bytes, body: bytes) -> None:
        frame = self.zstd.compress(head + body + b"\r\n\r\n")
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return {"archive": self.name, "records": self.records, "stored_bytes": self.size}


MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("stored_bytes", pa.int64())])


def write(pages: DataFrame, folder: str, trained: bytes, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row as a record and returns the archives (name, records, bytes).

    Only archives of the list count: a task that is repeated writes new ones under other names.
    """
    # Payloads meet their decision by page; repeated pages carry their digest along.
    body = F.coalesce("html", F.lit(""))
    stored = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), body.alias("html"),
        F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"),
    )
    decided = decisions(pages, least).filter("refers_to is not null").select("page_id", "digest", "refers_to").distinct()
    left = stored["page_id"].eqNullSafe(decided["page_id"]) & (stored["digest"] == decided["digest"])
    rows = stored.join(decided, left, "left").select(stored["page_id"], "url", "html", stored["digest"], "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for ids, urls, bodies, digests, firsts in rows_of(batches, "page_id", "url", "html", "digest", "refers_to"):
            for page, url, text, digest, first in zip(ids, urls, bodies, digests, firsts, strict=True):
                if out is None:
                    out = Writer(folder, trained)
                data = text.encode("utf-8", "surrogatepass")
                target = "" if url is None else "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
                fields = [
                    ("WARC-Record-ID", record_id(page)),
                    ("WARC-Date", EMPTY_DATE),
                    ("WARC-Target-URI", target),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                ]
                if first is None:
                    out.add(headers("response", fields, len(data)), data)
                else:
                    fields += [
                        ("WARC-Refers-To", record_id(first)),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("X-Payload-Length", str(len(data))),
                    ]
                    out.add(headers("revisit", fields, 0), b"")
                if out.size >= archive_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield batch({n: [d[n] for d in done] for n in MANIFEST.names}, MANIFEST)

    return written(rows.mapInArrow(run, "archive string, records long, stored_bytes long"))[0]


def frames(stream: object, trained: list[bytes]) -> Iterator[bytes]:
    """Contents of an archive's record frames, one after another; the dictionary goes into `trained`."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    trained.append(stream.read(size))
    known = zstandard.ZstdCompressionDict(trained[0]) if trained[0] else None
    zstd = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        one, parts = zstd.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record has another length than it says")
    return fields, rest[:size]


READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the listed archives. Stored payloads are checked against their digest."""
    schema = READ if payloads else READ.remove(6)

    def number(name: str) -> int | None:
        digits = name[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (names,) in rows_of(batches, "archive"):
            for name in names:
                own, path = fs.FileSystem.from_uri(name)
                with own.open_input_stream(path, compression=None) as stream:
                    out: dict[str, list] = {n: [] for n in READ.names}
                    size = 0
                    for record in frames(stream, []):
                        fields, body = parsed(record)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        kept = fields["WARC-Type"] == "response"
                        if kept and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{fields['WARC-Record-ID']} in {name} differs from its digest")
                        out["page_id"].append(number(fields["WARC-Record-ID"]))
                        out["payload_bytes"].append(len(body) if kept else int(fields["X-Payload-Length"]))
                        out["payload_digest"].append(digest)
                        out["record_type"].append(fields["WARC-Type"])
                        out["refers_to"].append(None if kept else number(fields["WARC-Refers-To"]))
                        out["url"].append(fields["WARC-Target-URI"])
                        out["payload"].append(body if payloads and kept else None)
                        size += len(body) * payloads + 200
                        if size > 8 << 20:
                            yield batch(out, schema)
                            out, size = {n: [] for n in READ.names}, 0
                    yield batch(out, schema)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    # An archive is one task's work and bounded in size, however many there are.
    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism, "archive").mapInArrow(
        run, kinds + ", payload binary" * payloads
    )


def archive(pages: DataFrame, folder: str | None = None, **how: int) -> DataFrame:
    """Writes `pages` to archives in `folder` (default: a new one in the shared folder); returns their list.

    Null html counts as empty and null urls as the empty address. Null page ids never are the kept
    copy where another id exists. Rows with the same id and payload are all kept as responses.
    """
    return write(pages, folder or work_folder(pages.sparkSession), dictionary(pages), **how)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return read(archive(table(spark, folder, "pages"))).drop("url")


OP8_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
