"""WARC archives of pages in Zstandard frames: a writer, and a reader that validates what it reads.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary, itself a dictionary-free frame
or plain; each record is one frame compressed with it. The reader loads the dictionary, decodes one frame at a time,
and checks the version line, the mandatory headers, the two line ends after each block and every declared length and
digest; an archive that breaks a rule raises ``BrokenArchive`` with its place.

Pages with equal payloads of at least ``least_bytes`` bytes share one response record, that of the largest page_id;
the others are revisit records that refer to it. Rows that repeat that page_id are responses too. Null html is an
empty payload; a null page_id never is the largest, and its record has no page id; a null url gives a record without
target. Extra columns are ignored, whatever their names; an empty table gives an empty result. An archive is read as
a stream, a record at a time, so time grows with its length and memory with its longest record. Workers open the shared
folder by its qualified URI (``folders.opened``).
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import islice
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.shared import fresh_path, settle, table
from dwell.sources.folders import opened, qualified

SKIPPABLE = 0x184D2A5D
_MAGIC = (0xFD2FB528).to_bytes(4, "little")
LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: At most so many payloads hold over one in so many of the pages that share theirs.
HOT = 10_000
_DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class BrokenArchive(ValueError):
    pass


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id) if page_id is not None else uuid.uuid4().urn.join('<>')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """An archive in memory, up to the bound its caller keeps."""

    def __init__(self, dictionary: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self._parts = [struct.pack("<II", SKIPPABLE, len(packed)), packed]
        self.size = 8 + len(packed)
        self.records = 0
        self._compress = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None, write_checksum=True, write_content_size=True
        ).compress

    def add(self, raw: bytes) -> None:
        self._parts.append(frame := self._compress(raw))
        self.size += len(frame)
        self.records += 1

    def bytes(self) -> bytes:
        return b"".join(self._parts)


def _headers(raw: bytes, place: str) -> tuple[dict[str, str], bytes]:
    head, sep, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BrokenArchive(f"{place}: no WARC header")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise BrokenArchive(f"{place}: a header line without a name")
        found[name.strip().lower()] = value.strip()
    return found, block


def parse(raw: bytes, place: str = "record") -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, after checking both."""
    found, rest = _headers(raw, place)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - found.keys():
        raise BrokenArchive(f"{place}: no {', '.join(sorted(missing))}")
    if not found["content-length"].isdigit() or int(found["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise BrokenArchive(f"{place}: its length is not as declared")
    block = rest[:-4]
    declared = found.get("warc-block-digest")
    if declared and declared != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise BrokenArchive(f"{place}: its block digest is not as declared")
    return found, block


class _Frames:
    """The frames of an archive one after the other, each found by its headers and those of its blocks: a stream is
    read once from front to back, and no more than a frame of it is held."""

    def __init__(self, stream: BinaryIO, name: str) -> None:
        self._stream, self.name, self.at = stream, name, 0

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes."""
        got = self._stream.read(n)
        if len(got) != n:
            raise BrokenArchive(f"{self.name}, byte {self.at}: a frame is cut off")
        self.at += n
        return got

    def magic(self) -> int | None:
        """The number a frame begins with, or None at the end."""
        got = self._stream.read(4)
        if not got:
            return None
        if len(got) < 4:
            raise BrokenArchive(f"{self.name}, byte {self.at}: a frame is cut off")
        self.at += 4
        return int.from_bytes(got, "little")

    def skippable(self) -> bytes:
        return self.take(int.from_bytes(self.take(4), "little"))

    def data(self) -> bytes:
        """A data frame, its magic put before it again."""
        flags = self.take(1)
        single = flags[0] >> 5 & 1
        size = (single, 2, 4, 8)[flags[0] >> 6] + (0, 1, 2, 4)[flags[0] & 3] + (1 - single)
        parts = [_MAGIC, flags, self.take(size)]
        last = 0
        while not last:
            head = self.take(3)
            field = int.from_bytes(head, "little")
            last, kind, size = field & 1, field >> 1 & 3, field >> 3
            parts += [head, self.take(1 if kind == 1 else size)]
        if flags[0] >> 2 & 1:
            parts.append(self.take(4))
        return b"".join(parts)


def read_records(archive: bytes | BinaryIO, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, given as bytes or as a stream, one frame each."""
    frames = _Frames(io.BytesIO(archive) if isinstance(archive, bytes) else archive, name)
    decompressor, first = zstandard.ZstdDecompressor(), True
    while True:
        place = f"{name}, byte {frames.at}"
        magic = frames.magic()
        if magic is None:
            return
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a dictionary where it comes first, else of no concern
            held = frames.skippable()
            if first and magic == SKIPPABLE and held:
                if held[:4] == _MAGIC:
                    held = zstandard.ZstdDecompressor().decompress(held)
                kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                if held:
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
        elif magic == int.from_bytes(_MAGIC, "little"):
            one = decompressor.decompressobj()
            try:
                raw = one.decompress(frames.data())
            except zstandard.ZstdError as e:
                raise BrokenArchive(f"{place}: {e}") from None
            if not one.eof:
                raise BrokenArchive(f"{place}: a frame is cut off")
            yield parse(raw, place)
        else:
            raise BrokenArchive(f"{place}: no frame begins here")
        first = False


def _page_id(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def described(found: dict[str, str], block: bytes, place: str = "record") -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's payload is held against them."""
    http, sep, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    size, digest = int(fields[b"Content-Length"]), base64.b32decode(found["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = found["warc-type"]
    if not sep or kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest) or kind == "revisit" and payload:
        raise BrokenArchive(f"{place}: its payload is not as declared")
    return _page_id(found["warc-record-id"]), size, digest, kind, _page_id(found.get("warc-refers-to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of about ``archive_bytes`` below ``folder``, a URI all executors reach, and gives the list of
    those whose tasks were committed: (path, records). A task that is run again writes under new names."""
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("long", F.octet_length("html") >= least_bytes)
    # equal payloads, counted before the exchange: one row for each digest and task
    counted = rows.where("long").groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null")
    shared = settle(counted, "shared")
    # a payload of more than a ten thousandth of the pages is one of under ten thousand, which are broadcast; the
    # others are joined, and rows that take no part in that are dealt out by a hash of their own
    hot = max(1, shared.agg(F.sum("n")).first()[0] or 0) // HOT
    often = shared.where(F.col("n") > hot).select(F.col("digest").alias("of"), F.col("target").alias("often"))
    others = shared.where(F.col("n") <= hot).select(F.col("digest").alias("key"), F.col("target").alias("other"))
    met = rows.join(F.broadcast(often), F.col("long") & (F.col("digest") == F.col("of")), "left")
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url", F.monotonically_increasing_id()).cast("string"))
    met = met.withColumn("key", F.when(F.col("long") & F.col("of").isNull(), F.col("digest")).otherwise(alone))
    target = F.coalesce("often", "other")
    dealt = met.join(others, "key", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(target), target).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        writer = None

        def close() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path, compression=None) as out:
                out.write(writer.bytes())
            return pa.RecordBatch.from_pydict({"path": [path], "records": [writer.records]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256).to_pylist()
                if writer is None:
                    writer = Writer(b"".join(r["html"].encode()[:4096] for r in part[:16])[:DICTIONARY_BYTES])
                for r in part:
                    writer.add(record(r["page_id"], r["url"], r["html"].encode(), bytes.fromhex(r["digest"]), r["refers_to"]))
                    if writer.size >= archive_bytes:
                        yield close()
                        writer = Writer(b"".join(x["html"].encode()[:4096] for x in part[:16])[:DICTIONARY_BYTES])
        if writer is not None and writer.records:
            yield close()

    return dealt.mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives; a list's number of records is held against what was read."""
    folder = qualified(archives.sparkSession, folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = opened(folder)
        for listed in frames:
            for path, n in zip(listed["path"], listed["records"], strict=True):
                read = 0
                with fs.open_input_stream(path, compression=None) as f, io.BufferedReader(f, 1 << 20) as stream:
                    records = (described(*x, path) for x in read_records(stream, path))
                    while got := list(islice(records, 5000)):
                        read += len(got)
                        out = pd.DataFrame(got, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
                if read != n:
                    raise BrokenArchive(f"{path}: {read} records of {n}")

    return archives.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    listed = f"{fresh_path(spark, 'warc-list')}"
    write_archives(table(spark, sf_dir, "pages"), folder).write.parquet(listed)
    archives = spark.read.schema("path string, records long").parquet(listed)
    return read_archives(archives.repartition(max(1, spark.sparkContext.defaultParallelism)), folder)
