r"""A writer and reader of Zstandard-compressed WARC archives with an embedded dictionary.

Each archive opens with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's own records, up to
``SAMPLE_BYTES`` of them; each record follows as a frame of its own, compressed with that dictionary. Records reach an archive in the order of the join with
the groups of equal payloads: by digest where Spark shuffles for it, as they are scanned where it doesn't; either way the dictionary is of the records it serves.
Pages have no date of their own, so all records have the one given (``DATE``).

Spark writes the archives itself, so they reach any store that it reaches, and a lost executor's archive is written anew by its commit
protocol: a row is an archive and a file, and the line separator that the text writer ends it with is an empty skippable frame, which
every Zstandard reader passes over. (The files are named part-*.txt; they are .warc.zst files.)

Of records with equal payloads of at least ``least`` bytes that with the smallest page_id is a response, the others are
revisits of it; rows that repeat that page_id are responses too. Null html is an empty payload; a null url has no target
header. A null page_id is never the smallest unless all are null. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise, scratch_path

from .texts import table

DICTIONARY_MAGIC, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame of no bytes
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 32 << 20, 2 << 20, 64 << 10, 3
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = re.compile(rb"([^:\r\n]+): *([^\r\n]*)\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(first: str, *pairs: tuple[str, str | None]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in pairs if v is not None), "\r\n"]).encode()


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with none."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    block = _headers("HTTP/1.1 200 OK", ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))) + payload
    revisit = refers_to is not None
    head = _headers(
        "WARC/1.1",
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", name(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    )
    return head + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the samples are too few to train one, the last of them as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive of ``records``: the dictionary's frame, then a frame for each record."""
    samples, size = [], 0
    for r in records:
        samples.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not samples:
        return
    words = build_dictionary(samples)
    body = words.as_bytes()
    yield DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    words.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    for r in samples:
        yield compressor.compress(r)
    samples.clear()
    for r in records:
        yield compressor.compress(r)


def unpacked(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, at, words = memoryview(archive), 0, None
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                words = zstandard.ZstdCompressionDict(bytes(view[8:end]))
            at = end
        elif magic == FRAME:
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            parts = []
            while not one.eof:
                if at >= len(view):
                    raise ValueError("the archive ends inside a frame")
                chunk = view[at : at + (1 << 16)]
                parts.append(one.decompress(chunk))
                at += len(chunk) - len(one.unused_data)
            yield b"".join(parts)
        else:
            raise ValueError(f"neither a frame nor a skippable one at {at}")


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, of its HTTP block, and the payload."""
    end = data.index(b"\r\n\r\n") + 4
    head = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(data[data.index(b"\r\n") + 2 : end])}
    block = data[end : end + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    return head, {k.decode().lower(): v.decode() for k, v in _HEADER.findall(block[block.index(b"\r\n") + 2 : cut])}, block[cut:]


def archives_of(records: Iterator[tuple[int, bytes]], archive_bytes: int) -> Iterator[bytes]:
    """Whole archives from (payload bytes, record) pairs; each one ends with the record that reaches ``archive_bytes`` of payload."""
    ended = False
    while not ended:

        def one() -> Iterator[bytes]:
            nonlocal ended
            size = 0
            while size < archive_bytes:
                found = next(records, None)
                if found is None:
                    ended = True
                    return
                size += found[0]
                yield found[1]

        if archive := b"".join(frames(one())):
            yield archive


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least: int = 0) -> None:
    """Writes ``pages`` (page_id, url, html) to archives of at most about ``archive_bytes`` of payload each under ``path``.

    Payloads are shuffled once, for the join with the groups of equal payloads; Spark can split the partition of a group with very many
    copies there, as nothing after it needs a group's rows together.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    brief = materialise(rows.select("page_id", "size", "sha1"))
    copies = brief.where(F.col("size") >= least).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("sha1", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    placed = rows.join(copies, "sha1", "left").select("page_id", "url", "size", "sha1", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes]]:
            for b in batches:
                for page_id, url, size, sha1, refers_to, body in zip(*(b.column(i) for i in range(6)), strict=True):
                    b32 = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    content = body.as_py() or b""
                    yield len(content), record(page_id.as_py(), url.as_py(), content, b32, size.as_py(), refers_to.as_py())

        for archive in archives_of(records(), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    packed = placed.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of the records under ``path``; payloads are held against their digests."""
    out = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = [x.split()[0] for x in out.split(", ")]

    def number(name: str | None) -> int | None:
        found = (name or "")[len("<urn:x-page:") : -1]
        return int(found) if found else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(x), type=k) for x, k in zip(zip(*rows), kinds)], names=names)
        for b in batches:
            for content in b.column(0):
                for data in unpacked(content.as_py()):
                    head, http, payload = parsed(data)
                    sha1 = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and (digest(payload) != sha1 or len(payload) != int(http["content-length"])):
                        raise ValueError(f"{head['warc-record-id']}: the payload isn't what its headers say")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), int(http["content-length"]), sha1, head["warc-type"], number(head.get("warc-refers-to")), payload)[: 6 + payloads])
                    size += payloads * len(payload)
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield pack()
                        rows, size = [], 0
        if rows:
            yield pack()

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(unpack, out)


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, sha1(html) as hex, min(page_id) over (partition by html) as first from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(hex, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) // (1 << cast(5 * (3 - i % 4) as bigint))) % 32 + 1 as bigint), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d
"""
