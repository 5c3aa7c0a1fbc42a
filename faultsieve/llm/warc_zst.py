"""WARC archives in Zstandard: one frame for each record, and the dictionary in a leading skippable frame.

An archive is a value of a binary column (a whole .warc.zst file), so archives are written and read as a table in shared
storage; `read_files` reads such files from any file system Spark knows. Each task trains a dictionary on the first
records of each archive that it writes and starts a new archive after about `ARCHIVE_BYTES`.

Of records with equal payloads (by SHA-1) of at least `least` bytes, the one with the largest page_id is written as a
response and the others as revisits without a payload. The reader checks each record's version, named headers, lengths,
trailing line ends, and a payload digest; a faulty record becomes a row with its error, and reading
goes on; so does it behind bytes that don't decode, at the next frame that does. Archives of others are read alike: records of
every type are listed, with their names as texts.

Defined cases: a null html is an empty payload; rows that repeat the largest page_id are all responses; where no row of a
payload has a page_id, all are responses; a null url gives no target header; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 16_384
SAMPLE_BYTES = 1_000_000
#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: The first bytes of a frame.
FRAME_START = struct.pack("<I", 0xFD2FB528)
END = b"\r\n"
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_id string, payload binary, error string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record refers_to."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + END + block + END + END


def pack(records: list[bytes]) -> bytes:
    """An archive of records."""
    sample, n = [], 0
    for r in records:
        sample.append(r[: SAMPLE_BYTES // 4])
        n += len(sample[-1])
        if n >= SAMPLE_BYTES:
            break
    try:
        own = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small records
        own = zstandard.ZstdCompressionDict((sample[0] if sample else b"")[:DICTIONARY_BYTES].ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = own.as_bytes()
    write = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(write.compress, records)])


def frames(archive: bytes) -> Iterator[bytes | ValueError]:
    """Records of an archive, decoded one frame at a time with the dictionary of its leading frame.

    Bytes that don't decode give one error, and reading goes on at the next frame that does.
    """
    view, at, options, failed = memoryview(archive), 0, {}, False
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8 : 8 + size])
        at = 8 + size
        try:
            if raw[:4] == FRAME_START:  # the dictionary may itself be compressed
                raw = zstandard.ZstdDecompressor().decompress(raw)
            options["dict_data"] = zstandard.ZstdCompressionDict(raw)
            zstandard.ZstdDecompressor(**options)
        except (zstandard.ZstdError, ValueError) as e:
            yield ValueError(f"dictionary: {e}")
            options = {}
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(view):
        begin = at
        try:
            if (struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0) == 0x184D2A50:  # another skippable frame
                at += 8 + struct.unpack_from("<I", view, at + 4)[0]
                continue
            one = reader.decompressobj(read_across_frames=False)
            got, step = [], 1 << 16
            while not one.eof:
                if at >= len(view):
                    raise ValueError("the archive ends within a frame")
                part = view[at : at + step]
                got.append(one.decompress(part))
                at += len(part)
            at -= len(one.unused_data)
            failed = False
            yield b"".join(got)
        except (zstandard.ZstdError, struct.error, ValueError) as e:
            if not failed:
                yield ValueError(f"frame: {e}")
            failed, at = True, archive.find(FRAME_START, begin + 1)
            if at < 0:
                return


def _number(text: str, what: str) -> int:
    """A whole number that 64 bits hold."""
    if not (text.isascii() and text.isdigit() and len(text) < 19):
        raise ValueError(f"{what} is no number")
    return int(text)


def _page(urn: str) -> int | None:
    """The page_id of a name that `record` gave; other names have none."""
    name = urn.removeprefix(URN)
    digits = name.removeprefix("-")
    return int(name) if urn.startswith(URN) and digits.isascii() and digits.isdigit() and len(digits) < 19 else None


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Headers by their name in small letters; lines that begin with white space go on with the one before."""
    named, last = {}, ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            named[last] += " " + line.decode().strip()
            continue
        key, colon, value = line.decode().partition(":")
        if not colon or not key:
            raise ValueError("header without a colon")
        last = key.strip().lower()
        named.setdefault(last, value.strip())
    return named


def _http(block: bytes, named: dict[str, str]) -> tuple[bytes, int | None]:
    """Payload of a block with an HTTP message, and the length that its headers give, if they do."""
    http, sep, payload = block.partition(END + END)
    if not sep:
        raise ValueError("no end of HTTP headers")
    size = next((_number(x.partition(b":")[2].decode("latin-1").strip(), "HTTP length") for x in http.split(END)[1:] if x.lower().startswith(b"content-length:")), None)
    return payload, size


def parse(data: bytes) -> tuple:
    """Row of RECORD for one record's bytes; raises ValueError where it is not well formed.

    Names of others are kept as texts (record_id, refers_to_id), page ids are those of our own names. The payload of a response
    or request in HTTP is what follows its headers, of every other record its block. A length and a SHA-1 digest are checked
    where they are given; a record that says it is truncated may be shorter. Without a digest that of the payload is listed.
    """
    head, sep, rest = data.partition(END + END)
    lines = head.split(END)
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC version line or end of headers")
    named = _headers(lines[1:])
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in named:
            raise ValueError(f"no {key} header")
    n = _number(named["content-length"], "content-length")
    if len(rest) != n + 4 or rest[n:] != END + END:
        raise ValueError(f"content-length {n} does not fit a record of {len(rest)} bytes")
    kind, block = named["warc-type"], rest[:n]
    in_http = kind in ("response", "request", "revisit") and named.get("content-type", "").lower().startswith("application/http")
    payload, size = _http(block, named) if in_http else (block, None)
    digest = named.get("warc-payload-digest") or (None if in_http else named.get("warc-block-digest")) or ""
    name, colon, value = digest.partition(":")
    if kind == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        refers = named.get("warc-refers-to", "").strip("<>") or None
        return _page(named["warc-record-id"].strip("<>")), size, value or None, kind, _page(refers or ""), named.get("warc-target-uri"), named["warc-record-id"].strip("<>"), refers, None, None
    if size not in (None, len(payload)) and kind == "response" and "warc-truncated" not in named:
        raise ValueError(f"HTTP length {size} for a payload of {len(payload)} bytes")
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if name.lower() == "sha1" and value.upper() != own and value.lower() != hashlib.sha1(payload).hexdigest() and "warc-truncated" not in named:
        raise ValueError("payload digest does not match")
    return _page(named["warc-record-id"].strip("<>")), len(payload), own, kind, None, named.get("warc-target-uri"), named["warc-record-id"].strip("<>"), None, payload, None


def write_archives(pages: DataFrame, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives (one binary column, archive) of all rows of pages (page_id, url, html)."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    same = own.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("sha", "largest")
    rows = own.join(materialize(same, "warc-repeats"), "sha", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("largest")), None).otherwise(F.col("largest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, sha, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held.append(record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), refers, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["archive"])

    return rows.select("page_id", "url", "payload", "sha", "refers_to").mapInArrow(run, "archive binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of RECORD for all records of the column archive; payloads=False leaves the payload column null."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def rows(data: bytes | None) -> Iterator[tuple]:
        for got in frames(data or b""):
            try:
                if isinstance(got, ValueError):
                    raise got
                row = parse(got)
                yield row if payloads else (*row[:-2], None, None)
            except ValueError as e:
                yield (None,) * (len(schema) - 1) + (str(e),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for row in rows(data.as_py()):
                    out.append(row)
                    size += 200 + len(row[-2] or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return archives.select("archive").mapInArrow(run, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORD for the .warc.zst files at path."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    return read_archives(materialize(write_archives(pages, least), "warc"), payloads=False).drop("payload", "record_id", "refers_to_id")
