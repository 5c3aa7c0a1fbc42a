"""Media columns: MPEG transport streams in a binary column, written and read back.

A payload is cut into access units; each is one elementary packet with a presentation time stamp, carried in transport
packets of 188 bytes behind a program association table and a program map table. Every eighth unit is a random-access
point and holds a clock reference. The reader finds the elementary stream through the tables, checks their CRC-32 and the
continuity counters, drops packets that repeat the one before, reassembles the units and lists their time stamps and
random-access points.

Defined cases: a null text is empty; a payload is the text in UTF-8, filled up with spaces to a positive multiple of 192
bytes; equal texts give equal values; repeated rows each get a row; extra columns are ignored; an empty table gives an empty
result. Lost packets are counted as continuity errors, and what is left of their units is read. A value that is null, has no
units, or is not well formed gives a row whose error says so, with null in place of what can't be read, and no units; `demux`
itself raises ValueError for the latter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
PMT_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
SAMPLES = 192
UNIT_BYTES = 16 * SAMPLES
RANDOM_EVERY = 8
#: Ticks of the 90 kHz clock for one byte at 48,000 bytes a second, times 8.
TICKS = 15


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, not reflected, from all ones."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    section += struct.pack(">I", crc32_mpeg(section))
    return (struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


TABLES = _table(0, 0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)) + _table(PMT_PID, 2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload."""
    out, count = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[at : at + UNIT_BYTES]
        pts = at * TICKS // 8 % (1 << 33)
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data
        field = b""
        if k % RANDOM_EVERY == 0:
            field = b"\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        pos, start = 0, 0x4000
        while pos < len(pes):
            room = 184 - (len(field) + 1 if field else 0)
            left = len(pes) - pos
            if left < room:  # filled up within the adaptation field
                fill = room - left
                field = field.ljust(len(field) + fill, b"\xff") if field else (b"\x00".ljust(fill - 1, b"\xff") if fill > 1 else None)
            head = struct.pack(">BHB", 0x47, start | DATA_PID, (0x10 if field == b"" else 0x30) | count)
            body = b"" if field == b"" else b"\x00" if field is None else bytes([len(field)]) + field
            take = PACKET - 4 - len(body)
            out.append(head + body + pes[pos : pos + take])
            pos, start, field, count = pos + take, 0, b"", (count + 1) & 15
    return b"".join(out)


def _section(packet: bytes, table_id: int) -> bytes:
    at = 5 + packet[4]
    size = struct.unpack_from(">H", packet, at + 1)[0] & 0xFFF if at + 3 <= PACKET else PACKET
    section = packet[at : at + 3 + size]
    if len(section) != 3 + size or size < 9 or section[0] != table_id or crc32_mpeg(section):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, int, int, bool]], int]:
    """Payload, units (time stamp, offset in the payload, bytes, random access) and continuity errors of a stream."""
    if len(stream) % PACKET:
        raise ValueError("the stream does not end with a packet")
    tables: dict[int, int] = {}
    pid_of_data, last, errors, whole, before = -1, -1, 0, True, b""
    units: list[list] = []
    for at in range(0, len(stream), PACKET):
        sync, word, flags = struct.unpack_from(">BHB", stream, at)
        if sync != 0x47 or word & 0x8000:
            raise ValueError(f"no packet at byte {at}")
        pid, start = word & 0x1FFF, word & 0x4000
        if pid == 0 and start:
            body = _section(stream[at : at + PACKET], 0)
            if len(body) % 4:
                raise ValueError("a program table ends within an entry")
            tables = {struct.unpack_from(">H", body, i + 2)[0] & 0x1FFF: struct.unpack_from(">H", body, i)[0] for i in range(0, len(body), 4)}
        elif pid in tables and start:
            body = _section(stream[at : at + PACKET], 2)
            if len(body) < 4:
                raise ValueError("a program table has no program")
            i = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
            while i < len(body):
                if i + 5 > len(body):
                    raise ValueError("a program table ends within an entry")
                kind, to, more = struct.unpack_from(">BHH", body, i)
                if kind == PRIVATE_DATA:
                    pid_of_data = to & 0x1FFF
                i += 5 + (more & 0xFFF)
        elif pid == pid_of_data and flags & 0x10:
            count, packet = flags & 15, stream[at : at + PACKET]
            if count == last and packet == before:  # sent twice
                continue
            lost = last >= 0 and count != (last + 1) & 15
            last, before, errors = count, packet, errors + lost
            begin, random = 4, False
            if flags & 0x20:
                begin, random = 5 + packet[4], bool(packet[4] and packet[5] & 0x40)
                if begin > PACKET:
                    raise ValueError(f"an adaptation field is too long at byte {at}")
            if start:
                units.append([random, []])
            whole = bool(start) or whole and not lost  # what follows a gap within a unit has no known place
            if units and whole:
                units[-1][1].append(packet[begin:])
    out, listed, offset = [], [], 0
    for random, parts in units:
        pes = b"".join(parts)
        if len(pes) < 14:
            raise ValueError("an elementary packet is too short")
        prefix, size, _, stamped, extra = struct.unpack_from(">IHBBB", pes)
        if prefix != 0x100 | PRIVATE_STREAM or not stamped & 0x80 or 9 + extra > len(pes) or (len(pes) != size + 6 and not errors):
            raise ValueError("an elementary packet is damaged")
        a, b, c = struct.unpack_from(">BHH", pes, 9)
        data = pes[9 + extra :]
        listed.append(((a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1, offset, len(data), random))
        out.append(data)
        offset += len(data)
    return b"".join(out), listed, errors


def _read(stream: bytes | None) -> tuple[bytes, list[tuple[int, int, int, bool]], int, str | None]:
    """What `demux` gives, and what is wrong with the stream."""
    if stream is None:
        return b"", [], 0, "no stream"
    try:
        payload, listed, errors = demux(stream)
    except (ValueError, struct.error, IndexError) as e:
        return b"", [], 0, str(e)
    return payload, listed, errors, f"{errors} continuity errors" if errors else None if listed else "no units"


def _column(batch: pa.RecordBatch, i: int) -> Iterator:
    return (x.as_py() for x in batch.column(i))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the stream of the filled-up text, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, media = [], []
                for raw in _column(part, 1):
                    raw = raw or b""
                    sizes.append(len(raw))
                    media.append(mux(raw.ljust(max(1, -(-len(raw) // SAMPLES)) * SAMPLES)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def units(media: DataFrame) -> DataFrame:
    """One row for each access unit of media (doc_id, media): unit, pts, offset, n_bytes, random_access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, stream in zip(_column(batch, 0), _column(batch, 1)):
                rows = [(doc_id, i, *u) for i, u in enumerate(_read(stream)[1])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_()])], names=["doc_id", "unit", "pts", "offset", "n_bytes", "random_access"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, unit long, pts long, offset long, n_bytes long, random_access boolean")


def digest(media: DataFrame) -> DataFrame:
    """What reading each stream of media (doc_id, n_bytes, media) back gives: digests of payload and stream, a feature, and what is wrong with it."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def values(stream: bytes | None) -> tuple:
        payload, listed, errors, error = _read(stream)
        own = (None, None) if stream is None else (len(stream), hashlib.sha256(stream).hexdigest())
        if not listed:
            return None, None, None, *own, None, error
        random = [u[0] for u in listed if u[3]]
        feature = f"units={len(listed)};random_access={len(random)};first_pts={listed[0][0]};last_pts={listed[-1][0]};last_random_pts={random[-1] if random else None};continuity_errors={errors}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, feature, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [values(stream) for stream in _column(batch, 2)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
