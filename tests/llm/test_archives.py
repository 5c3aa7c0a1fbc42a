"""WARC archives and transport streams: round trips, faults, and the defined cases."""

import base64
import hashlib
import struct
import zlib

import pytest

pytest.importorskip("zstandard")

from faultsieve.llm import transport_stream as T  # noqa: E402
from faultsieve.llm import warc_zst as Z  # noqa: E402

PAGES = "page_id long, url string, html string, sha string, largest int"


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip_of_pages(spark):
    html = {1: "<p>é", 2: "same", 3: "same", 4: None, 5: "", 6: "x" * 300_000, 7: "same", 8: "\r\n\r\n"}
    rows = [(k, None if k == 2 else f"http://e.org/{k}\n é", v, "s", 1) for k, v in html.items()] + [(None, "u", "only", "s", 1), (7, "again", "same", "s", 1)]
    got = Z.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    for r in got:
        text = "only" if r.page_id is None else html[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), b32(text))
        group = [k for k, v in html.items() if (v or "") == text]
        if r.page_id is None or r.page_id == max(group):
            assert (r.record_type, r.refers_to) == ("response", None)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", max(group))
    assert Z.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_short_payloads_may_be_left_out_of_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcd", "", 0), (4, "u", "abcd", "", 0)], PAGES)
    assert {r.page_id: r.record_type for r in Z.round_trip(pages, least=3).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_files_and_faults(spark, tmp_path):
    record = Z.record(1, "u", b"payload", b32("payload"), None, "2000-01-01T00:00:00Z")
    (tmp_path / "a.warc.zst").write_bytes(Z.pack([record] * 20))
    rows = Z.read_files(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and {bytes(r.payload) for r in rows} == {b"payload"}
    for bad in (record[:-1], record.replace(b"WARC-Date", b"WARC-Dote"), record.replace(b"payload\r\n\r\n", b"paylood\r\n\r\n"), b"x", record.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            Z.parse(bad)
    cut = list(Z.frames(Z.pack([record] * 3)[:-5]))
    assert [isinstance(x, ValueError) for x in cut] == [False, False, True]
    assert list(Z.frames(b"")) == []


def test_reading_goes_on_behind_damaged_frames(spark, tmp_path):
    records = [Z.record(i, "u", f"payload {i} ".encode() * 50, b32(f"payload {i} " * 50), None, "2000-01-01T00:00:00Z") for i in range(30)]
    whole = Z.pack(records)
    assert list(Z.frames(whole)) == records
    starts = [i for i in range(len(whole)) if whole.startswith(Z.FRAME_START, i)]
    damaged = bytearray(whole)
    for k in (3, 4, 10):  # two neighbours are one run of bytes that don't decode
        damaged[starts[k] + 4 : starts[k] + 16] = b"\xff" * 12
    got = list(Z.frames(bytes(damaged)))
    assert [x for x in got if isinstance(x, bytes)] == [r for i, r in enumerate(records) if i not in (3, 4, 10)]
    assert [i for i, x in enumerate(got) if isinstance(x, ValueError)] == [3, 9]
    no_dictionary = whole[:8] + b"\x37\xa4\x30\xec" + b"\xff" * (struct.unpack_from("<I", whole, 4)[0] - 4) + whole[8 + struct.unpack_from("<I", whole, 4)[0] :]
    assert all(isinstance(x, ValueError) for x in Z.frames(no_dictionary))
    (tmp_path / "a.warc.zst").write_bytes(bytes(damaged))
    rows = Z.read_files(spark, str(tmp_path)).collect()
    assert len(rows) == 29 and sum(r.error is None for r in rows) == 27


def test_compressed_dictionary_in_front():
    import zstandard

    plain = Z.pack([b"WARC/1.1 record %d " % i * 30 for i in range(50)])
    size = struct.unpack_from("<I", plain, 4)[0]
    packed = zstandard.compress(plain[8 : 8 + size])
    again = struct.pack("<II", Z.DICTIONARY_FRAME, len(packed)) + packed + plain[8 + size :]
    assert list(Z.frames(again)) == list(Z.frames(plain)) and len(list(Z.frames(again))) == 50


@pytest.mark.parametrize("n", [192, 384, 3072, 3264, 192 * 100, 192 * 1000])
def test_stream_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    stream = T.mux(payload)
    back, units, errors = T.demux(stream)
    assert back == payload and errors == 0 and len(stream) % 188 == 0
    assert units[0] == (0, 0, min(n, T.UNIT_BYTES), True) and sum(u[2] for u in units) == n
    assert [u[3] for u in units] == [i % T.RANDOM_EVERY == 0 for i in range(len(units))]


def test_stream_faults():
    stream = T.mux(b"a" * 192 * 40)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert T.demux(b"".join(packets[:4] + packets[3:]))[2] == 0  # a packet sent twice is dropped
    payload, units, errors = T.demux(b"".join(packets[:5] + packets[6:]))  # a lost packet takes the rest of its unit along
    assert errors == 1 and len(units) == 3 and units[0][2] < T.UNIT_BYTES and units[1][2] == T.UNIT_BYTES and len(payload) == sum(u[2] for u in units)
    other = packets[4][:-1] + b"!"
    assert T.demux(b"".join(packets[:5] + [other] + packets[5:]))[2] == 1  # an equal counter with other bytes is no repeat
    with pytest.raises(ValueError):
        T.demux(stream[:-1])
    with pytest.raises(ValueError):
        T.demux(stream[:20] + b"!" + stream[21:])
    assert T.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damaged_values_give_rows_with_errors(spark):
    good = T.mux(b"a" * 192 * 40)
    packets = [good[i : i + 188] for i in range(0, len(good), 188)]
    long_field = packets[2][:4] + b"\xb8" + packets[2][5:]
    values = [good, None, b"", good[:-1], good[:376], b"".join(packets[:5] + packets[6:]), b"".join([*packets[:2], long_field, *packets[3:]]), b"\x47" * 188, good[:200] + b"x" + good[201:]]
    media = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in T.digest(media).collect()}
    assert got[0].error is None and got[0].payload_bytes == 7680
    assert [got[i].error for i in (1, 2, 4, 5)] == ["no stream", "no units", "no units", "1 continuity errors"] and "continuity_errors=1" in got[5].feature
    assert all(got[i].payload_sha256 is None and got[i].error for i in (1, 2, 3, 4, 6)) and len(got) == len(values)
    assert got[1].media_bytes is None and got[3].media_bytes == len(good) - 1
    assert {r.doc_id for r in T.units(media).collect()} >= {0, 5}


def test_time_stamps_keep_33_bits():
    for pts in (0, 1, 0x7FFF, 1 << 15, 1 << 30, (1 << 33) - 1):
        a, b, c = int.from_bytes(T._stamp(pts)[:1]), int.from_bytes(T._stamp(pts)[1:3]), int.from_bytes(T._stamp(pts)[3:])
        assert (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1 == pts


def test_media_query(documents):
    texts = {1: None, 2: "", 3: "é" * 100, 4: "word " * 20_000, 5: "é" * 100}
    rows = {r.doc_id: r for r in T.digest(T.store(documents(texts.items()))).collect()}
    for k, text in texts.items():
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert all(r.error is None for r in rows.values())
    assert rows[3][3:] == rows[5][3:] and rows[1][3:] == rows[2][3:]
    assert T.digest(T.store(documents([]))).count() == 0
    listed = T.units(T.store(documents([(4, texts[4])]))).orderBy("unit").collect()
    assert len(listed) == -(-rows[4].payload_bytes // T.UNIT_BYTES) and listed[0].random_access and listed[8].pts > listed[7].pts


def _foreign(kind, block, *more, record_id="<urn:uuid:00000000-0000-0000-0000-000000000001>"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "".join(f"{h}\r\n" for h in head).encode() + b"\r\n" + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response"


def test_archives_of_others(spark, tmp_path):
    records = [
        _foreign("warcinfo", b"software: x", "Content-Type: application/warc-fields"), _foreign("request", b"GET / HTTP/1.1\r\n\r\n", HTTP.replace("response", "request")), _foreign("metadata", b"a: b"),
        _foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nno length", HTTP, "WARC-Target-URI: http://e.org/"), _foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", HTTP, "WARC-Payload-Digest: sha256:zz"),
        _foreign("response", b"20200101 1.2.3.4", "Content-Type: text/dns"), _foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc", HTTP, "WARC-Truncated: length"), _foreign("strange", b"z"),
        _foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", HTTP, "WARC-Refers-To: <urn:uuid:7>"), _foreign("resource", b"r", record_id="<" + Z.URN + "9" * 30 + ">"), _foreign("resource", b"r", "WARC-Block-Digest: sha1:AAAA"),
        _foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 40 + b"\r\n\r\nabc", HTTP), _foreign("metadata", b"a", "Folded: one\r\n two"), _foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nabc", HTTP),
    ]
    (tmp_path / "o.warc.zst").write_bytes(Z.pack(records))
    rows = Z.read_files(spark, str(tmp_path)).collect()
    assert [r.error is None for r in rows] == [True] * 10 + [False, False, True, False]
    assert [r.record_type for r in rows[:6]] == ["warcinfo", "request", "metadata", "response", "response", "response"] and rows[7].record_type == "strange"
    assert [bytes(r.payload) for r in rows[2:7]] == [b"a: b", b"no length", b"abc", b"20200101 1.2.3.4", b"abc"] and bytes(rows[1].payload) == b""
    assert rows[3].payload_digest == b32("no length") and rows[3].page_id is None and rows[3].record_id.startswith("urn:uuid:") and rows[3].url == "http://e.org/"
    assert (rows[8].record_type, rows[8].refers_to, rows[8].refers_to_id, rows[8].payload) == ("revisit", None, "urn:uuid:7", None)
    assert rows[9].page_id is None and rows[9].record_id.endswith("9" * 30)


def test_flipped_bytes_give_rows(spark):
    """No damage of an archive or a stream stops a reader."""
    import random

    rng = random.Random(6)
    archive = Z.pack([Z.record(i, "u", f"payload {i} ".encode() * 9, b32(f"payload {i} " * 9), None if i % 3 else i + 1, "2000-01-01T00:00:00Z") for i in range(12)])
    plain = Z.record(5, "u", b"payload", b32("payload"), None, "2000-01-01T00:00:00Z")
    stream = T.mux(b"a" * 192 * 12)

    def flipped(data):
        out = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            out[rng.randrange(len(out))] = rng.randrange(256)
        return bytes(out[: rng.randrange(len(out))] if rng.random() < 0.1 else out)

    for _ in range(300):
        try:
            Z.parse(flipped(plain))
        except ValueError:
            pass
    archives = spark.createDataFrame([(flipped(archive),) for _ in range(150)], "archive binary")
    assert Z.read_archives(archives).where("error is not null").count() > 0
    media = spark.createDataFrame([(i, 1, flipped(stream)) for i in range(300)], "doc_id long, n_bytes long, media binary")
    assert T.digest(media).count() == 300 and T.units(media).count() > 0


def test_damaged_program_tables_give_rows(spark):
    data = T.mux(b"a" * 192)[2 * T.PACKET :]
    pat, pmt = T.TABLES[: T.PACKET], T.TABLES[T.PACKET :]
    odd = [T._table(0, 0, 1, b"\x00\x01") + pmt, pat + T._table(T.PMT_PID, 2, T.PROGRAM, b"\x00"), pat + T._table(T.PMT_PID, 2, T.PROGRAM, b""), pat + T._table(T.PMT_PID, 2, T.PROGRAM, struct.pack(">HH", 0xE000, 0xF000) + b"\x06\xe1"), pat + T._table(T.PMT_PID, 2, T.PROGRAM, struct.pack(">HH", 0xE000, 0xFFFF))]
    media = spark.createDataFrame([(i, 1, tables + data) for i, tables in enumerate(odd)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in T.digest(media).collect()}
    assert len(got) == len(odd) and all(r.error and r.payload_sha256 is None for r in got.values())
