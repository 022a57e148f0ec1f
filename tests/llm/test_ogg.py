import hashlib
import random
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import ogg
from lumenframe.llm.queries import op2_ogg_pages
from tests.llm.helpers import DATA


def slow_checksum(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = (r << 1) ^ 0x104C11DB7 if r & 0x80000000 else r << 1
    return r & 0xFFFFFFFF


@given(st.binary(max_size=300))
def test_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 120_000), st.integers(1, 3))
def test_round_trip(n, channels):
    raw = random.Random(n).randbytes(n)
    payload, n_bytes, counts = ogg.samples(ogg.write(raw, channels))
    assert n_bytes == n and payload == raw + b"\0" * (-n % 64 if n else 64) and counts["streams"] == channels


def test_every_damaged_byte_is_seen():
    media = ogg.write(b"some bytes" * 30)
    for i in range(len(media)):
        bad = bytearray(media)
        bad[i] ^= 0x10
        try:
            ogg.samples(bytes(bad))
        except ValueError:
            continue
        raise AssertionError(i)


def test_missing_and_swapped_pages():
    media = ogg.write(random.Random(1).randbytes(60_000))
    starts = [m for m in range(len(media)) if media[m : m + 4] == b"OggS"]
    pages = [media[a:b] for a, b in zip(starts, [*starts[1:], len(media)])]
    assert b"".join(pages) == media and len(pages) > 6
    for broken in (pages[:2] + pages[3:], pages[:-1], pages[:2] + [pages[4], pages[2], pages[3]] + pages[5:]):
        try:
            assert ogg.samples(b"".join(broken))[0] == ogg.samples(media)[0]  # another order of streams is no damage
        except ValueError:
            pass


def test_media_without_streams_packets_or_the_right_lengths(spark):
    """Valid pages that hold no payload of ours: a reason, never an exception."""
    serial = 7
    empty_page = ogg.page(ogg.FIRST | ogg.LAST, -1, serial, 0, b"", b"")
    head = lambda n, channels=1, c=0: ogg._ID.pack(ogg.MAGIC, ogg.RATE, c, channels, n)
    one = lambda packets, s=serial: b"".join(p for _, _, p in ogg.stream(s, packets))
    cases = {
        b"": "no stream",
        empty_page: "stream header",
        one([(head(9), 0)]): "stream length",
        one([(head(999), 0), (b"x" * 64, 64)]): "stream length",
        one([(head(9), 0), (b"x" * 63, 63)]): "stream length",
        one([(head(9, 2), 0), (b"x" * 32, 32)]) + one([(head(8, 2, 1), 0), (b"x" * 32, 32)], 8): "stream header",
        one([(head(9, 2), 0), (b"x" * 32, 32)]): "stream missing",
    }
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(cases)], "doc_id long, media binary")
    assert [r.status for r in ogg.unpack(df).orderBy("doc_id").collect()] == list(cases.values())
    assert ogg.packets(df).count() >= 3


def test_spark_packets_and_damage(spark):
    df = spark.createDataFrame([(1, "hello " * 2000), (2, "x")], "doc_id long, text string")
    rows = ogg.packets(ogg.pack(df)).filter("doc_id = 1 AND packet > 0").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.serial, r.packet)):
        assert r.start_ms == by.get(r.serial, 0.0)
        by[r.serial] = r.end_ms
    assert len(by) == 2 and set(by.values()) == {12032 / 2 / 8}
    bad = spark.createDataFrame([(1, bytearray(b"OggS nothing" * 3)), (2, None)], "doc_id long, media binary")
    assert [r.status for r in ogg.unpack(bad).orderBy("doc_id").collect()] == ["page cut short", "empty"]
    assert ogg.packets(bad).count() == 2


def plain_reader(media):
    """Pages by their fields, packets by lacing, streams by serial; no code shared with the operator."""
    packets, open_, ends, pages, at = {}, {}, {}, 0, 0
    while at < len(media):
        magic, version, kind, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        body = media[at + 27 + n : at + 27 + n + sum(lacing)]
        page = media[at : at + 27 + n + sum(lacing)]
        assert magic == b"OggS" and version == 0 and slow_checksum(page[:22] + bytes(4) + page[26:]) == crc
        assert bool(kind & 2) == (number == 0) and bool(kind & 1) == bool(open_.get(serial))
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + body[:size]
            body = body[size:]
            if size < 255:
                packets.setdefault(serial, []).append(open_.pop(serial))
        if granule >= 0:
            assert granule == sum(map(len, packets[serial][1:]))
        at, pages = at + len(page), pages + 1
        ends[serial] = kind & 4
    assert not open_ and all(ends.values())
    by = {struct.unpack_from("<8sIHHQ", p[0])[2]: b"".join(p[1:]) for p in packets.values()}
    out = bytearray(sum(map(len, by.values())))
    for c, part in by.items():
        out[c :: len(by)] = part
    return bytes(out), pages, sum(len(p) - 1 for p in packets.values()), len(by)


def test_media_and_features_by_a_plain_reader(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000").limit(60).union(spark.createDataFrame([(-1, None)], "doc_id long, text string")).checkpoint()
    media = {r.doc_id: bytes(r.media) for r in ogg.pack(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in ogg.unpack(ogg.pack(docs)).collect():
        payload, pages, n_packets, streams = plain_reader(media[r.doc_id])
        raw = texts[r.doc_id].encode()
        assert payload == raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        steps = list(zip(payload, payload[1:]))
        want = dict(streams=streams, pages=pages, packets=n_packets, ms=len(payload) // 2 * 1000 // 8000, sum=sum(payload), travel=sum(abs(a - b) for a, b in steps), crossings=sum((a >= 128) != (b >= 128) for a, b in steps))
        assert r.feature == " ".join(f"{k}={v}" for k, v in want.items())


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op2_ogg_pages(spark, DATA).collect():
        raw = docs[r.doc_id]
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
