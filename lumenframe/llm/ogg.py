"""Media columns in Ogg: pages with checksums, packets by lacing values, several logical streams, granule timestamps.

`pack` stores a payload as 8-bit samples in two logical streams (even and odd samples, like two channels); their pages
are multiplexed by time, and packets run on over page ends. `packets` and `unpack` read any number of streams back: each
page's checksum is verified, packets are put together from the lacing values, pages go to their stream by serial number,
and a packet's time follows from its page's granule position and the samples of the packets after it.

Null texts are empty. Payloads are padded with zero bytes to a positive multiple of `PAD`. A damaged, cut or foreign
column value gives status = the reason and nulls, never an exception; null media have status "empty". Repeated rows and
empty tables are as they are; other columns pass through, but for the names that a function adds. Equal payloads give
equal media: serial numbers derive from the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, slim

PAD, RATE, PACKET, PAGE_SEGMENTS = 64, 8000, 1024, 50
MAGIC = b"LFPCM8\x00\x01"
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sIHHQ")  # magic, rate, channel, channels, bytes before padding
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (most significant bit first, start 0) by zlib's, which runs over the mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    rest = bytes([len(lacing)]) + lacing + body
    head = struct.pack("<4sBBqII", b"OggS", 0, kind, granule, serial, number)
    return head + struct.pack("<I", checksum(head + b"\0\0\0\0" + rest)) + rest


def stream(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, int, bytes]]:
    """(time, serial, page) of one logical stream; packets: (data, granule at its end). The first packet has its page."""
    out, number = [], 0
    pending: list[tuple[bytes, int, bool]] = []  # segments: data, granule if it ends a packet, whether it begins one

    def flush(last: bool) -> None:
        nonlocal number, pending
        ends = [g for _, g, _ in pending if g >= 0]
        kind = (0 if pending[0][2] else CONTINUED) | (FIRST if number == 0 else 0) | (LAST if last else 0)
        body = b"".join(s for s, _, _ in pending)
        out.append((ends[-1] if ends else -1, serial, page(kind, ends[-1] if ends else -1, serial, number, bytes(len(s) for s, _, _ in pending), body)))
        number, pending = number + 1, []

    for k, (data, granule) in enumerate(packets):
        for at in range(0, len(data) + 1, 255):
            segment = data[at : at + 255]
            pending.append((segment, granule if len(segment) < 255 else -1, at == 0))
            if len(pending) == PAGE_SEGMENTS and not (k == len(packets) - 1 and len(segment) < 255):
                flush(False)
        if k == 0 and pending:
            flush(len(packets) == 1)
    if pending:
        flush(True)
    now = 0  # pages without a packet's end keep their place
    for i, (g, s, p) in enumerate(out):
        now = max(now, g)
        out[i] = (now, s, p)
    return out


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % PAD if raw else PAD)


def write(raw: bytes, channels: int = 2) -> bytes:
    payload = pad(raw)
    base, pages = zlib.crc32(payload), []
    for c in range(channels):
        samples = payload[c::channels]
        packets = [(_ID.pack(MAGIC, RATE, c, channels, len(raw)), 0)]
        packets += [(samples[i : i + PACKET], min(i + PACKET, len(samples))) for i in range(0, len(samples), PACKET)]
        pages += stream((base + c) & 0xFFFFFFFF, packets)
    heads = [x for x in pages if x[0] == 0]
    rest = sorted((x for x in pages if x[0] != 0), key=lambda x: x[0])
    return b"".join(p for _, _, p in heads + rest)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(kind, granule, serial, number, lacing, body) of each page, checked."""
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size or media[at : at + 4] != b"OggS":
            raise ValueError("not a page")
        _, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + _HEAD.size : at + _HEAD.size + n]
        end = at + _HEAD.size + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError("page cut short")
        whole = media[at:end]
        if checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            raise ValueError("page checksum")
        yield kind, granule, serial, number, lacing, whole[_HEAD.size + n :]
        at = end


def read(media: bytes) -> tuple[dict[int, list[tuple[bytes, int]]], int]:
    """For each serial its packets (data, granule at the end; header packets have 0), and the number of pages."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    partial: dict[int, list[bytes]] = {}
    next_page: dict[int, int] = {}
    closed: set[int] = set()
    count = 0
    for kind, granule, serial, number, lacing, body in pages_of(media):
        count += 1
        if bool(kind & FIRST) != (serial not in streams) or serial in closed:
            raise ValueError("stream order")
        if number != next_page.get(serial, 0):
            raise ValueError("page missing")
        if bool(kind & CONTINUED) != bool(partial.get(serial)):
            raise ValueError("packet not continued")
        next_page[serial] = number + 1
        done, at, open_ = [], 0, partial.setdefault(serial, [])
        for size in lacing:
            open_.append(body[at : at + size])
            at += size
            if size < 255:
                done.append(b"".join(open_))
                open_.clear()
        if bool(done) != (granule >= 0):
            raise ValueError("granule position")
        ends, end = [], granule
        for data in reversed(done):  # 8-bit samples: a packet lasts as many samples as it has bytes
            ends.append(end)
            end -= len(data)
        streams.setdefault(serial, []).extend(zip(done, reversed(ends)))
        if kind & LAST:
            closed.add(serial)
    if closed != set(streams) or any(partial.values()):
        raise ValueError("stream not ended")
    return streams, count


def samples(media: bytes) -> tuple[bytes, int, dict[str, int]]:
    """The payload put together from all streams, the bytes before padding, and counts. What the streams' headers say must
    agree among them and with the payload."""
    streams, pages = read(media)
    parts: dict[int, bytes] = {}
    heads, n_packets = set(), 0
    if not streams:
        raise ValueError("no stream")
    for packets in streams.values():
        if not packets or len(packets[0][0]) != _ID.size:
            raise ValueError("stream header")
        magic, rate, channel, channels, n_bytes = _ID.unpack(packets[0][0])
        heads.add((channels, n_bytes))
        if magic != MAGIC or rate != RATE or len(heads) > 1 or channel in parts:
            raise ValueError("stream header")
        now = 0
        for data, end in packets[1:]:
            if end - len(data) != now:
                raise ValueError("gap in time")
            now = end
        n_packets += len(packets) - 1
        parts[channel] = b"".join(data for data, _ in packets[1:])
    if sorted(parts) != list(range(channels)):
        raise ValueError("stream missing")
    size = sum(map(len, parts.values()))
    if size != max(PAD, -(-n_bytes // PAD) * PAD) or any(len(part) != len(range(c, size, channels)) for c, part in parts.items()):
        raise ValueError("stream length")
    out = np.empty(size, dtype=np.uint8)
    for c, part in parts.items():
        out[c::channels] = np.frombuffer(part, dtype=np.uint8)
    return out.tobytes(), n_bytes, {"streams": len(parts), "pages": pages, "packets": n_packets, "ms": len(parts[0]) * 1000 // RATE}


def feature(payload: bytes, counts: dict[str, int]) -> str:
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    loud = {"sum": int(x.sum()), "travel": int(np.abs(np.diff(x)).sum()), "crossings": int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())}
    return " ".join(f"{k}={v}" for k, v in (counts | loud).items())


def pack(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with the text column replaced by the Ogg bytes of its UTF-8."""
    rest = df.drop(media)
    schema = T.StructType([f for f in rest.schema.fields if f.name != text] + [T.StructField(media, T.BinaryType())])

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            done = [write((t or "").encode("utf-8", "surrogatepass")) for t in pdf[text]]
            yield pdf.drop(columns=text).assign(**{media: done})

    return rest.mapInPandas(run, schema)


#: What `unpack` adds.
READ = "status string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def unpack(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the media column, with what was read back from it (READ)."""
    added = T._parse_datatype_string(READ)
    rest = df.drop(*added.names)
    schema = T.StructType([f for f in rest.schema.fields if f.name != media] + added.fields)

    def one(x: bytes | None) -> list:
        if x is None:
            return ["empty", *[None] * 7]
        own = [len(x), hashlib.sha256(x).hexdigest()]
        try:
            payload, n_bytes, counts = samples(bytes(x))
        except ValueError as e:
            return [str(e), None, None, None, None, *own, None]
        return ["ok", n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, feature(payload, counts)]

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            got = pd.DataFrame([one(x) for x in pdf[media]], columns=added.names, index=pdf.index, dtype=object)
            yield pd.concat([pdf.drop(columns=media), got], axis=1)

    return rest.mapInPandas(run, schema)


def packets(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each packet of df's media: the other columns, serial, packet, start_ms, end_ms, data. Damaged media
    give one row with the reason in status."""
    added = T._parse_datatype_string("status string, serial long, packet int, start_ms double, end_ms double, data binary")
    rest = df.drop(*added.names)
    keep = [f.name for f in rest.schema.fields if f.name != media]
    schema = T.StructType([f for f in rest.schema.fields if f.name != media] + added.fields)

    def rows(x: bytes | None) -> list[list]:
        if x is None:
            return [["empty", *[None] * 5]]
        try:
            streams, _ = read(bytes(x))
        except ValueError as e:
            return [[str(e), *[None] * 5]]
        ms = lambda g: g * 1000 / RATE
        return [["ok", s, i, ms(max(0, end - len(d))), ms(end), d] for s, ps in streams.items() for i, (d, end) in enumerate(ps)]

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                got = pd.DataFrame(rows(pdf[media].iloc[k]), columns=added.names, dtype=object)
                head = pdf[keep].iloc[[k] * len(got)].reset_index(drop=True)
                yield pd.concat([head, got], axis=1)

    return rest.mapInPandas(run, schema)
