"""Media columns: store payloads in Ogg containers and read them back.

The container is read strictly: page checksums are verified, packets are
reassembled from lacing values (also over page borders), logical streams are
demultiplexed by serial number, and packet times come from granule positions.

``store`` writes two logical streams a document: unsigned 8-bit PCM samples (the
payload) and an index stream with one small packet per block of samples.
``inspect`` reads any such container and returns the payload and its features.

Defined cases: a null payload is stored as an empty one; a null or damaged
container gives nulls in every column that ``inspect`` adds but ``error``.
Repeated rows give repeated results; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidevec.llm.common import pick

SAMPLE_RATE = 8000
BLOCK = 4096  # samples in a packet
UNIT = 64  # payloads are padded to a positive multiple of this
PAGE_SEGMENTS = 255
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBBHI")
_INDEX = struct.Struct("<QII")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """The container breaks the format."""


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, zero start and end.

    zlib's CRC is the same polynomial with reflected bits, so bytes are reflected
    first, its start and end values undone, and the result reflected back.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes((length % 255,))


def pages(serial: int, packets: list[tuple[bytes, int]], sequence: int = 0, flags: int = 0) -> Iterator[bytes]:
    """Pages of (packet, granule at its end); a packet may go on over several pages.

    flags: FIRST for the first page, LAST for the last.
    """
    if not packets:
        return
    values, body, ends = bytearray(), bytearray(), []
    for packet, granule in packets:
        values += lacing(len(packet))
        body += packet
        ends.append((len(values), granule))
    at = offset = done = 0
    while at < len(values):
        part = bytes(values[at : at + PAGE_SEGMENTS])
        size = sum(part)
        kind = (CONTINUED if at and values[at - 1] == 255 else 0) | (flags & FIRST if at == 0 else 0)
        if at + len(part) == len(values):
            kind |= flags & LAST
        granule = -1
        while done < len(ends) and ends[done][0] <= at + len(part):
            granule = ends[done][1]
            done += 1
        head = _HEADER.pack(b"OggS", 0, kind, granule, serial, sequence, 0, len(part)) + part
        data = body[offset : offset + size]
        crc = page_checksum(head + data)
        yield head[:22] + crc.to_bytes(4, "little") + head[26:] + data
        at += len(part)
        offset += size
        sequence += 1


def mux(payload: bytes) -> bytes:
    """A container with the samples and their index; the same payload gives the same bytes."""
    serial = zlib.crc32(payload)
    other = serial ^ 0x5A5A5A5A
    out = list(pages(serial, [(_PCM.pack(b"PCM     ", 0, 0, 1, SAMPLE_RATE, 8, 1, BLOCK, 0), 0)], 0, FIRST))
    out += pages(other, [(b"INDEX\x00\x00\x01", 0)], 0, FIRST)
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    data, end = [], 0
    for block in blocks:
        end += len(block)
        data.append((block, end))
    index = [(_INDEX.pack(granule - len(block), len(block), zlib.crc32(block)), granule) for block, granule in data]
    # sixteen blocks of samples, then their index entries, and so on: the streams interleave
    a = b = 1
    for i in range(0, len(data), 16):
        flag = LAST if i + 16 >= len(data) else 0
        new = list(pages(serial, data[i : i + 16], a, flag))
        a += len(new)
        more = list(pages(other, index[i : i + 16], b, flag))
        b += len(more)
        out += new + more
    return b"".join(out)


def demux(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream, in order, with the granule of the page that ends the packet
    (None for all but the last packet that ends on a page).

    Raises OggError for a bad capture pattern, version, checksum, sequence, flag or length.
    """
    streams: dict[int, dict] = {}
    at, size = 0, len(media)
    while at < size:
        if at + 27 > size:
            raise OggError("a page header is cut off")
        magic, version, kind, granule, serial, sequence, crc, count = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page starts here")
        table = media[at + 27 : at + 27 + count]
        start = at + 27 + count
        stop = start + sum(table)
        if len(table) < count or stop > size:
            raise OggError("a page is cut off")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            raise OggError("the checksum of a page is wrong")
        if kind & FIRST:
            if serial in streams:
                raise OggError("a stream starts twice")
            streams[serial] = {"packets": [], "open": None, "next": sequence, "last": False}
        if (stream := streams.get(serial)) is None or stream["last"]:
            raise OggError("a page is outside its stream")
        if sequence != stream["next"]:
            raise OggError("a page is missing")
        if bool(kind & CONTINUED) != (stream["open"] is not None):
            raise OggError("a packet's parts don't meet")
        stream["next"] += 1
        stream["last"] = bool(kind & LAST)
        parts, begin, here, ended = stream["open"] or [], start, start, []
        for value in table:
            here += value
            if value < 255:
                parts.append(media[begin:here])
                ended.append(b"".join(parts) if len(parts) > 1 else parts[0])
                parts, begin = [], here
        if table and table[-1] == 255:
            parts.append(media[begin:here])
            stream["open"] = parts
        elif table:
            stream["open"] = None
        if ended:
            stream["packets"] += [(x, None) for x in ended[:-1]] + [(ended[-1], granule)]
        at = stop
    for stream in streams.values():
        if stream["open"] is not None or not stream["last"]:
            raise OggError("a stream has no end")
    return {serial: s["packets"] for serial, s in streams.items()}


def read(media: bytes) -> tuple[bytes, dict]:
    """The samples and what is known of their timing. The index stream must agree with them."""
    streams = demux(media)
    samples = index = None
    for packets in streams.values():
        if packets and packets[0][0].startswith(b"PCM     "):
            samples = packets
        elif packets and packets[0][0].startswith(b"INDEX"):
            index = packets
    if samples is None:
        raise OggError("no stream of samples")
    _, _, _, form, rate, bits, channels, _, _ = _PCM.unpack(samples[0][0])
    if (form, bits, channels) != (1, 8, 1) or not rate:
        raise OggError("the samples have another form")
    blocks = [p for p, _ in samples[1:]]
    payload = b"".join(blocks)
    end = samples[-1][1] if len(samples) > 1 else 0
    if end != len(payload):
        raise OggError("the last granule position isn't the number of samples")
    at = 0
    times = []  # start of each packet in samples, worked out from the granules of page ends
    for block, granule in samples[1:]:
        times.append(at)
        at += len(block)
        if granule is not None and granule != at:
            raise OggError("a granule position is wrong")
    if index is not None:
        said = [_INDEX.unpack(p) for p, _ in index[1:]]
        if said != [(t, len(b), zlib.crc32(b)) for t, b in zip(times, blocks)]:
            raise OggError("the index disagrees with the samples")
    return payload, {"rate": rate, "n_packets": len(blocks), "n_streams": len(streams), "duration_ms": end * 1000 // rate}


def features(payload: bytes, info: dict) -> str:
    """Mean, power, zero crossings and peak of the samples, as text; integers only, so exact."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return (
        f"rate={info['rate']};ms={info['duration_ms']};packets={info['n_packets']};streams={info['n_streams']};"
        f"sum={int(x.sum())};power={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"
    )


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8, null: 0) and media: the padded text as samples in an Ogg container."""
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                raw = [b"" if x is None else x for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())],
                    [id_col, "n_bytes", "media"],
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def inspect(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", payload: bool = False) -> DataFrame:
    """Read containers: id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, duration_ms, n_packets, n_streams, error; payload too, if asked for."""
    rows = pick(df, id=id_col, media=media_col)
    kind = rows.schema["id"].dataType.simpleString()
    fields = [("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("duration_ms", "bigint", pa.int64()), ("n_packets", "bigint", pa.int64()), ("n_streams", "bigint", pa.int64()), ("error", "string", pa.string())] + [("payload", "binary", pa.binary())] * payload

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 9 + ("no container",) + (None,) * payload
        try:
            raw, info = read(media)
        except (OggError, struct.error) as e:
            return (None,) * 9 + (str(e),) + (None,) * payload
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(raw, info), info["duration_ms"], info["n_packets"], info["n_streams"], None) + ((raw,) if payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = list(zip(*map(one, part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, t) for x, (_, _, t) in zip(found, fields))], [id_col, *(n for n, _, _ in fields)]
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``store`` and ``inspect`` in one pass: the containers are read back but not returned."""
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    fields = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("duration_ms", "bigint", pa.int64())]

    def one(text: bytes | None) -> tuple:
        media = mux(pad(text or b""))
        raw, info = read(media)
        return len(text or b""), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(raw, info), info["duration_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = list(zip(*map(one, part.column(1).cast(pa.binary()).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, t) for x, (_, _, t) in zip(found, fields))], [id_col, *(n for n, _, _ in fields)]
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))
