import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidevec.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        data = rng.randbytes(n)
        assert ogg.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 65_088, 70_016, 1_000_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.mux(payload)
    got, info = ogg.read(media)
    assert got == payload and info["n_packets"] == -(-n // 4096) and info["duration_ms"] == n * 1000 // 8000 and info["n_streams"] == 2
    assert ogg.mux(payload) == media


def test_packets_over_page_borders():
    packets = [(b"a" * n, n) for n in (0, 1, 254, 255, 256, 510, 255 * 255, 255 * 255 + 3, 200_000, 0)]
    media = b"".join(ogg.pages(7, packets, 0, ogg.FIRST | ogg.LAST))
    assert [p for p, _ in ogg.demux(media)[7]] == [p for p, _ in packets]


def test_damage_is_found():
    media = ogg.mux(bytes(range(256)) * 40)
    for at in range(0, len(media), 97):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read(bytes(bad))
    for bad in (media[:-1], media[1:], media + b"x", media + media):
        with pytest.raises(ogg.OggError):
            ogg.read(bad)


def test_missing_page_and_interleaving():
    one = list(ogg.pages(1, [(b"x" * 70_000, 1), (b"y", 2)], 0, ogg.FIRST | ogg.LAST))
    two = list(ogg.pages(2, [(b"z" * 300, 5)], 0, ogg.FIRST | ogg.LAST))
    found = ogg.demux(one[0] + two[0] + b"".join(one[1:]))
    assert {k: [len(p) for p, _ in v] for k, v in found.items()} == {1: [70_000, 1], 2: [300]}
    with pytest.raises(ogg.OggError):
        ogg.demux(one[0] + b"".join(one[2:]))


def test_columns(spark):
    rows = [(1, "text"), (2, None), (3, ""), (None, "é" * 3000), (1, "text"), (4, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    stored = ogg.store(df)
    read = {(r.doc_id): r for r in ogg.inspect(stored, payload=True).collect()}
    whole = {(r.doc_id): r for r in ogg.round_trip(df).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert bytes(read[i].payload) == padded and read[i].error is None
        assert whole[i].n_bytes == len(raw) and whole[i].payload_bytes == len(padded) and whole[i].tail_crc32 == zlib.crc32(padded[-64:])
        assert whole[i].media_sha256 == read[i].media_sha256 and whole[i].feature == read[i].feature
    broken = ogg.inspect(spark.createDataFrame([(1, b"OggS"), (2, None)], "doc_id long, media binary")).collect()
    assert all(r.error and r.payload_sha256 is None for r in broken)
    assert struct.calcsize("<4sBBqIIIB") == 27
