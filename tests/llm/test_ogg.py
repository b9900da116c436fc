import hashlib
import random
import struct
import zlib

import pytest

from ensemblage.llm import ogg

rng = random.Random(4)
RAW = [b"", b"a", b"\xff" * 576, bytes(rng.randrange(256) for _ in range(577)), bytes(rng.randrange(256) for _ in range(200_000))]


@pytest.mark.parametrize("raw", RAW, ids=len)
@pytest.mark.parametrize("packet", [255, 510, 576])
def test_round_trip(raw, packet):
    media = ogg.encode(raw, packet)
    s = ogg.read(media)
    assert s.payload == ogg.pad(raw, packet) and s.length == len(raw) and s.cues_ok
    assert s.duration == len(raw) / ogg.RATE


def test_checksum_bit_by_bit():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for raw in RAW[:4]:
        assert ogg.page_crc(raw) == slow(raw)


def test_times_grow_and_streams_are_apart():
    found = ogg.demux(ogg.encode(RAW[4]))
    assert set(found.streams) == {ogg.SAMPLES, ogg.CUES} and not found.bad_pages and not found.skipped_bytes
    times = found.streams[ogg.SAMPLES].timestamps(ogg.RATE)
    assert times == sorted(times) and times[-1] == len(RAW[4]) / ogg.RATE


def test_damage_is_found_and_passed_over():
    media = bytearray(ogg.encode(RAW[4]))
    media[len(media) // 2] ^= 1
    found = ogg.demux(bytes(media))
    assert found.bad_pages >= 1 and found.streams[ogg.SAMPLES].lost_pages + found.streams[ogg.CUES].lost_pages == 1
    with pytest.raises(ValueError):
        ogg.read(bytes(media))
    whole = ogg.demux(b"junk" + ogg.encode(b"abc"))
    assert whole.skipped_bytes == 4 and whole.streams[ogg.SAMPLES].packets[1] == ogg.pad(b"abc")


def test_packets_over_pages():
    stream, out = ogg._Stream(9), []
    packet = bytes(rng.randrange(256) for _ in range(150_000))
    stream.add(packet, 5, out)
    stream.add(b"", 6, out)
    stream.flush(out, last=True)
    assert len(out) > 2
    found = ogg.demux(b"".join(out)).streams[9]
    assert found.packets == [packet, b""] and found.ended
    lost = ogg.demux(b"".join(out[:1] + out[2:])).streams[9]
    assert lost.packets == [b""] and lost.lost_pages == 1


TEXTS = [(1, "héllo 😀"), (2, None), (3, ""), (4, "héllo 😀"), (None, "x" * 100_000), (1, "again")]


def test_query(spark):
    df = spark.createDataFrame([(*t, b"m", 1) for t in TEXTS], "doc_id long, text string, media binary, n_bytes int")
    rows = ogg.media_features(df).collect()
    assert len(rows) == len(TEXTS)
    for r, (i, t) in zip(rows, TEXTS):
        raw = (t or "").encode()
        payload = ogg.pad(raw)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(ogg.encode(raw)).hexdigest() and r.media_bytes > r.payload_bytes
    assert rows[0][1:] == rows[3][1:]
    bad = spark.createDataFrame([(b"nothing",), (None,), (ogg.encode(b"x")[:50],)], "media binary")
    assert all(r.read.error and r.read.n_bytes is None for r in ogg.read_media(bad).collect())
    assert ogg.media_features(df.limit(0)).count() == 0
    assert struct.calcsize("<8sHHI") == 16
