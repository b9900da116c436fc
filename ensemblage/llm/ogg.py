"""Media columns: Ogg (RFC 3533) pages as a lossless container of 8-bit samples.

``encode`` multiplexes two logical streams: 8-bit samples in packets of 576
bytes, and a cue stream with the CRC-32 of every block of packets.  ``demux``
verifies page checksums (resynchronising at the next capture pattern), joins
packets from lacing values across pages, separates the streams by serial number
and derives timestamps from granule positions.  The granule position of the last
sample page is the number of samples without padding, as end trimming asks.

The work is row by row, needs no shuffle, and a lost executor only repeats its
own rows.  Python is used because page parsing follows data-dependent offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET = 576
RATE = 8000
SAMPLES, CUES = 1, 2
_CUE_EVERY = 64
#: Whole packets put into one page at most: each takes three lacing values.
_PACKETS_A_PAGE = 84

# Ogg's CRC has the polynomial 0x04C11DB7, most significant bit first, from 0.
# zlib's CRC-32 has the same polynomial, least significant bit first, so bytes
# with reversed bits give Ogg's value with its bits reversed.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero."""
    value = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, granule: int, lacing: bytes, body: bytes, kind: int) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class _Stream:
    """Collects packets of one logical stream and cuts them into pages."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0
        self.lacing, self.body, self.granule, self.open = bytearray(), bytearray(), -1, False

    def add(self, packet: bytes, granule: int, out: list[bytes]) -> None:
        values, at = _lacing(len(packet)), 0
        for i, v in enumerate(values):
            if len(self.lacing) == 255:
                self.flush(out, continued=i > 0)
            self.lacing.append(v)
            self.body += packet[at : at + v]
            at += v
        self.granule = granule

    def flush(self, out: list[bytes], continued: bool = False, last: bool = False) -> None:
        kind = (1 if self.open else 0) | (2 if self.sequence == 0 else 0) | (4 if last else 0)
        out.append(_page(self.serial, self.sequence, self.granule, bytes(self.lacing), bytes(self.body), kind))
        self.sequence += 1
        self.lacing, self.body, self.granule, self.open = bytearray(), bytearray(), -1, continued


def pad(raw: bytes, packet: int = PACKET) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of ``packet``."""
    return raw + b"\xff" * (max(1, -(-len(raw) // packet)) * packet - len(raw))


def encode(raw: bytes, packet: int = PACKET, rate: int = RATE) -> bytes:
    """The payload of ``raw`` as an Ogg file with a sample and a cue stream."""
    payload = pad(raw, packet)
    out: list[bytes] = []
    samples, cues = _Stream(SAMPLES), _Stream(CUES)
    samples.add(struct.pack("<8sHHI", b"PCM8    ", 1, packet, rate), 0, out)
    samples.flush(out)
    cues.add(struct.pack("<8sI", b"CUES    ", _CUE_EVERY), 0, out)
    cues.flush(out)
    total = len(payload) // packet
    crc = 0
    for k in range(total):
        part = payload[k * packet : (k + 1) * packet]
        crc = zlib.crc32(part, crc)
        last = k == total - 1
        samples.add(part, len(raw) if last else (k + 1) * packet, out)
        if (k + 1) % _PACKETS_A_PAGE == 0 and not last:
            samples.flush(out)
        if (k + 1) % _CUE_EVERY == 0 or last:
            cues.add(struct.pack("<I", crc), len(raw) if last else (k + 1) * packet, out)
            cues.flush(out, last=last)
    samples.flush(out, last=True)
    return b"".join(out)


@dataclass
class LogicalStream:
    """One demultiplexed stream: whole packets, and for each page that ends a
    packet its granule position and the count of packets up to there."""

    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    lost_pages: int = 0
    ended: bool = False
    _part: bytearray = field(default_factory=bytearray)
    _next: int | None = None
    _broken: bool = False

    def timestamps(self, rate: int) -> list[float]:
        """Seconds at the end of each packet that a page's granule position dates."""
        return [granule / rate for granule, _ in self.marks]


@dataclass
class Demuxed:
    streams: dict[int, LogicalStream]
    pages: int
    bad_pages: int
    skipped_bytes: int


def demux(media: bytes) -> Demuxed:
    """Read pages; a page with a wrong checksum is skipped and counted, and the
    packets that it would have ended or begun are dropped."""
    streams: dict[int, LogicalStream] = {}
    at = pages = bad = skipped = 0
    size = len(media)
    while at < size:
        if media[at : at + 4] != b"OggS":
            found = media.find(b"OggS", at + 1)
            skipped += (size if found < 0 else found) - at
            if found < 0:
                break
            at = found
            continue
        if at + 27 > size:
            skipped += size - at
            break
        _, version, kind, granule, serial, sequence, crc = struct.unpack_from("<4sBBqIII", media, at)
        count = media[at + 26]
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < count or end > size or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            skipped += 1
            at += 1
            continue
        pages += 1
        stream = streams.setdefault(serial, LogicalStream())
        if stream._next is not None and sequence != stream._next:
            stream.lost_pages += sequence - stream._next
            stream._part, stream._broken = bytearray(), bool(kind & 1)
        elif not kind & 1:
            stream._part, stream._broken = bytearray(), False
        elif stream._next is None:
            stream._broken = True
        stream._next = sequence + 1
        body = at + 27 + count
        done = False
        for v in lacing:
            if not stream._broken:
                stream._part += media[body : body + v]
            body += v
            if v < 255:
                if not stream._broken:
                    stream.packets.append(bytes(stream._part))
                    done = True
                stream._part, stream._broken = bytearray(), False
        if done and granule >= 0:
            stream.marks.append((granule, len(stream.packets)))
        stream.ended |= bool(kind & 4)
        at = end
    return Demuxed(streams, pages, bad, skipped)


@dataclass
class Samples:
    payload: bytes
    length: int
    rate: int
    duration: float
    cues: int
    cues_ok: bool


def read(media: bytes) -> Samples:
    """Payload and times of a file made by ``encode``; ValueError if damaged."""
    found = demux(media)
    samples, cues = found.streams.get(SAMPLES), found.streams.get(CUES)
    if samples is None or not samples.packets or samples.packets[0][:8] != b"PCM8    ":
        raise ValueError("no sample stream")
    _, _, packet, rate = struct.unpack("<8sHHI", samples.packets[0])
    payload = b"".join(samples.packets[1:])
    length = samples.marks[-1][0] if samples.marks else 0
    if found.bad_pages or samples.lost_pages or not samples.ended or length > len(payload):
        raise ValueError("damaged sample stream")
    checks = [struct.unpack("<I", p)[0] for p in cues.packets[1:]] if cues else []
    every = struct.unpack("<8sI", cues.packets[0])[1] if cues else 1
    crc, ok = 0, True
    for i, want in enumerate(checks):
        crc = zlib.crc32(payload[i * every * packet : (i + 1) * every * packet], crc)
        ok &= crc == want
    return Samples(payload, length, rate, samples.timestamps(rate)[-1], len(checks), ok)


def features(s: Samples) -> str:
    """Duration, mean, root mean square about the mean, zero crossings a sample
    and the median energy of 576-sample frames, of the samples without padding."""
    x = np.frombuffer(s.payload[: s.length], np.uint8).astype(np.float64)
    if not len(x):
        return f"sec=0;mean=0;rms=0;zcr=0;frame=0;cues={s.cues}"
    c = x - 128.0
    mean = c.mean()
    rms = float(np.sqrt(((c - mean) ** 2).mean()))
    zcr = float(((c[1:] - mean) * (c[:-1] - mean) < 0).mean()) if len(c) > 1 else 0.0
    full = len(c) // PACKET * PACKET
    frame = float(np.median((c[:full].reshape(-1, PACKET) ** 2).mean(1))) if full else float((c**2).mean())
    return f"sec={s.duration:.6f};mean={mean:.4f};rms={rms:.4f};zcr={zcr:.4f};frame={frame:.2f};cues={s.cues}"


_READ = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(T.BinaryType())
def _encode_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: encode((t or "").encode("utf-8")))


@F.pandas_udf(_READ)
def _read_udf(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        m = bytes(m or b"")
        digest = hashlib.sha256(m).hexdigest()
        try:
            s = read(m)
        except (ValueError, struct.error) as e:
            rows.append((None, None, None, None, len(m), digest, None, str(e)))
            continue
        error = None if s.cues_ok else "cue checksums differ"
        tail = zlib.crc32(s.payload[-32:])
        rows.append((s.length, len(s.payload), hashlib.sha256(s.payload).hexdigest(), tail, len(m), digest, features(s), error))
    return pd.DataFrame(rows, columns=_READ.names).astype({k: "Int64" for k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})


def add_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Append the Ogg bytes of ``text`` (null: empty) as column ``media``."""
    return df.withColumn(media, _encode_udf(F.coalesce(F.col(text), F.lit(""))))


def read_media(df: DataFrame, media: str = "media", into: str = "read") -> DataFrame:
    """Append a struct read back from Ogg bytes: lengths, digests, features and
    ``error`` (null for a whole file; null or damaged bytes give an error and
    null contents, never an exception)."""
    return df.withColumn(into, _read_udf(F.col(media)))


def media_features(documents: DataFrame) -> DataFrame:
    """Each document's text stored as Ogg, read back and described.

    Nulls and empty texts give one packet of padding; repeated rows are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    df = read_media(add_media(documents.select("doc_id", "text")))
    names = [f.name for f in _READ if f.name != "error"]
    return df.select("doc_id", *[F.col(f"read.{n}").alias(n) for n in names])
