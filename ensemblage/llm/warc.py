"""WARC archives with an external index merge.

Pages become WARC/1.1 records: the first capture of a payload is a ``response``,
later equal payloads are ``revisit`` records that name it.  Archives are binary rows
of a Parquet table in the shared scratch folder, so that any store that Spark writes
to will do; each holds about ``ARCHIVE_BYTES`` of records and is read back by parsing.

Every archive's index is a run sorted by (URL key, timestamp, page id).  Splitters cut
all runs at the same keys; the segments of one key range meet in one task and a loser
tree merges them k ways.  Where a range has segments of more than ``FAN_IN`` archives, they
are merged in two passes, so that no tree has many more ways than that.  Ranges in their order are the globally ordered capture history.
Splitters have two levels: at most ``COARSE`` keys, which go to every task, cut the key
space into stretches, and each stretch is cut by splitters of its own, which only its
segments meet.  So a range holds some ``RANGE_ENTRIES`` entries however large the table.
Splitters are samples by a hash; they steer only how evenly ranges are cut, and every
entry is merged.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARCHIVE_BYTES = 4 << 20
#: Coarse splitters: the bound of what reaches the driver is ``OVERSAMPLE`` times that.
COARSE = 1024
#: Sampled keys for each splitter.
OVERSAMPLE = 8
#: Index entries a range should hold.
RANGE_ENTRIES = 20_000
#: Runs that one loser tree merges, about.
FAN_IN = 128
#: Digests that occur again and are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
EPOCH = 1_700_000_000  # capture time of page 0; pages follow by a second each

ENTRY = "urlkey string, ts string, page_id long, archive string, offset long, size long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def timestamp(page_id: int | None) -> datetime:
    return datetime.fromtimestamp(EPOCH + (page_id or 0) % (1 << 32), UTC)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has headers only, as its profile allows."""
    uri = re.sub(r"[\s<>]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {timestamp(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(2, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, size, headers, block) of each record; ValueError if damaged."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n" or f"sha1:{digest_of(block)}" != headers["warc-block-digest"]:
            raise ValueError(f"damaged record at byte {at}")
        yield at, end + 8 + size - at, headers, block
        at = end + 8 + size


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def index_entry(archive: str, offset: int, size: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("payload differs from its digest")
    ts = re.sub(r"\D", "", headers["warc-date"])
    return (url_key(headers["warc-target-uri"]), ts, _page(headers["warc-record-id"]), archive, offset, size, length, digest, kind, _page(headers.get("warc-refers-to")))


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each step
    replays one path of log2(k) matches.  Ties go to the earlier run."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(k, 1)
        self.winner = self._play(1) if k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _key(entry: tuple) -> tuple:
    page = entry[2]
    return (entry[0], entry[1], page is not None, page or 0, entry[3], entry[4])


def with_origin(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, payload, digest and ``refers_to``: the smallest page_id of the
    same payload where that is another row, for payloads of ``smallest`` bytes or more.

    Digests are grouped, not payloads.  Those that occur again are written once and
    sent to all tasks while they are few, so that payloads stay where they are; beyond
    that they are joined, and adaptive execution splits what is common.
    """
    df = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    df = df.withColumn("sha1", F.sha1("payload"))
    first = df.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Only digests seen twice come here; a row without a copy keeps its own id.
    first = materialize(first, "warc-first")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    return df.join(first, "sha1", "left").select(
        "page_id", "url", "payload", "sha1", F.when((F.octet_length("payload") >= smallest) & (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Table (archive string, warc binary): records in the order of their rows.

    Null urls become ``urn:none``, null html the empty payload.  A repeated page_id
    with equal html gives two responses, as neither is another page's copy.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer, size = [], 0
        names: list[tuple[str, bytes]] = []

        def close():
            nonlocal buffer, size
            body = b"".join(buffer)
            names.append((hashlib.sha256(body).hexdigest()[:24], body))
            buffer, size = [], 0

        for pdf in batches:
            for page, url, payload, sha1, origin in pdf.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                data = record(page, url, bytes(payload), base64.b32encode(bytes.fromhex(sha1)).decode(), None if pd.isna(origin) else int(origin))
                buffer.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
            if names:
                yield pd.DataFrame(names, columns=["archive", "warc"])
                names.clear()
        if buffer:
            close()
            yield pd.DataFrame(names, columns=["archive", "warc"])

    packed = with_origin(pages, smallest).mapInPandas(pack, "archive string, warc binary")
    return materialize(packed, "warc")


def read_runs(archives: DataFrame) -> DataFrame:
    """Parse each archive: one row (archive, entries) with its sorted index run."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, warc in pdf.itertuples(index=False):
                entries = sorted((index_entry(name, *r) for r in parse(bytes(warc))), key=_key)
                yield pd.DataFrame({"archive": [name], "entries": [[dict(zip(_FIELDS, e)) for e in entries]]})

    kind = ENTRY.replace(", ", ",").replace(" ", ":")
    return archives.mapInPandas(runs, f"archive string, entries array<struct<{kind}>>")


def _sampled(runs: DataFrame, keys: int, total: int) -> DataFrame:
    """About ``keys`` of all entries by a hash, as rows of ``_KEY``; all if they are few."""
    rows = runs.select(F.explode("entries").alias("e")).select("e.urlkey", "e.ts", "e.page_id", "e.archive", "e.offset")
    share = min(1.0, keys / max(total, 1))
    return rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def _place(row) -> tuple:
    """The key of a sampled entry, ordered like ``_key``."""
    page = None if pd.isna(row[2]) else int(row[2])
    return (row[0], row[1], page is not None, page or 0, row[3], int(row[4]))


def _even(keys: list[tuple], ranges: int) -> list[tuple]:
    keys = sorted(keys)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries with ``key_range`` and ``place``: ordered by (key_range, place)
    they are the capture history in (URL key, timestamp, page id) order."""
    runs = materialize(runs, "runs")
    total = runs.agg(F.sum(F.size("entries"))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_ENTRIES))
    coarse = min(ranges, COARSE)
    # Ranges within a stretch; its number times ``stride`` is that of its first one.
    within = -(-ranges // coarse)
    stride = 4 * within if within > 1 else 1
    cuts = _even([_place(r) for r in _sampled(runs, coarse * OVERSAMPLE, total).collect()], coarse) if coarse > 1 else []
    kind = ENTRY.replace(", ", ",").replace(" ", ":")

    def rows_of(entries) -> list[tuple]:
        return [tuple(e[f] for f in _FIELDS) for e in entries]

    def cut_at(rows: list[tuple], splitters: list[tuple], first: int, name: str) -> list[tuple]:
        edges = [0, *(bisect.bisect_left(rows, c, key=_key) for c in splitters), len(rows)]
        return [(first + i, name, [dict(zip(_FIELDS, r)) for r in rows[a:b]]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, entries in pdf.itertuples(index=False):
                yield pd.DataFrame(cut_at(rows_of(entries), cuts, 0, name), columns=["key_range", "archive", "segment"])

    cut = runs.select("archive", "entries").mapInPandas(segments, f"key_range long, archive string, segment array<struct<{kind}>>")
    if within > 1:
        # A stretch's own splitters: at most ``stride`` - 1 of some OVERSAMPLE times as many.
        def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(key_range=[bisect.bisect_right(cuts, _place(r)) for r in pdf.itertuples(index=False)])

        def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            keys = [_place(r) for r in pdf[["urlkey", "ts", "page_id", "archive", "offset"]].itertuples(index=False)]
            found = _even(keys, min(stride, max(1, len(keys) // OVERSAMPLE)))
            return pd.DataFrame({"key_range": [key[0]], "splitters": [[(u, t, p if known else None, a, o) for u, t, known, p, a, o in found]]})

        key = "urlkey string, ts string, page_id long, archive string, offset long"
        sample = _sampled(runs, ranges * OVERSAMPLE, total).mapInPandas(stretch, key + ", key_range long")
        fine = sample.groupBy("key_range").applyInPandas(split, f"key_range long, splitters array<struct<{key.replace(', ', ',').replace(' ', ':')}>>")

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for first, name, segment, splitters in pdf[["key_range", "archive", "segment", "splitters"]].itertuples(index=False):
                    own = [_place(tuple(x[f] for f in ("urlkey", "ts", "page_id", "archive", "offset"))) for x in (splitters if splitters is not None else [])]
                    yield pd.DataFrame(cut_at(rows_of(segment), own, first * stride, name), columns=["key_range", "archive", "segment"])

        cut = materialize(cut, "segments").join(fine, "key_range", "left").mapInPandas(again, f"key_range long, archive string, segment array<struct<{kind}>>")

    def merged_rows(segments) -> Iterator[tuple]:
        return (row for _, row in LoserTree([[(_key(r), r) for r in rows_of(segment)] for segment in segments]))

    def premerge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(zip(_FIELDS, row)) for row in merged_rows(pdf["segment"])]
        return pd.DataFrame({"key_range": [key[0]], "archive": [f"{key[1]:06d}"], "segment": [rows]})

    # A range's segments are at most its entries, or the archives.
    groups = -(-min(runs.count(), 2 * RANGE_ENTRIES) // FAN_IN)
    if groups > 1:
        group = F.pmod(F.xxhash64("archive"), F.lit(groups)).alias("group")
        cut = cut.groupBy("key_range", group).applyInPandas(premerge, f"key_range long, archive string, segment array<struct<{kind}>>")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = [(key[0], place, *row) for place, row in enumerate(merged_rows(pdf.sort_values("archive", kind="stable")["segment"]))]
        out = pd.DataFrame(merged, columns=["key_range", "place", *_FIELDS])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return cut.groupBy("key_range").applyInPandas(merge, f"key_range long, place int, {ENTRY}")


def capture_history(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write pages as WARC, read the archives back and merge their indexes.

    One row a page: index fields, ``key_range`` and ``place``.  Empty tables give an
    empty history; null ids are kept and sort first; repeated rows are kept.
    """
    return merge_runs(read_runs(write_archives(pages, smallest)))


def history_order(history: DataFrame) -> DataFrame:
    """The history with its global 0-based position, by counts of ranges."""
    sizes = history.groupBy("key_range").agg(F.count("*").alias("n"))
    w = Window.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("key_range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return history.join(before, "key_range").withColumn("position", F.col("before") + F.col("place")).drop("before")
