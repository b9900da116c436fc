import base64
import hashlib
import random

import pytest

from ensemblage.llm import warc

PAGES = [
    (3, "http://www.Example.org/b?x=1", "<p>same</p>"),
    (1, "https://example.org/a", "<p>same</p>"),
    (2, "http://other.net/", None),
    (4, "http://other.net/", ""),
    (5, None, "ünï\r\n\r\n😀"),
    (6, "http://[bad", "<p>x</p>" * 50000),
    (7, "http://other.net/ space", "<p>same</p>"),
    (8, "http://other.net/a", "Content-Length: 3\r\n\r\nWARC/1.1"),
    (8, "http://other.net/a", "Content-Length: 3\r\n\r\nWARC/1.1"),
    (None, "http://other.net/z", "<p>none</p>"),
]


def brute(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, url, html in pages:
        raw = (html or "").encode()
        origin = first.get(html or "")
        refers = origin if origin is not None and i is not None and origin != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("coarse", [1024, 2, 1])
def test_round_trip(spark, monkeypatch, coarse):
    monkeypatch.setattr(warc, "COARSE", coarse)
    monkeypatch.setattr(warc, "OVERSAMPLE", 2)
    df = spark.createDataFrame([(*p, 0, "y") for p in PAGES], "page_id long, url string, html string, size int, ts string").repartition(3)
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 3)
    history = warc.capture_history(df)
    rows = history.collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == brute(PAGES)
    placed = [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in sorted(rows, key=lambda r: (r.key_range, r.place))]
    assert placed == sorted(placed)
    assert len({r.key_range for r in rows}) > 1
    assert sorted(r.position for r in warc.history_order(history).collect()) == list(range(len(PAGES)))


def test_ranges_hold_what_they_should_however_many(spark, monkeypatch):
    pages = [(i, f"http://h{i % 37}.org/{i}", f"<p>{i // 2}</p>") for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 30)
    monkeypatch.setattr(warc, "COARSE", 4)
    rows = warc.capture_history(df).collect()
    placed = [(r.urlkey, r.ts, r.page_id) for r in sorted(rows, key=lambda r: (r.key_range, r.place))]
    assert len(placed) == 3000 and placed == sorted(placed)
    sizes = {}
    for r in rows:
        sizes[r.key_range] = sizes.get(r.key_range, 0) + 1
    assert len(sizes) > 50 and max(sizes.values()) < 200


def test_passes_of_bounded_fan_in_and_both_joins(spark, monkeypatch):
    pages = [(i, f"http://h{i % 11}.org/{i * 7 % 100}", f"<p>{i // 3}</p>") for i in range(600)] + [(None, None, None), (5, "http://h5.org/x", "<p>1</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 100)
    want = warc.capture_history(df).collect()
    monkeypatch.setattr(warc, "FAN_IN", 4)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = warc.capture_history(df).collect()
    columns = ("page_id", "payload_digest", "record_type", "refers_to", "urlkey", "ts")
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r[c] for c in columns) for r in want), key=repr)
    placed = [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in sorted(rows, key=lambda r: (r.key_range, r.place))]
    assert placed == sorted(placed)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_history(df).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(30))) for i in range(k)]
    merged = [x[1] for x in warc.LoserTree([[(v[0], v) for v in r] for r in runs])]
    assert merged == sorted(x for r in runs for x in r)


def test_damage_is_seen():
    data = warc.record(1, "http://a/", b"abc", warc.digest_of(b"abc"), None)
    assert len(list(warc.parse(data * 2))) == 2
    with pytest.raises(ValueError):
        list(warc.parse(data.replace(b"abc", b"abd")))
