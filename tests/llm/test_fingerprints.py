import hashlib
import random
import struct

import xxhash

from ensemblage.llm import fingerprints as fp

rng = random.Random(5)
WORDS = ["alpha", "béta", "gamma😀", "delta", "the", "of"]
TEXTS = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([1, 3, 40, 200, 2, 0, 90, 5, 60, 33] * 3)]
TEXTS += [(900, None), (None, "no id at all but text enough for anchors"), (7, TEXTS[7][1]), (901, TEXTS[3][1])]


def tokens_of(text):
    """Character by character: a token ends after one of the ending characters, at the
    end of a word, or after eight others; white space goes with what is before it."""
    ends = lambda c: c in "aeoAEO0369" or ord(c) >= 0x2E80
    out, plain = [], 0
    for k, c in enumerate(text):
        white = c in " \t\n\x0b\x0c\r"
        before = text[k - 1] if k else ""
        if not out:
            new = True
        elif white:
            new = False
        else:
            new = before in " \t\n\x0b\x0c\r" or ends(before) or plain == 8
        if new:
            out.append("")
            plain = 0
        out[-1] += c
        plain += not white and not ends(c)
    return out


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        yield i, t, t[: len(t) - q] + nxt[:q], nxt


def hashed(data, seed=42):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(data, seed=seed).intdigest()))[0]


def hashed_longs(*values):
    seed = 42
    for v in values:
        seed = hashed(struct.pack("<q", v), seed % 2**64)
    return seed


def brute_sketch(text):
    """Smallest anchor hashes in Python: k-mers whose least s-mer hash is at an edge."""
    tokens = tokens_of(text)
    h = [hashed(t.encode()) for t in tokens]
    s_mers = [hashed_longs(*h[i : i + fp.S]) for i in range(len(h) - fp.S + 1)]
    w = fp.K - fp.S + 1
    found = {hashed_longs(x[0], x[2], x[3]) % 2**64 >> 16 for x in (s_mers[i : i + w] for i in range(len(h) - fp.K + 1)) if min(x) in (x[0], x[-1])}
    return sorted(found or {hashed(text.encode()) % 2**64 >> 16})[: fp.SKETCH]


def test_fingerprints_match_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    got = sorted(fp.fingerprints(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    want = sorted(edited(TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[2].encode()).hexdigest()))

    def near(a, b):
        u = sorted(set(a) | set(b))[: fp.SKETCH]
        return len(set(u) & set(a) & set(b)) / len(u)

    for g, (_, own, new, nxt) in zip(got, want):
        a, b, c = map(brute_sketch, (own, new, nxt))
        assert g.fingerprint == "".join(f"{x:012x}" for x in a) and g.edited_fingerprint == "".join(f"{x:012x}" for x in b)
        assert (g.near_edited, g.near_next) == (near(a, b), near(a, c))


def test_edited_texts_and_composed_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 5)
    df = spark.createDataFrame([(*t, 3) for t in TEXTS], "doc_id long, text string, n_chars int")
    got = sorted(fp.fingerprints(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    want = sorted(edited(TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[2].encode()).hexdigest()))
    # The whole-text fingerprints of own, edited and next texts, computed directly.
    texts = sorted({x for w in want for x in w[1:]})
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fp.text_sketch(fp.F.col("text")).alias("s"))
    direct = {r.text: (r.f, r.s) for r in frame.select("text", "s", fp.fingerprint(fp.F.col("s")).alias("f")).collect()}

    def near(a, b):
        u = sorted(set(a) | set(b))[: fp.SKETCH]
        return len(set(u) & set(a) & set(b)) / len(u)

    assert len(got) == len(want)
    for g, (i, own, new, nxt) in zip(got, want):
        assert (g.doc_id, g.n_chars) == (i, len(own))
        assert g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert g.fingerprint == direct[own][0] and g.edited_fingerprint == direct[new][0]
        assert g.near_edited == near(direct[own][1], direct[new][1])
        assert g.near_next == near(direct[own][1], direct[nxt][1])


def test_anchors_are_closed_syncmers(spark):
    text = TEXTS[3][1]
    col = fp.F.col
    rows = spark.createDataFrame([(text,)], "text string")
    tokens = tokens_of(text)
    assert "".join(tokens) == text
    h = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").orderBy("i").select(fp.F.xxhash64("t")).collect()]
    m = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:]))], "i int, a long, b long").orderBy("i").select(fp.F.xxhash64("a", "b")).collect()]
    w = fp.K - fp.S + 1
    want = [i for i in range(len(tokens) - fp.K + 1) if min(m[i : i + w]) in (m[i], m[i + w - 1])]
    assert [a.pos for a in rows.select(fp.anchors(col("text")).alias("a")).first().a] == want


def test_align_finds_the_offset(spark):
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    left = spark.createDataFrame([(1, "xyz " * 20 + shared)], "pair int, text string")
    right = spark.createDataFrame([(1, shared + " uvw" * 20)], "pair int, text string")
    row = fp.align(left, right).first()
    assert row.offset == -20 and row.start >= 20 and row.end <= 20 + len(tokens_of(shared)) and row.anchors > 30


def test_an_insertion_moves_few_anchors(spark):
    """Also in a text without spaces."""
    runs = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000)), "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(1000))]
    for run in runs:
        rows = [(run,), (run[:100] + "x" + run[100:],)]
        a, b = (set(r.h) for r in spark.createDataFrame(rows, "text string").select(fp.F.transform(fp.anchors(fp.F.col("text")), lambda a: a["hash"]).alias("h")).collect())
        assert len(a & b) >= 0.97 * len(a | b)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "one text only, quite short but long enough")], "doc_id long, text string")
    assert fp.fingerprints(df).first().near_next == 1.0
    assert fp.fingerprints(df.limit(0)).count() == 0
