import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from ensemblage.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def numbers(doc_id):
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(x[8 * k : 8 * k + 8], 16) for k in range(4))


def brute(doc_id, text):
    text, (h1, h2, h3, h4) = text or "", numbers(doc_id)
    units = UNIT.findall(text)
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return (doc_id, n, form, len(a), len(b), sha(out), sha(text))


def texts(seed, count):
    rng = random.Random(seed)
    parts = ["a", "é", "😀", " ", "  ", "\n", "\x0b", "<", "P", "S", "M", ">", "<P", "word", "\x1c", " "]
    out = [None, "", " ", "\n \t", "x", " x", "x ", "<P>", "<<P>", "a<M> b", "< P>", "<S", "P>"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 9, 40, 300]))) for _ in range(count)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_compose_to_the_whole(size):
    for text in texts(1, 200):
        data = np.frombuffer((text or "").encode(), np.uint8)
        whole = fim.IDENTITY
        for part in fim.chunks_of(data, size):
            whole = fim.compose(whole, fim.scan(part))
        assert whole == fim.scan(data)
        assert whole.chars == len(text or "")
        assert whole.markers[0] == sum((text or "").count(m) for m in fim.MARKERS)
        units = UNIT.findall(text or "")
        found, at = fim.cut_text(data, (3, 5, 0, 0), size)
        assert found.n == len(units)
        if found.form != "plain":
            assert at == tuple(len("".join(units[:k]).encode()) for k in found.cuts)


def test_composition_is_associative():
    parts = [fim.scan(np.frombuffer(t.encode(), np.uint8)) for t in texts(2, 60) if t]
    for f, g, h in zip(parts, parts[1:], parts[2:]):
        assert fim.compose(fim.compose(f, g), h) == fim.compose(f, fim.compose(g, h))


@pytest.mark.parametrize("chunk,giant", [(fim.CHUNK_BYTES, fim.GIANT_BYTES), (5, 20), (16, 0)])
def test_matches_brute_force(spark, chunk, giant):
    rows = [(k, t) for k, t in enumerate(texts(3, 250))]
    rows += [(None, "no id at all"), (7, rows[40][1]), (40, rows[40][1]), (40, rows[40][1]), (900, "long é " * 30_000), (901, "w" * 200_000), (902, " " * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n int, h string")
    out = fim.transform(df, chunk=chunk, giant=giant)
    assert out.columns == ["row", "fim"] and out.select("row.*").columns == df.columns
    got = [r for r in out.select("row.doc_id", "row.text", "fim.*", fim.restored(out["fim.output"], out["fim.form"]).alias("back")).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.back)) for r in got), key=repr) == sorted((brute(i, t) for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.report(df).collect() == []


def test_report_matches_sql(spark):
    got = fim.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(fim.oracle())
    assert set(want.columns) == set(got.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
