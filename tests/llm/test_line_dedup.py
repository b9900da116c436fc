import hashlib
import itertools
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ensemblage.llm import line_dedup

PASSAGE = "\n".join(f"shared line number {i} of the passage" for i in range(12))
LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, f"own start\n{PASSAGE}\nown end"),
    (2, f"other start\nmore\n{PASSAGE}\n{LONG}\nother end"),
    (3, f"{LONG}\nlast"),
    (4, PASSAGE),
    (4, PASSAGE),
    (5, f"{PASSAGE}\n{PASSAGE}"),
    (6, None),
    (7, ""),
    (8, "\n\n\n\n"),
    (9, "\n\n\n\n"),
    (10, "a\nb"),
    (11, "x" * 100_000 + "\ny"),
    (None, f"{PASSAGE}\nnull id"),
]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "keep", "mine") for r in rows], "doc_id long, text string, hash string, line_stats string")


def brute(rows):
    """Line by line: gaps by their bytes, anchors by id and place, chunks by following."""
    docs, units = {}, {}
    for doc, text in rows:
        if text is not None:
            at = (2**63 - 1 if doc is None else doc, int(hashlib.md5(text.encode()).hexdigest()[:15], 16))
            lines = text.split("\n")
            worded = [(i, x, len([w for w in re.split("[\x20\x09-\x0d]+", x) if w])) for i, x in enumerate(lines)]
            docs[at] = [w for w in worded if w[2]]
    for at, worded in docs.items():
        for k, a in enumerate(worded):
            if a[2] >= line_dedup.LONG_WORDS:
                units.setdefault((a[1],), []).append((*at, k))
            if k + 1 < len(worded):
                units.setdefault((a[1], worded[k + 1][1]), []).append((*at, k))
    follows = {}
    for bytes_, places in units.items():
        places.sort()
        for n, (doc, key, k) in enumerate(places):
            first = places[0] if doc != places[0][0] else places[n - 1] if n and places[n - 1][:2] == (doc, key) else None
            if first:
                follows.setdefault((doc, key), {}).setdefault((*first[:2], k - first[2]), set()).update(range(k, k + len(bytes_)))
    gone = {}
    for at, chunks in follows.items():
        lost = set()
        for ks in chunks.values():
            for _, run in itertools.groupby(enumerate(sorted(ks)), lambda x: x[1] - x[0]):
                run = [k for _, k in run]
                if sum(docs[at][k][2] for k in run) >= line_dedup.LEAST_WORDS:
                    lost.update(run)
        for _, run in itertools.groupby(enumerate(sorted(lost)), lambda x: x[1] - x[0]):
            run = [docs[at][k][0] for _, k in run]
            gone.setdefault(at, set()).update(range(run[0], run[-1] + 1))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lost = gone.get((2**63 - 1 if doc is None else doc, int(hashlib.md5(text.encode()).hexdigest()[:15], 16)), set())
        lines = text.split("\n")
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in lost), len(lines), len(lost)))
    return out


def by_sql(rows):
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    con.sql("CREATE TABLE t AS SELECT * FROM documents")
    con.sql("CREATE VIEW documents AS SELECT * FROM t")
    return con.sql(line_dedup.oracle()).fetchall()


def corpus(seed):
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(400)) for _ in range(n))
    passages = [[sentence(rng.randrange(9, 30)) for _ in range(rng.randrange(2, 8))] for _ in range(12)]
    common = [sentence(3) for _ in range(4)]
    rows = []
    for k in range(150):
        parts = [rng.choice([[sentence(12)], [rng.choice(common)], [""], rng.choice(passages), [sentence(60)], rng.choice(rows)[1].split("\n")[:5] if rows else [""]]) for _ in range(rng.randrange(1, 7))]
        rows.append((k, "\n".join(x for p in parts for x in p)))
    return rows + [rows[3], (3, rows[3][1] + "\nmore"), (None, rows[5][1])], passages


def test_matches_brute_force_and_sql(spark):
    for rows in (DOCS, corpus(1)[0], corpus(2)[0]):
        got = sorted(map(tuple, line_dedup.report(frame(spark, rows).repartition(3)).collect()), key=repr)
        want = sorted(brute(rows), key=repr)
        assert got == want
        assert sorted(by_sql(rows), key=repr) == want


def test_repeated_passages_go_and_their_text_stays_once(spark):
    rows, passages = corpus(3)
    rows = rows[:150]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    whole = "\n".join(got[k] for k in range(150))
    copies = left = 0
    for p in passages:
        if sum(len(x.split()) for x in p) <= 50:
            continue
        for x in p:
            assert x in whole
            copies += sum(t.split("\n").count(x) for _, t in rows) - 1
            left += sum(t.split("\n").count(x) for t in got.values()) - 1
    assert copies > 200 and left <= 0.05 * copies, (copies, left)


def test_passage_goes_but_for_its_first_place(spark):
    df = line_dedup.dedup_lines(frame(spark))
    assert df.columns == ["doc_id", "text", "hash", "line_stats"]
    rows = {}
    for r in df.collect():
        rows.setdefault(r.doc_id, r)
    assert rows[1].text == DOCS[0][1] and rows[2].text == f"other start\nmore\n{LONG}\nother end"
    assert rows[3].text == "last" and rows[4].text == "" and rows[None].text == "null id"
    assert rows[6].text is None and rows[7].text == "" and rows[8].text == rows[9].text == "\n\n\n\n"
    assert {r.line_stats for r in rows.values()} == {"mine"}


def test_both_joins_agree(spark, monkeypatch):
    want = sorted(map(tuple, line_dedup.dedup_lines(frame(spark)).collect()), key=repr)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.dedup_lines(frame(spark)).collect()), key=repr) == want


def test_nothing_is_put_together_from_several_documents(spark):
    line = lambda x: " ".join(x + str(k) for k in range(7))
    a, b, c = map(line, "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"x\n{a}\n{b}\n{c}")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == dict(rows)
    # Only two documents that have the whole of it in one place are copies.
    rows += [(0, f"y\n{a}\n{b}\n{c}\nz")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: rows[4][1], 1: rows[0][1], 2: rows[1][1], 3: "", 4: "x"}


@pytest.mark.parametrize("bits", [1, 4])
def test_clashing_hashes_lose_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "_line_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(bits)))
    rows = corpus(4)[0]
    assert sorted(map(tuple, line_dedup.report(frame(spark, rows)).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty(spark):
    assert line_dedup.dedup_lines(frame(spark).limit(0)).count() == 0
