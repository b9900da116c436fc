import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from ensemblage.llm import conversations as cv

WORD = re.compile("[^\x20\x09-\x0d]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        d = zlib.crc32(key.encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(c, t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def brute(turns):
    """Counts and the cheapest edit by best-first search over all edits: what comes
    first out of the heap has the least cost and, of these, the least audit."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        found = [m.group() for m in WORD.finditer(text)]
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    known = {t for t, _, _ in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    counts = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal)
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return (*counts, cost, audit, sha("\n".join(lines)))
        options = [(3, "I", 0, "u", ("user:",)), (3, "I", 0, "a", ("assistant:",))]
        if i < len(turns):
            _, role, text = turns[i]
            options.append((4, "D", 1, "", ()))
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                if role:
                    options.append((more, "K", 1, role[0], (f"{role}:{text}",)))
                options += [(3 + more, "R", 1, "u", (f"user:{text}",)), (3 + more, "R", 1, "a", (f"assistant:{text}",))]
        for c, edit, step, initial, line in options:
            heapq.heappush(heap, (cost + c, audit + edit, i + step, initials + initial, lines + line))


def talk(rng, size):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", "ux", " "]
    texts = ["Yes.", "No!", "why?", "cut", "", " \n", "é. ", "Yes.", "a\x1c", "Yes. "]
    weights = [6, 6, 6, 6, 2, 1, 1, 1, 1, 1]
    return [(rng.choice([None, *range(size)]) if rng.random() < 0.3 else k, rng.choices(roles, weights)[0], rng.choice(texts)) for k in range(size)]


def parse(turns):
    tally, chart = cv.Tally(), cv.Chart()
    for turn, role, text, *faults in turns:
        chart.scan(*tally.add(turn, role, *faults))
    return chart.best()


@pytest.mark.parametrize("block_rows", [cv.BLOCK_ROWS, 3, 1])
def test_matches_best_first_search(spark, block_rows):
    rng = random.Random(5)
    rows = [(c, *t) for c in range(120) for t in talk(rng, rng.choice([1, 2, 3, 4, 5]))]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (500, 1, None, None), (501, -(2**63), "user", "A."), (501, 2**63 - 1, "assistant", "B.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in cv.report(df, block_rows=block_rows).collect()}
    turns = {}
    for c, *t in rows:
        turns.setdefault(c, []).append((t[0], t[1] if t[1] is not None else " ", t[2] if t[2] is not None else " "))
    for c, t in turns.items():
        want = brute(t)
        if c == 501:  # the gap is beyond a long
            want, got[c] = want[1:], got[c][1:]
        assert got[c] == want, (c, t)
    assert set(got) == set(turns)


@pytest.mark.parametrize("block_rows", [cv.BLOCK_ROWS, 2])
def test_repaired_turns_are_what_is_hashed(spark, block_rows):
    rng = random.Random(6)
    rows = [(c, *t) for c in range(40) for t in talk(rng, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {r.conv_id: r.repaired_sha256 for r in cv.report(df).collect()}
    lines = {c: [] for c in want}
    for r in sorted(cv.repaired(df, block_rows).collect(), key=lambda r: (r.conv_id, r.block, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(x)) for c, x in lines.items()} == want


def test_long_conversation_block_by_block(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"text {k}.", f"cut {k}", ""])) for k in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert cv.report(df).collect() == cv.report(df, block_rows=100).collect()


def test_audits_keep_their_order_when_common_parts_are_settled():
    rng = random.Random(8)
    rows = [(rng.choice("usat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(3 * cv._FLUSH)]
    one, two = cv.Chart(), cv.Chart()
    two._rows = 1
    for r in rows:
        one.scan(*r)
        two.scan(*r)
    assert one.best() == two.best()


def test_query_matches_damaged_brute_force(spark):
    rng = random.Random(9)
    rows = [(c, *t) for c in range(60) for t in talk(rng, rng.choice([1, 3, 5]))] + [(None, None, None, None), (900, 3, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in cv.report(df, cv.damage(df)).collect()}
    turns = {c: [] for c, *_ in rows}
    for c, *t in damaged(rows):
        turns[c].append(tuple(t))
    none = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got == {c: brute(t) if t else none for c, t in turns.items()}
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(cv.oracle())
    assert want.columns == cv.report(df).columns
    assert {r[0]: r[1:] for r in want.fetchall()} == got


def test_table_matches_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = cv.report(df, cv.damage(df))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(cv.oracle()).fetchall())


def test_empty_and_repeated(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert cv.report(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, 0, "user", "A.")] * 4 + [(1, 1, "assistant", "é" * 300_000 + ".")]
    (r,) = cv.report(spark.createDataFrame(rows, kind)).collect()
    assert (r.duplicate, r.audit, r.cost) == (3, "KDDDK", 12)
