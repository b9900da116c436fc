import random

import duckdb
import numpy as np
import pytest
from test_ngram_join import brute, corpus

from ensemblage.llm import superminhash as sm
from ensemblage.llm.common import mix64
from ensemblage.llm.ngram_join import Join

TWO = Join(n=2, num=80, den=100)


def random_sets(rng, sizes):
    return [np.unique(np.frombuffer(rng.randbytes(8 * n), np.uint64)) for n in sizes]


def slow(items):
    """One element at a time, one whole shuffle each."""
    best = [2**64 - 1] * sm.PLACES
    for x in items:
        order = list(range(sm.PLACES))
        for j in range(sm.PLACES):
            with np.errstate(over="ignore"):
                drawn = int(mix64(np.array([x], np.uint64) + np.uint64(j + 1) * sm._STEP)[0])
            k = j + ((drawn & 0xFFFFFFFF) * (sm.PLACES - j) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], j << 56 | drawn >> 8)
    return best


def test_early_stop_changes_nothing(monkeypatch):
    sets = random_sets(random.Random(1), [1, 2, 5, 40, 300, 1, 700])
    want = [slow(s) for s in sets]
    assert sm.signatures(sets).tolist() == want
    monkeypatch.setattr(sm, "BLOCK", 7)
    assert sm.signatures(sets).tolist() == want
    assert sm.signatures([]).shape == (0, sm.PLACES)


def test_ranks_of_one_element_are_a_permutation():
    (row,) = sm.signatures(random_sets(random.Random(2), [1]))
    assert sorted((row >> np.uint64(56)).tolist()) == list(range(sm.PLACES))


@pytest.mark.parametrize("size", [6, 60, 2000])
def test_estimates_have_less_variance_than_independent_minima(size):
    rng = random.Random(3)
    errors = []
    for _ in range(300):
        (both,) = random_sets(rng, [size])
        a, b = both[: size * 5 // 6], both[size // 6 :]
        true = len(np.intersect1d(a, b)) / size
        x, y = sm.signatures([a, b])
        errors.append(sm.estimate(x, y) - true)
    assert abs(np.mean(errors)) < 0.01
    independent = true * (1 - true) / sm.PLACES
    assert np.mean(np.square(errors)) < (0.6 if size <= 60 else 1.2) * independent


@pytest.mark.parametrize("seed,join", [(1, TWO), (2, Join())])
def test_components_match_brute_force(spark, seed, join):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, component_id int").repartition(5)
    got = sm.near_duplicates(df, join).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute(rows, join)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sets_at_the_threshold_meet(spark):
    rng = random.Random(4)
    rows, doc = [], 0
    for _ in range(300):
        size = rng.choice([9, 18, 90, 360])
        words = [f"w{rng.randrange(10**9)}" for _ in range(size + 1)]
        # One changed end takes shingles away: 8 of 9, 80 of 100 and the like.
        cut = words[: len(words) - size // 5] if size > 9 else words[:-1]
        rows += [(doc, " ".join(words)), (doc + 1, " ".join(cut))]
        doc += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sm.near_duplicates(df, TWO).collect()}
    assert got == {i: i - i % 2 for i in got}


def test_empty_table_and_keep_one(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n int")
    assert sm.near_duplicates(df, TWO).collect() == []
    assert sm.keep_one(df).collect() == []
    df = spark.createDataFrame([(3, "a b c d e f"), (2, "a b c d e f"), (None, None), (5, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in sm.keep_one(df).collect()) == [0, 2, 5]


def test_table_matches_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sm.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), TWO)
    want = con.sql(sm.oracle(TWO))
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_union_find_keeps_what_is_joined(spark, monkeypatch):
    from ensemblage.llm import components as cc

    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(7, 7), (0, 1), (0, 1)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    forest = cc.spanning_forest(df)
    assert forest.count() <= len(links) - 3
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    used = {x for a, b in links if a != b for x in (a, b)}
    want = {x: root(x) for x in used}
    assert {r.node: r.component for r in cc.components(df).collect()} == want
    assert {r.node: r.component for r in cc.components(forest).collect()} == want
    monkeypatch.setattr(cc, "FEW_LINKS", 0)
    monkeypatch.setattr(cc, "MOST_NODES", 20)
    assert {r.node: r.component for r in cc.components(df).collect()} == want
    assert cc.components(df.where("a = b")).collect() == []


@pytest.mark.parametrize("steps", [0, 1, 3, sm.PLACES])
def test_looked_up_steps_are_those_of_the_table(monkeypatch, steps):
    sets = random_sets(random.Random(5), [3, 900, 1, 30, 250, 2])
    monkeypatch.setattr(sm, "LOOKED_UP", steps)
    assert sm.signatures(sets).tolist() == [slow(s) for s in sets]
