import random

import numpy as np
import pytest

from ensemblage.llm import ngram_join as nj
from ensemblage.llm.components import components


def shingles(text, n):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(table)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, join):
    sets = [shingles(t, join.n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and join.den * len(sets[i] & sets[j]) >= join.num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d if not sets[i] else None))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 60, 120]))] for _ in range(25)]
    for k in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(at, "new"), lambda: w.__setitem__(min(at, len(w) - 1), rng.choice(words)), lambda: w.__delitem__(slice(at, at + 1))])()
            w = w or ["x"]
        if rng.random() < 0.3:
            w = passage + w
        text = (" " if rng.random() < 0.9 else "\n\t").join(w)
        rows.append((k, text.upper() if rng.random() < 0.1 else text))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "one two"), (505, "ONE two"), (506, "one\x0ctwo three"), (None, rows[0][1]), (7, rows[9][1]), (507, "é " * 3000), (508, "É " * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,join", [(1, nj.Join(3, 90, 100)), (2, nj.Join())])
def test_components_match_brute_force(spark, seed, join):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n_shingles int, cls string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_duplicates(df, join).collect()), key=repr)
    assert got == brute(rows, join)


def test_empty(spark):
    assert nj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    graph = {}
    for a, b in links:
        if a != b:
            graph.setdefault(a, set()).add(b)
            graph.setdefault(b, set()).add(a)
    for node in graph:
        seen, todo = {node}, [node]
        while todo:
            for x in graph[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(graph)


@pytest.mark.parametrize("join", [nj.Join(3, 90, 100), nj.Join(), nj.Join(5, 60, 100)])
def test_linked_sets_share_a_region(monkeypatch, join):
    """Whatever the sizes, and however many parts are empty."""
    rng = np.random.default_rng(4)
    for deals in (nj.DEALS, 1):
        monkeypatch.setattr(nj, "DEALS", deals)
        sets = []
        for size in (1, 2, 3, 4, 5, 7, 9, 10, 13, 20, 40, 77, 150, 400):
            for _ in range(6):
                base = rng.integers(0, 2**63, size, dtype=np.uint64)
                most = join.differ(size)
                sets.append(np.unique(base))
                for _ in range(6):
                    cut = int(rng.integers(0, most + 1))
                    more = rng.integers(0, 2**63, int(rng.integers(0, most + 1)), dtype=np.uint64)
                    sets.append(np.unique(np.concatenate([base[cut:], more])) if size > cut else np.unique(base))
        which, region = nj.regions_of(sets, join)
        of = [set(region[which == i].tolist()) for i in range(len(sets))]
        linked = 0
        for at in range(0, len(sets), 7):
            for i in range(at, at + 7):
                for j in range(at, i):
                    same = len(np.intersect1d(sets[i], sets[j]))
                    if join.den * same >= join.num * (len(sets[i]) + len(sets[j]) - same) and same < max(len(sets[i]), len(sets[j])):
                        linked += 1
                        assert of[i] & of[j]
        assert linked > 100


def test_cells_find_every_pair():
    rng = np.random.default_rng(5)
    join = nj.Join(3, 90, 100)
    base = rng.integers(0, 2**63, (6, 150), dtype=np.uint64)
    sets = []
    for k in range(900):
        s = base[k % 6].copy()
        at = rng.integers(0, 150, rng.integers(0, 25))
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    sketch = np.stack([nj.short_parity(s) for s in sets]).view(np.uint64)
    group = rng.integers(0, 300, 900)
    want = set()
    for i in range(900):
        d = np.bitwise_count(sketch[i] ^ sketch).sum(1)
        for j in np.flatnonzero((d <= join.apart(n[i] + n)) & (group != group[i])):
            want.add((min(i, int(j)), max(i, int(j))))
    got = {(min(i, j), max(i, j)) for x, y in nj.voronoi_join(n, sketch, group, join) for i, j in zip(x.tolist(), y.tolist())}
    assert got == want and len(want) > 1000
    one = [(i, j) for x, y in nj.voronoi_join(n, sketch, group, join, 1) for i, j in zip(x.tolist(), y.tolist())]
    assert len({i for i, _ in one}) == len(one) and {(min(p), max(p)) for p in one} <= want


def test_blocks_and_shuffled_fetch_agree(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(nj, "REGION_ROWS", 3)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_duplicates(df, nj.Join(3, 90, 100)).collect()), key=repr)
    assert got == brute(rows, nj.Join(3, 90, 100))


def test_words_of_regular_structure_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 are equal for these two words."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    df = spark.createDataFrame([(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))], "doc_id long, text string")
    assert {r.component_id for r in nj.near_duplicates(df).collect()} == {1, 2}


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, 1, 1, "a"), (2, long + " more", 2, 2, "b"), (2, long + " more", 2, 2, "b"), (None, long, 3, 3, "c"), (4, None, 4, 4, "d"), (5, None, 5, 5, "e"), (6, "", 6, 6, "f"), (7, "other", 7, 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key int, cls string")
    got = nj.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r._id for r in got.collect()) == [2, 4, 5, 6, 7]
    assert nj.keep_one(df.limit(0)).count() == 0
