import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ensemblage.llm import ctw

rng = random.Random(2)
WORDS = ["the", "of", "ünd", "naïve", "abc", "abd", "antidisestablishment", "x1", "'"]
TEXTS = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing."]) for _ in range(rng.randrange(40)))) for i in range(60)]
TEXTS += [(100, None), (101, ""), (102, "\t\n "), (103, "THE Of"), (None, "the of"), (5, TEXTS[5][1]), (104, "unseen" * 300)]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower) + ["\n"]


def is_held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def test_base_score_matches_brute_force(spark):
    df = spark.createDataFrame([(*t, 1.0) for t in TEXTS], "doc_id long, text string, score double").repartition(3)
    got = sorted((r for r in ctw.score_documents(df).collect()), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    counts = Counter(w for i, t in TEXTS if not is_held_out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for g, (i, t) in zip(got, want):
        w = tokens(t)
        assert (g.doc_id, g.held_out, g.n_tokens, g.train_tokens) == (i, is_held_out(i), len(w), total)
        assert g.n_known == sum(counts[x] > 0 for x in w)
        assert g.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w))
        assert g.score < 0 and g.bits_per_byte == pytest.approx(-g.score / math.log10(2) / len(" ".join(w[:-1] + [""]).encode() + b"\n"))


def test_empty_table(spark):
    assert ctw.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def model_stream(text):
    return [*b"".join(w.encode() + b" " for w in tokens(text)[:-1]), ctw.END]


def brute_tree(texts):
    """Probability of a byte after its context, from a weighted tree over dictionaries:
    counts[depth, context, node], the context nearest byte first."""
    counts = defaultdict(lambda: [0, 0])
    for text in texts:
        past = [ctw.END] * ctw.DEPTH
        for byte in model_stream(text):
            for d in range(ctw.DEPTH + 1):
                context = tuple(reversed(past[len(past) - d :]))
                for k in range(8):
                    counts[d, context, (1 << k) | (byte >> (8 - k))][byte >> (7 - k) & 1] += 1
            past.append(byte)
    children = defaultdict(set)
    for d, context, node in counts:
        if d:
            children[d - 1, context[:-1], node].add((d, context, node))
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if key[0] == ctw.DEPTH else np.logaddexp(own, sum(map(weighted, children[key]))) - math.log(2)
        return memo[key]

    def probability(context, byte):
        p = 1.0
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
            mix = None
            for d in range(ctw.DEPTH, -1, -1):
                at = (d, context[:d], node)
                if at not in counts:
                    continue
                own = (counts[at][bit] + 0.5) / (sum(counts[at]) + 1)
                share = 1.0 if d == ctw.DEPTH else math.exp(kt(*counts[at]) - math.log(2) - weighted(at))
                mix = own if mix is None else share * own + (1 - share) * mix
            p *= 0.5 if mix is None else mix
        return p

    return probability


@pytest.mark.parametrize("cut", [40_000, 50])
def test_scores_match_a_direct_tree(spark, monkeypatch, cut):
    monkeypatch.setattr(ctw, "CUT", cut)
    probability = brute_tree([t for i, t in TEXTS if not is_held_out(i)])
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    got = sorted(ctw.score_documents(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    want = []
    for i, t in TEXTS:
        past, score = [ctw.END] * ctw.DEPTH, 0.0
        for byte in model_stream(t):
            score += math.log10(probability(tuple(reversed(past[-ctw.DEPTH :])), byte))
            past.append(byte)
        want.append((i is None, i or 0, score))
    for g, w in zip(got, sorted(want)):
        assert g.score == pytest.approx(w[2], rel=1e-9)


def test_the_model_is_a_distribution(spark):
    grams = Counter(ctw.gram_keys(*ctw.byte_stream(np.frombuffer(b"the then of off", np.uint8), np.array([0, 15]))).tolist())
    context = next(iter(grams)) >> 8
    asked = dict(grams) | {context << 8 | b: grams.get(context << 8 | b, 0) for b in range(256)} | {0x616263646500 | 7: 0}
    df = spark.createDataFrame(list(asked.items()), "gram long, n long")
    got = {r.gram: math.exp(r.logp) for r in ctw.gram_scores(df).collect()}
    assert set(got) == set(asked)
    assert sum(got[context << 8 | b] for b in range(256)) == pytest.approx(1)


def test_rows_are_apart():
    """Contexts end at a text's start, whatever stands in the row before."""
    texts = [b"ab c", b"", b" x", b"\xc3\xa9"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = ctw.gram_keys(*ctw.byte_stream(data, offsets)).tolist()
    apart = [k for t in texts for k in ctw.gram_keys(*ctw.byte_stream(np.frombuffer(t, np.uint8), np.array([0, len(t)]))).tolist()]
    assert together == apart


def test_words_of_regular_structure_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 are equal for these two words."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score_documents(df).collect()}
    counts = Counter(w for i, t in ((1, one), (2, two), (3, one)) if not is_held_out(i) for w in tokens(t))
    total = sum(counts.values())
    for i, t in ((1, one), (2, two)):
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens(t)))


def test_both_ways_to_score_agree(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    near = lambda rows: sorted((r.doc_id or -1, r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in rows)
    want = near(ctw.score_documents(df).collect())
    for grams, words in ((0, 0), (300, 3)):
        monkeypatch.setattr(ctw, "HEAD_GRAMS", grams)
        monkeypatch.setattr(ctw, "HEAD_WORDS", words)
        assert near(ctw.score_documents(df).collect()) == want
