import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ensemblage.llm import toxicity as tox
from ensemblage.llm.common import text_buffers

CLEAN = "the garden was quiet and the river moved slowly under old trees while people talked about weather bread and music".split()
TOXIC = ["idiot", "moron", "stupid", "worthless"]


def sentence(rng, bad):
    words = [rng.choice(CLEAN) for _ in range(rng.randrange(15, 60))]
    if bad:
        words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    bad = [i % 6 == 0 for i in range(900)]
    data, offsets = text_buffers(pa.array([sentence(rng, b) for b in bad], pa.large_string()))
    return tox.learn(data, offsets, np.array(bad))


def scores(model, texts):
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    return model.score(*tox.with_restored(data, offsets, tox.Channel(tox.CharModel(model.chars))))


DISGUISED = ["idiiot", "i\u200bdi\u200bot", "idi\u00adot", "id\u0456ot", "\u043coron", "m\u03bfron", "i  d  i  o  t", "i..d..i..o..t", "i   d i   o t", "1d10t", "i d i o t", "i.d.i.0.t", "idiooooot", "IDIOT!", "m0r0n", "$tup1d", "st*pid", "w0rthl3ss", "m-o-r-o-n"]


@pytest.mark.parametrize("word", DISGUISED)
def test_disguised_words_are_restored(model, word):
    bad, good = scores(model, [f"you are an {word} they said", "you are an artist they said"])
    assert bad >= tox.THRESHOLD > good


def test_short_spans_and_doubled_letters_are_restored():
    rng = random.Random(6)
    words = [w for w in CLEAN + ["ass", "bad", "duck", "luck"] for _ in range(20)]
    text = " ".join(rng.sample(words, len(words))).encode()
    channel = tox.Channel(tox.CharModel(tox.CharModel.count(np.frombuffer(text, np.uint8))))
    for seen, want in [("a s s", "ass"), ("b  a  d", "bad"), ("b-a-d", "bad"), ("duuck", "duck"), ("LUUCK", "luck"), ("b\u0430d", "bad"), ("du\u200bck", "duck"), ("8ad", "bad")]:
        assert want in channel.restored(f"it is {seen} they say"), seen
        data, offsets = text_buffers(pa.array([f"it is {seen} they say", "it is quiet they say"], pa.large_string()))
        d, o = tox.with_restored(data, offsets, channel)
        assert d[o[0] : o[1]].tobytes().decode().split()[-1] == want or want in d[o[0] : o[1]].tobytes().decode().split()
        assert d[o[1] : o[2]].tobytes() == b"it is quiet they say"
    # Natural double letters stay.
    for word in ("weather", "ass", "moved"):
        assert channel.restored(f"it is {word} they say") == []


LONG = ["idi" + "o" * 60 + "t", "m0r" + "0" * 30 + "n", "a i-d-i-o-t", "y i d i o t", "a i d i o t", "i d i o t y", "stupid" + "d" * 50, " ".join("people talked about stupid weather".replace(" ", "")), ".".join("peopletalkedaboutworthlessmusic")]


@pytest.mark.parametrize("word", LONG)
def test_long_spans_and_spaced_phrases_are_restored(model, word):
    bad, good = scores(model, [f"they said {word} to", f"they said {' '.join('people talked about quiet weather'.replace(' ', ''))} to"])
    assert bad >= tox.THRESHOLD > good


def test_long_spans_take_linear_time(model):
    channel = tox.Channel(tox.CharModel(model.chars))
    for text in ("(" * 200_000 + "{", "a1" * 20_000, "a " * 20_000, "ab" * 100_000 + "aaa", "," * 200_000, "(," * 100_000):
        start = time.monotonic()
        channel.restored(text)
        assert time.monotonic() - start < 10


def test_clean_marks_do_no_harm(model):
    texts = ["room 101 at 10:30, call 555-0100", "mail a.b@example.com about the €5 and £7 notes", "a b c d e f g", "soooo niiice", "x" * 50000, "", None, "\n\t", "$$$ !!! 000", "Ünï çödé 1é2"]
    assert (scores(model, texts) < tox.THRESHOLD).all()


def test_held_out_accuracy(model):
    rng = random.Random(2)
    bad = [i % 5 == 0 for i in range(300)]
    s = scores(model, [sentence(rng, b) for b in bad])
    assert ((s >= tox.THRESHOLD) == np.array(bad)).mean() > 0.99


def test_decoder_finds_the_best_path(model):
    # Against all paths of a short lattice.
    channel = tox.Channel(tox.CharModel(model.chars))

    def best(seen):
        found = {("", 0, 0): 0.0}
        for c in seen:
            then = {}
            choices = [(c, tox._SAME)] if c in tox._LETTERS else []
            choices += [(x, tox._LOOKS - np.log(len(tox.LOOKS_LIKE[c]))) for x in tox.LOOKS_LIKE.get(c, "")]
            for (w, a, b), s in found.items():
                for x, cost in choices:
                    k = ord(x) - 96
                    then[w + x, b, k] = max(then.get((w + x, b, k), -1e9), s + cost + channel.log[a, b, k])
                    if k == b:
                        then[w, a, b] = max(then.get((w, a, b), -1e9), s + cost + tox._AGAIN)
                if c in tox._SEPARATORS or not choices:
                    then[w, a, b] = max(then.get((w, a, b), -1e9), s + tox._NOTHING)
            found = then
        return max((s + channel.log[a, b, 0], w) for (w, a, b), s in found.items())[1]

    for seen in ("1d10t", "m0ro0n", "b r1 a d", "7ree$", "##", "aaab"):
        assert channel.decode(seen) == best(seen)


def test_query_with_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, i % 6 == 0), 0.5, "x") for i in range(400)] + [(1000, None, 0.5, "x"), (None, "", 0.5, "x"), (7, "same id other text", 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(400)] + [(None, 1, 1), (3, None, 1), (5, 0, 1), (5, 0, 1)], "doc_id long, toxic int, text int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    kept = tox.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 300 < kept.count() < len(rows)
    assert tox.toxicity(docs.limit(0), labels).count() == 0
    assert all(r.score < 0.3 for r in tox.toxicity(docs, labels.limit(0)).collect())


def test_scores_match_brute_force(spark):
    """The query's scores from sets of features in Python, given the decoder (which is
    held against all paths above)."""
    rng = random.Random(5)
    texts = {i: sentence(rng, i % 6 == 0) + rng.choice(["", " 1d10t", " s t u p i d day", " the riverrrr"]) * (i % 7 == 0) for i in range(700)}
    texts[900] = " ".join(sentence(rng, False) for _ in range(900)) + " moron"
    toxic = {i: int(any(w in t for w in TOXIC) or "1d10t" in t or "s t u p" in t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, v) for i, v in toxic.items() if i % 10], "doc_id long, toxic int")
    chars = sum(tox.CharModel.count(np.frombuffer((t + "\n").encode(), np.uint8)) for t in texts.values())
    assert (tox.char_counts(docs) == chars).all()
    channel = tox.Channel(tox.CharModel(chars))

    def features(text):
        words = re.findall("[A-Za-z0-9\x80-\U0010ffff]+", " ".join([text, *channel.restored(text)]).lower())
        return {*words, *((n, w[:n]) for w in words for n in tox.PREFIXES if len(w) > n)}

    rank = {r.doc_id: r["rank"] for r in tox.chosen_labels(labels).collect()}
    assert set(rank) == {i for i in texts if i % 10 and zlib.crc32(str(i).encode()) % 4 != 2}
    of = {i: features(t) for i, t in texts.items()}

    def evidence(ids):
        ones = sum(toxic[i] for i in ids)
        prior = (ones + 0.5) / (len(ids) + 1)
        none = math.log(prior / (1 - prior))
        out = {}
        for f in set().union(*(of[i] for i in ids if toxic[i])):
            a, b = (sum(f in of[i] for i in ids if toxic[i] == k) for k in (1, 0))
            p = (a + 4 * prior) / (a + b + 4)
            gain = a * math.log(a / (a + b) / prior) + (b * math.log(b / (a + b) / (1 - prior)) if b else 0)
            if a >= 3 and gain > 10 and math.log(p / (1 - p)) > none + 0.5:
                out[f] = math.log(p / (1 - p))
        return lambda text_features: none + sum((e - none) * tox.SHARE**k for k, e in enumerate(sorted((out[f] for f in text_features if f in out), reverse=True)))

    halves = [evidence([i for i in rank if rank[i] % 2 == half]) for half in (0, 1)]
    x = np.array([halves[1 - rank[i] % 2](of[i]) for i in rank])
    scale, shift = tox._calibrate(x, np.array([float(toxic[i]) for i in rank]))
    every = evidence(list(rank))
    got = {r.doc_id: r.score for r in tox.toxicity(docs, labels).collect()}
    for i in texts:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(scale * every(of[i]) + shift))), rel=1e-4)
    assert got[900] >= tox.THRESHOLD


def test_training_ids_are_bounded(spark, monkeypatch):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    monkeypatch.setattr(tox, "TRAIN_ROWS", 300)
    assert 250 < tox.chosen_labels(labels).count() <= 300
