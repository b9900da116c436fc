import re

import corpus_pipeline
import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.materialize(stage(spark, found[-1], DIR), "test"))
    return found


def test_columns_and_decisions(stages):
    docs, clean, lines, unique, mixed, packed = stages
    assert all(s.columns == docs.columns for s in (clean, lines, unique, mixed))
    assert docs.count() >= clean.count() == lines.count() > unique.count() > 0
    texts = {r.doc_id: r.text for r in lines.collect()}
    kept = {r.doc_id for r in unique.collect()}
    assert len(kept) == unique.count()

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])

    sets = {i: shingles(t) for i, t in texts.items() if t.split()}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    assert kept == {i for i in texts if i not in sets or root(i) == i}
    # Packing places every word of what the mixture took.
    assert sum(r.n_tokens for r in packed.collect()) == sum(len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in mixed.collect())


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, DIR).count() == stages[-1].count()


ODD = [
    (1, None, None, None, 3),
    (1, None, None, None, 3),
    (2, "", "en", "src1", 0),
    (3, " \n\t ", "en", "src1", 3),
    (4, "w " * 70_000, "en", "src1", 140_000),
    (None, "no id " * 30, "de", "src2", 180),
    (None, "no id " * 30, "de", "src2", 180),
    (6, "one\ntwo\nthree", "fr", None, 13),
    (7, "one\ntwo\nthree", "fr", "odd source", 13),
    (8, "x" * 100_000, "es", "src9", 100_000),
    (9, "i d i o t s h" * 10, "en", "src9", 130),
]


def test_odd_rows_go_through_every_stage(spark):
    """Nulls, ties, repeats, very long texts, and columns that operators use themselves."""
    extra = "row int, id int, key int, _id int, _key int, hash int, cls int, leaf int, part int, rank int, tokens int, cluster string, _text string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    docs = spark.createDataFrame([(*r, *[k] * 11, "c", "t") for k, r in enumerate(ODD)], schema)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.materialize(stage(spark, docs, DIR), "odd")
        if name != "packing":
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
            docs = found
        if name in ("toxicity", "line_dedup"):
            assert found.count() == before
        if name == "near_duplicates":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in found.collect()) == [(False, i) for i in (1, 1, 2, 3, 4, 6, 8, 9)] + [(True, 0)]
    assert found.count() > 0


def test_empty_tables_go_through_every_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, DIR), "none")
        assert docs.count() == 0
