import duckdb

from ensemblage.llm import mixing

DOCS = [(i, "w " * (i % 13), ["en", "de", None][i % 3], f"src{i % 5}" if i % 7 else None) for i in range(300)]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_matches_sql(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    for targets in (mixing.Targets(), mixing.Targets(share=1.5, max_epochs=3, weights={"source": {"src1": 50}}), mixing.Targets(share=0.01), mixing.Targets(share=9.0)):
        con = duckdb.connect()
        pandas = docs.toPandas()  # noqa: F841
        con.sql("create view documents as select * from pandas")
        want = sorted(con.sql(mixing.oracle(targets)).fetchall(), key=repr)
        got = mixing.mix(docs, targets)
        assert as_rows(got) == want
        used = mixing.mixed_documents(docs, targets).collect()
        words = {}
        for r in used:
            words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
        assert {k: v for k, v in words.items() if v} == {r.doc_id: r.taken_tokens for r in got.collect() if r.taken_tokens}


def test_shares_fill_within_capacity(spark):
    nodes = spark.createDataFrame([("r", "a", 10, 1.0, 100), ("r", "b", 1000, 1.0, 100), ("r", "c", 30, 2.0, 100)], "p string, n string, cap long, weight double, given long")
    got = {r.n: r.tokens for r in mixing.share_out(nodes, ["p"], "n").collect()}
    assert got == {"a": 10, "c": 30, "b": 60}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d", "en", "src0", 1, "x")] * 3 + [(None, "a b", None, None, 2, "y"), (2, None, "en", "src0", 3, "z"), (3, "", "de", "s", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, leaf string")
    got = mixing.mix(docs, mixing.Targets(share=0.5)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken_tokens <= 2 * r.n_tokens for r in got)
    assert mixing.mixed_documents(docs, mixing.Targets(share=1.0)).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


def test_weight_of_zero_takes_nothing(spark):
    rows = [(i, "w " * 10, ["en", "de"][i % 2], f"src{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for weights in ({"lang": {"de": 0}}, {"source": {"src1": 0}, "lang": {"de": 0}}, {"lang": {"de": 0, "en": 0}}):
        got = mixing.mix(df, mixing.Targets(share=0.3, weights=weights)).collect()
        barred = lambda r: weights["lang"].get(r.lang) == 0 or weights.get("source", {}).get(r.source) == 0
        assert all(r.taken_tokens == 0 for r in got if barred(r))
        assert sum(r.taken_tokens for r in got) == (180 if not all(map(barred, got)) else 0)
