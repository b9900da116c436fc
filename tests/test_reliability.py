import io
import zipfile
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensemblage.operators import isolation, reports
from ensemblage.sources import npz, parts
from ensemblage.streaming import lineage

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("top", T.DoubleType())])


def test_a_group_that_fails_leaves_the_others(spark):
    def spread(key, pdf):
        if key[0] == "raises":
            raise ZeroDivisionError("by design")
        if key[0] == "column":
            return pd.DataFrame({"n": [1]})
        if key[0] == "kind":
            return pd.DataFrame({"n": ["not a number"], "top": [1.0]})
        if key[0] == "nothing":
            return pd.DataFrame({"n": [], "top": []})
        if key[0] == "two":
            return pd.DataFrame({"n": [1, 2], "top": [None, 2.0], "extra": [0, 0]})
        return pd.DataFrame({"n": [len(pdf)], "top": [pdf["v"].max()]})

    rows = [(g, float(k)) for g in ("ok", "raises", "column", "kind", "nothing", "two", None) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, v double")
    results = isolation.isolated(df, ["g"], spread, SCHEMA)
    assert results.columns == ["g", "n", "top", "error", "trace"]
    good = sorted(map(tuple, isolation.succeeded(results).collect()), key=repr)
    assert good == sorted([("ok", 3, 2.0), (None, 3, 2.0), ("two", 1, None), ("two", 2, 2.0)], key=repr)
    bad = {r.g: r for r in isolation.failed(results, ["g"]).collect()}
    assert set(bad) == {"raises", "column", "kind"}
    assert bad["raises"].error == "ZeroDivisionError: by design" and "test_reliability" in bad["raises"].trace
    assert bad["column"].error.startswith("KeyError")
    status = {r.g: r.status for r in reports.run_status(df.select("g").distinct(), isolation.succeeded(results), isolation.failed(results, ["g"]), "g").collect()}
    assert status["ok"] == "done" and status["raises"] == "failed" and status["nothing"] == "waiting"
    assert isolation.isolated(df.where("false"), ["g"], spread, SCHEMA).collect() == []


def test_small_groups_are_dealt_to_all_tasks(spark):
    df = spark.range(400).select((F.col("id") % 100).alias("g"), F.col("id").cast("double").alias("v"))
    results = isolation.isolated(df, ["g"], lambda key, pdf: pd.DataFrame({"n": [len(pdf)], "top": [pdf["v"].max()]}), SCHEMA)
    placed = results.withColumn("at", F.spark_partition_id()).collect()
    assert {(r.g, r.n, r.top) for r in placed} == {(g, 4, 300.0 + g) for g in range(100)}
    assert len({r["at"] for r in placed}) == 4


class Held:
    """A map or value of a state, which counts its calls."""

    calls = 0

    def __init__(self, *kind):
        self.rows = {}

    def containsKey(self, key):
        Held.calls += 1
        return key in self.rows

    def getValue(self, key):
        Held.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        Held.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        Held.calls += 1
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value


@pytest.mark.parametrize("held", [50, 200_000])
def test_families_of_a_window_are_written_together(monkeypatch, held):
    monkeypatch.setattr(lineage, "HELD", held)
    handle = SimpleNamespace(getMapState=Held, getValueState=Held, registerTimer=lambda at: None)
    p = lineage.LineageWindows(100, 1000, 0.0, 1.0, 4, 0)
    p.init(handle)
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"label": rng.integers(0, 700, 3000).astype(str), "ms": rng.integers(0, 200, 3000), "value": rng.uniform(0, 4, 3000)})
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    Held.calls = 0
    for batch in (rows[:2000], rows[2000:]):
        assert list(p.handleInputRows(("r",), iter([batch[:700], batch[700:]]), times)) == []
    if held > 50:
        assert Held.calls < 400  # three for each family were 4,000 and more
    for ends in (100, 200):
        (out,) = p.handleExpiredTimer(("r",), times, SimpleNamespace(getExpiryTimeInMs=lambda: ends))
        sizes = rows[rows["ms"] // 100 == ends // 100 - 1]["label"].value_counts()
        assert (out["n"][0], out["n_unique"][0]) == (sizes.sum(), len(sizes))
        assert out["ess"][0] == pytest.approx(sizes.sum() ** 2 / (sizes**2).sum())
    assert out["hist_n"][0] == 3000 and not p.families.rows and not p.parts.rows and not p.open.rows


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


@pytest.fixture(params=[0, parts.LARGE])
def large(request, monkeypatch):
    """Parts are tried whole, or by jobs of their own."""
    monkeypatch.setattr(parts, "LARGE", request.param)
    if not request.param:
        monkeypatch.setitem(parts._COUNT, "parquet", None)
        monkeypatch.setitem(parts._COUNT, "csv", None)


def test_large_parts_are_never_held(spark, tmp_path, large):
    base = tmp_path / "large"
    put(base / "csv" / "a.csv", 'k,v\n1,"two\nlines"\r\n\n2,2.5')
    put(base / "csv" / "ragged.csv", "k,v\n7,1\n8,1,1\n")
    put(base / "csv" / "bytes.csv", b"k,v\n9,\xff\xfe\n", "wb")
    put(base / "csv" / "quote.csv", 'k,v\n10,"open\n')
    got = {r.path.rsplit("/", 1)[1]: (r.rows, r.error) for r in parts.audited(spark, f"file://{base}/csv", "csv").collect()}
    assert got.pop("a.csv") == (2, None)
    assert set(got) == {"ragged.csv", "bytes.csv", "quote.csv"} and all(n is None and e for n, e in got.values())
    spark.range(1000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).repartition(3).write.parquet(f"file://{base}/parquet")
    files = sorted((base / "parquet").glob("*.parquet"))
    files[0].write_bytes(files[0].read_bytes()[:900])
    content = bytearray(files[1].read_bytes())
    content[200:1200] = bytes(1000)
    files[1].write_bytes(content)
    for crc in (base / "parquet").glob(".*.crc"):
        crc.unlink()
    got = {r.path.rsplit("/", 1)[1]: (r.rows, r.error) for r in parts.audited(spark, f"file://{base}/parquet").collect()}
    assert got[files[2].name][0] in (333, 334) and got[files[2].name][1] is None
    assert all(got[f.name][0] is None and got[f.name][1] for f in files[:2]) and len(got) == 3


def test_merge_of_csv_parts(spark, tmp_path):
    base = tmp_path / "csv"
    put(base / "a.csv", "k,v\n1,1.5\n2,2.5\n")
    put(base / "b.csv", "k,v\n2,9.5\n3,\n")
    put(base / "empty.csv", "")
    put(base / "ragged.csv", "k,v\n7,1\n8,1,1\n")
    put(base / "bytes.csv", b"k,v\n9,\xff\xfe\n", "wb")
    put(base / "deep" / "quote.csv", 'k,v\n10,"open\n')
    put(base / "note.txt", "no part")
    rows, skipped = parts.merged(spark, f"file://{base}", T.StructType.fromDDL("k int, v double"), ["k"], [F.col("part")], "csv")
    assert sorted((r.k, r.v) for r in rows.collect()) == [(1, 1.5), (2, 9.5), (3, None)]
    assert {r.path.rsplit("/", 1)[1] for r in skipped.collect()} == {"empty.csv", "ragged.csv", "bytes.csv", "quote.csv"}
    assert all(r.error for r in skipped.collect())


def test_merge_of_parquet_parts(spark, tmp_path):
    base = tmp_path / "parquet"
    for k in range(4):
        df = spark.range(100 * k, 100 * k + 150).select("id", F.lit(k).alias("shard"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        (df.drop("x") if k == 3 else df).coalesce(1).write.parquet(f"file://{base}/s{k}")
    (file,) = (base / "s1").glob("*.parquet")
    content = bytearray(file.read_bytes())
    content[200:1200] = bytes(1000)  # pages are damaged, the footer is whole
    file.write_bytes(content)
    for crc in base.rglob("*.crc"):
        crc.unlink()
    rows, skipped = parts.merged(spark, f"file://{base}", T.StructType.fromDDL("id long, shard int, x string"), ["id"], [F.col("shard")])
    got = {r.id: (r.shard, r.x is None) for r in rows.collect()}
    want = {i: (k, k == 3) for k in (0, 2, 3) for i in range(100 * k, 100 * k + 150)}
    assert got == want
    (bad,) = skipped.collect()
    assert "/s1/" in bad.path and bad.error


def arrays(path):
    with np.load(path) as a:
        return {k: a[k] for k in a.files}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    npz.register(spark)
    base = tmp_path_factory.mktemp("npz")
    rows = []
    for m in ("abf", "fr"):
        for s in range(3):
            rows.append((f"{m}_seed{s}.npz", "x", [2, 2], [1.0, None, 3.0, float(s)], None))
            rows.append((f"{m}_seed{s}.npz", "y", [3], [0.0, 1.0, 2.0], None))
            rows.append((f"{m}_seed{s}.npz", "method", [], None, [m]))
    df = spark.createDataFrame(rows, "file string, member string, shape array<long>, values array<double>, texts array<string>")
    df.repartition(4, "file").write.format("npz").mode("append").save(str(base))
    return base


PATTERN = r"^(?P<method>\w+)_seed(?P<seed>\d+)\.npz$"


def test_npz_round_trip(spark, folder):
    assert sorted(p.name for p in folder.iterdir()) == [f"{m}_seed{s}.npz" for m in ("abf", "fr") for s in range(3)]
    a = arrays(folder / "fr_seed2.npz")
    assert a["x"].shape == (2, 2) and np.isnan(a["x"][0, 1]) and a["x"][1, 1] == 2 and str(a["method"]) == "fr"
    rows = spark.read.format("npz").option("pattern", PATTERN).load(str(folder)).collect()
    assert len(rows) == 18
    x = next(r for r in rows if (r.method, r.seed, r.member) == ("abf", "1", "x"))
    assert x.shape == [2, 2] and x["values"] == [1.0, None, 3.0, 1.0] and x.texts is None
    assert {r.texts[0] for r in rows if r.member == "method"} == {"abf", "fr"}


def test_npz_filters_choose_files_and_members(spark, folder, tmp_path):
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    for p in folder.iterdir():
        (damaged / p.name).write_bytes(p.read_bytes())
    # Where y stands, its bytes are destroyed; another file is no archive at all.
    target = damaged / "abf_seed0.npz"
    content = bytearray(target.read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        info = z.getinfo("y.npy")
    at = info.header_offset + 30 + len("y.npy")
    content[at : at + info.compress_size] = bytes(info.compress_size)
    target.write_bytes(content)
    (damaged / "fr_seed1.npz").write_bytes(b"no archive")
    df = spark.read.format("npz").option("pattern", PATTERN).load(str(damaged))
    rows = df.where(F.col("method").isin("abf") & F.col("member").isin("x", "method")).collect()
    assert len(rows) == 6 and {r.member for r in rows} == {"x", "method"}
    one = df.where((F.col("seed") == "2") & (F.col("member") == "y"))
    assert one.rdd.getNumPartitions() == 2 and {r.method for r in one.collect()} == {"abf", "fr"}
    with pytest.raises(Exception, match="zip|Zip|Error"):
        df.where("member = 'y' and method = 'abf'").collect()
    assert df.where("method = 'none'").collect() == []
