import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblage import sources


def test_config_must_be_a_mapping(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("grid:\n  eta: [0.1, 0.2]\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert sources.read_config(spark, str(tmp_path / "a.yaml")) == {"grid": {"eta": [0.1, 0.2]}}
    with pytest.raises(ValueError):
        sources.read_config(spark, str(tmp_path / "b.yaml"))


def test_csv_missing_values_and_fallback(spark, tmp_path):
    (tmp_path / "shard-1.csv").write_text("run_id,v\na,1.5\nb,nan\nc,\nd,x\n")
    schema = "run_id string, v double"
    rows = {r.run_id: r.v for r in sources.read_table(spark, str(tmp_path / "shard-1.csv"), schema).collect()}
    assert rows == {"a": 1.5, "b": None, "c": None, "d": None}
    got = sources.first_existing(spark, [str(tmp_path / "merged.csv"), str(tmp_path / "shard-*.csv")], schema)
    assert got.count() == 4
    with pytest.raises(FileNotFoundError):
        sources.first_existing(spark, [str(tmp_path / "none.csv")])


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "run.npz", a=np.arange(6.0).reshape(2, 3), none__b=np.array(1), name=np.array("x"))
    rows = {r.name: r for r in sources.read_npz(spark, str(tmp_path)).collect()}
    assert rows["a"].shape == [2, 3] and rows["a"]["values"] == [0, 1, 2, 3, 4, 5]
    assert rows["b"]["values"] is None and rows["name"].texts == ["x"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" 1.0  2.5\n\n3 x\n")
    rows = sources.read_wide_text(spark, str(tmp_path / "w.txt")).orderBy("line", "pos").collect()
    assert [(r.pos, r.value) for r in rows] == [(0, 1.0), (1, 2.5), (0, 3.0), (1, None)]
    (tmp_path / "l.txt").write_text("dt : 0.1\nnote: a:b\nnothing\n")
    assert {r.label: r.value for r in sources.read_labelled(spark, str(tmp_path / "l.txt")).collect()} == {"dt": "0.1", "note": "a:b"}


def test_numbers_as_text_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(0.00125,), (0.0,)], "v double")
    assert [r[0] for r in df.select(sources.scientific(F.col("v"))).collect()] == ["1.25e-3", "0"]
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sources.cached_reference(spark, str(tmp_path), {"a": 1.5, "n": 3}, build).count() == 3
    assert len(built) == 1
    a = spark.createDataFrame([(1, 1.0)], "j int, F double")
    assert sources.cross_check(a, a.withColumn("F", F.col("F") + 0.01), [], "j", "F").first().ok
