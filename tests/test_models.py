"""Model files, runs, rules and graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import models as O


def test_manifest_guard(spark, tmp_path):
    good = '{"id": "m", "size": 3, "sha256": "x", "parts": [{"file": "a", "size": 3, "sha256": "y"}], "input": {"name": "i", "width": 4, "height": 4}, "output": {"name": "o"}}'
    for k, text in enumerate([good, good.replace('"size": 3, "sha256": "x"', '"sha256": "x"'), good.replace('[{"file": "a", "size": 3, "sha256": "y"}]', "[]")]):
        (tmp_path / f"{k}.json").write_text(text)
    ok = [O.read_manifest(spark, str(tmp_path / f"{k}.json")).select(O.valid_manifest(F.struct("*")).alias("v")).first().v for k in range(3)]
    assert ok == [True, False, False]
    cached = O.read_manifest(spark, str(tmp_path / "0.json"))
    assert O.read_manifest(spark, str(tmp_path / "none.json"), cached).count() == 1


def test_split_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("m", bytearray(k & 255 for k in range(1500)))], "id string, content binary")
    pieces, manifest = O.split_model(df, "id", 1000)
    m = O.manifest_of(manifest.first().manifest)
    assert [p["size"] for p in m["parts"]] == [1000, 500] and m["size"] == 1500
    path, schema = str(tmp_path / "cache"), "sha256 string, part binary, size int"
    assert O.open_store(spark, path, schema).count() == 0
    O.fill_cache(pieces, path)
    O.fill_cache(pieces, path)
    assert O.open_store(spark, path, schema).count() == 2
    O.clear_store(spark, path, schema)
    assert O.open_store(spark, path, schema).count() == 0


def test_backends_fall_back(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id int, input array<double>")

    def broken():
        raise RuntimeError("no device")

    got = {r.vec_id: r for r in O.infer(df, {"gpu": broken, "cpu": lambda: lambda v: v * 2}).collect()}
    assert got[2].output == [6.0, 8.0] and got[1].backend == "cpu" and got[1].error is None
    none = O.infer(df, {"gpu": broken}).first()
    assert none.output is None and none.error.startswith("inference-failed")


def test_retries():
    calls = []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("net")
        return "done"

    assert O.tried(run) == "done" and len(calls) == 3


def test_rules(spark):
    row = spark.range(1).select(O.missing_capability({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}).alias("m"), O.platform(F.lit("iPad")).alias("p"), O.preview_side(F.lit(800), F.lit(600), F.lit(2.0)).alias("s"), O.attribute_keys(F.lit("title:x;alt:y")).alias("k")).first()
    assert (row.m, tuple(row.p), row.s, row.k) == ("b", (True, True), 2560, {"title": "x", "alt": "y"})


def test_graphs(spark):
    assert O.execution_order([("a", "b"), ("b", "c"), ("a", "c")], ["c", "b", "a"]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        O.execution_order([("a", "b"), ("b", "a")], ["a", "b"])
    edges = spark.createDataFrame([("n1", "t", "out"), ("n2", "t", "in"), ("n3", "t", "in")] + [("big", f"x{k}", "in") for k in range(9)], "node string, tensor string, direction string")
    assert sorted((r.producer, r.consumer) for r in O.producers(edges).collect()) == [("n1", "n2"), ("n1", "n3")]
    assert [r.node for r in O.over_buffers(edges).collect()] == ["big"]


def test_tensor_kernels():
    p = np.arange(12.0).reshape(3, 4)
    y, x = np.mgrid[0:3, 0:4].astype(float)
    assert O.deformed(p, x, y, np.ones((3, 4))) == pytest.approx(p)
    assert O.deformed(p, x[:, :3] + 0.5, y[:, :3], np.ones((3, 3))) == pytest.approx((p[:, :3] + p[:, 1:]) / 2)
    assert O.half_floats(np.array([1.5])).dtype == np.float16
    with pytest.raises(ValueError):
        O.half_floats(np.array([70000.0]))
