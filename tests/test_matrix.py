"""Matrix files: round trips, parts, errors, and lines beside them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.sources import matrix as M


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">f8", "<i4", "|u1"])
def test_round_trip(spark, tmp_path, kind):
    x = (np.arange(60).reshape(12, 5) * 3 % 41).astype(kind)
    np.save(tmp_path / "x.npy", x)
    df = M.matrix(spark, str(tmp_path / "x.npy"), part_bytes=3 * 5 * x.itemsize)
    assert df.rdd.getNumPartitions() == 4
    assert [(r.row, list(r["values"])) for r in df.orderBy("row").collect()] == [(i, row.astype(float).tolist()) for i, row in enumerate(x)]


def test_vectors_and_empty(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.array([1.5, 2.5]))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert [list(r["values"]) for r in M.matrix(spark, f"file://{tmp_path}/v.npy").orderBy("row").collect()] == [[1.5], [2.5]]
    assert M.matrix(spark, str(tmp_path / "none.npy")).count() == 0


def test_errors(tmp_path):
    np.save(tmp_path / "three.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.zeros((2, 3))))
    (tmp_path / "text.npy").write_text("no matrix at all")
    for name in ("three", "turned", "text"):
        with pytest.raises(ValueError):
            M.header(str(tmp_path / f"{name}.npy"))


def test_lines_beside_a_matrix(spark, tmp_path):
    texts = [f"text {i} " + "x" * (i % 50) for i in range(500)]
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in texts))
    np.save(tmp_path / "x.npy", np.arange(1000.0).reshape(500, 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = M.numbered(spark.read.schema("text string").json(str(tmp_path / "rows.jsonl")))
        assert lines.select(F.spark_partition_id()).distinct().count() > 2
        both = M.aligned(lines, M.matrix(spark, str(tmp_path / "x.npy"))).orderBy("row").collect()
        assert [(r.text, list(r["values"])) for r in both] == [(t, [2.0 * i, 2.0 * i + 1]) for i, t in enumerate(texts)]
        with pytest.raises(ValueError):
            M.aligned(lines.limit(499), M.matrix(spark, str(tmp_path / "x.npy")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
