"""Array files: round trip, whole files from elsewhere, nothing left of a failed job."""

import os

import numpy as np
import pytest

from brindle.sources.arrays import read_arrays, shared_path, write_arrays


def pixels(spark, images):
    rows = [(n, y, x, int(a[y, x]), "extra") for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y long, x long, label long, value string")


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {"a": rng.integers(0, 9, (70, 5)), "b/ c@2%": rng.integers(-3, 3, (3, 40)), "one": np.array([[7]])}
    path = f"file://{tmp_path}/x"
    write_arrays(pixels(spark, images), path, "label", band=16)
    assert len([f for f in os.listdir(tmp_path / "x") if f.endswith(".npy")]) == 5 + 1 + 1
    assert not [f for f in os.listdir(tmp_path / "x") if f.startswith("_")]
    got = {(r.image_id, r.y, r.x): r.value for r in read_arrays(spark, path).collect()}
    assert got == {(n, y, x): a[y, x] for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])}
    write_arrays(pixels(spark, {"one": np.array([[8]])}), path, "label", band=16)
    assert [r.value for r in read_arrays(spark, path).where("image_id = 'one'").collect()] == [8]


def test_files_from_elsewhere(spark, tmp_path):
    np.save(tmp_path / "whole.npy", np.arange(600, dtype=np.float32).reshape(200, 3) / 4)
    got = read_arrays(spark, str(tmp_path), "double").collect()
    assert {(r.image_id, r.y, r.x, r.value) for r in got} == {("whole", i // 3, i % 3, i / 4) for i in range(600)}
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="dimensions"):
        read_arrays(spark, str(tmp_path), "double").collect()


def test_failed_job_leaves_nothing(spark, tmp_path):
    gap = pixels(spark, {"a": np.ones((4, 4), int)}).where("y <> 2 OR x <> 1")
    with pytest.raises(Exception, match="gaps"):
        write_arrays(gap, f"{tmp_path}/y", "label")
    assert os.listdir(tmp_path / "y") == []
    with pytest.raises(ValueError, match="mounted"):
        shared_path("s3://bucket/x")
