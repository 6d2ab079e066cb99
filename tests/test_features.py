import hashlib
import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.arrays import flip_and_shift, one_hot, planar_to_interleaved, scale_pixels
from ledgerloom.operators.sampling import split_counts, train_test_split
from ledgerloom.plans.features import append_batches, array_shapes, augment_images, prepare_images
from ledgerloom.sources.files import read_image_batches


def _images(spark, n, size, seed=0):
    data = np.random.default_rng(seed).integers(0, 256, (n, size), dtype=np.uint8)
    rows = [(i, [int(x) for x in row], i % 10) for i, row in enumerate(data)]
    return data, spark.createDataFrame(rows, "id long, pixels array<smallint>, label int")


@pytest.mark.parametrize("shape", [(3, 32, 32), (3, 2, 5), (1, 4, 4)])
def test_prepare_matches_numpy(spark, shape):
    data, df = _images(spark, 7, int(np.prod(shape)))
    prepared = {r["id"]: r for r in prepare_images(df, shape).collect()}
    for i, row in enumerate(data):
        expected = np.transpose(row.reshape(shape), (1, 2, 0)).astype("float32") / np.float32(255)
        assert np.array_equal(np.array(prepared[i]["pixels"], dtype="float32"), expected.ravel())
        assert prepared[i]["label"] == [1.0 if c == i % 10 else 0.0 for c in range(10)]


@pytest.mark.parametrize("flip", [True, False])
@pytest.mark.parametrize("dx, dy", [(0, 0), (2, -1), (-3, 3), (9, 0)])
def test_flip_and_shift_match_numpy(spark, flip, dx, dy):
    channels, height, width = 3, 4, 6
    data, df = _images(spark, 3, channels * height * width)
    moved = flip_and_shift(F.col("pixels"), F.lit(flip), F.lit(dx), F.lit(dy), channels, height, width)
    rows = {r[0]: r[1] for r in df.select("id", moved).collect()}
    for i, row in enumerate(data):
        image = row.reshape(height, width, channels)
        if flip:
            image = image[:, ::-1]
        y = np.clip(np.arange(height) - dy, 0, height - 1)
        x = np.clip(np.arange(width) - dx, 0, width - 1)
        assert rows[i] == image[y][:, x].ravel().tolist()


def test_augmentation_repeats_and_stays_in_range(spark):
    _, df = _images(spark, 200, 3 * 10 * 20)
    columns = ["id", "copy", "flip", "dx", "dy"]
    first = augment_images(df, "id", 5, copies=3, shape=(3, 10, 20), shift=0.1)
    choices = sorted(tuple(r) for r in first.select(columns).collect())
    assert choices == sorted(
        tuple(r) for r in augment_images(df.repartition(7), "id", 5, 3, (3, 10, 20)).select(columns).collect()
    )
    assert len(choices) == 600
    assert {c[2] for c in choices} == {True, False}
    assert {c[3] for c in choices} == {-2, -1, 0, 1, 2}
    assert {c[4] for c in choices} == {-1, 0, 1}


def test_one_hot_and_scaling_edges(spark):
    df = spark.createDataFrame([(0, [0, 255]), (9, []), (12, None), (None, [1])], "label int, pixels array<smallint>")
    rows = df.select(one_hot(F.col("label"), 3), scale_pixels(F.col("pixels"))).collect()
    assert rows[0][0] == [1.0, 0.0, 0.0] and rows[0][1] == [0.0, 1.0]
    assert rows[1][0] == [0.0, 0.0, 0.0] and rows[1][1] == []
    assert rows[2][1] is None
    assert rows[3][0] == [None, None, None]


def test_interleaving_is_a_permutation(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(3 * 8 * 8 - 1)).alias("p"))
    assert sorted(df.select(planar_to_interleaved(F.col("p"), 3, 8, 8)).first()[0]) == list(range(192))


def test_split_by_hash(spark):
    split = train_test_split(spark.range(5000), "id")
    for row in split.collect():
        below = hashlib.md5(f"{row['id']}:42".encode()).hexdigest()[:8] < format(int(0.8 * 16**8), "08x")
        assert row["split"] == ("train" if below else "test")
    counts = {r["split"]: r["rows"] for r in split_counts(split).collect()}
    assert sum(counts.values()) == 5000 and abs(counts["test"] - 1000) < 120
    assert train_test_split(spark.range(50), "id", 0.0).where("split = 'test'").isEmpty()
    assert train_test_split(spark.range(50), "id", 1.0).where("split = 'train'").isEmpty()
    with pytest.raises(ValueError):
        train_test_split(spark.range(1), "id", 1.5)


def test_appended_batches_and_shapes(spark):
    _, df = _images(spark, 10, 48)
    train, test = df.where("id < 7").withColumn("split", F.lit("train")), df.where("id >= 7")
    both = append_batches(train, test.select("label", "pixels", "id", F.lit("test").alias("split")))
    shapes = {r["split"]: tuple(r)[1:] for r in array_shapes(prepare_images(both, (3, 4, 4))).collect()}
    assert shapes == {"train": (7, 48, 48, 10, 10), "test": (3, 48, 48, 10, 10)}


def _pickle(path, value):
    with open(path, "wb") as f:
        pickle.dump(value, f, protocol=2)


def test_pickled_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    batches = {}
    for name, n in (("data_batch_1", 2500), ("data_batch_2", 3), ("test_batch", 4)):
        data = rng.integers(0, 256, (n, 12), dtype=np.uint8)
        batches[name] = (data, [int(x) for x in rng.integers(0, 10, n)])
        _pickle(tmp_path / name, {b"data": data, b"labels": batches[name][1]})
    _pickle(tmp_path / "batches.meta", {b"label_names": [b"x"]})
    read = read_image_batches(spark, str(tmp_path))
    counts = {r["split"]: r["count"] for r in read.groupBy("split").count().collect()}
    assert counts == {"train": 2503, "test": 4}
    for row in read.collect():
        data, labels = batches[os.path.basename(row["path"])]
        assert row["pixels"] == data[row["position"]].tolist()
        assert row["label"] == labels[row["position"]]


class _Call:
    def __reduce__(self):
        return (os.getcwd, ())


def test_batches_with_code_are_refused(spark, tmp_path):
    _pickle(tmp_path / "data_batch_1", {b"data": _Call(), b"labels": []})
    with pytest.raises(Exception, match="is not allowed in an image batch"):
        read_image_batches(spark, str(tmp_path)).collect()
