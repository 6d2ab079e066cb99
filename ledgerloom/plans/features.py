"""Image arrays and feature matrices, made ready for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.arrays import flip_and_shift, one_hot, planar_to_interleaved, scale_pixels
from ledgerloom.functions.hashing import hash_pick, keyed_hash

IMAGE_SHAPE = (3, 32, 32)
CLASSES = 10


def prepare_images(
    images: DataFrame, shape: tuple[int, int, int] = IMAGE_SHAPE, classes: int = CLASSES
) -> DataFrame:
    """Planar 0..255 `pixels` to interleaved floats 0..1, `label` to one-hot.

    `shape` is (channels, height, width). Other columns stay.
    """
    return images.withColumns(
        {
            "pixels": scale_pixels(planar_to_interleaved(F.col("pixels"), *shape)),
            "label": one_hot(F.col("label"), classes),
        }
    )


def array_shapes(images: DataFrame) -> DataFrame:
    """Per split: rows, and the least and greatest length of pixels and label."""
    sizes = {c: F.size(c) for c in ("pixels", "label")}
    return images.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(size).alias(f"{f.__name__}_{c}") for c, size in sizes.items() for f in (F.min, F.max)],
    )


def append_batches(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of all batches, matched by column name."""
    for batch in more:
        first = first.unionByName(batch)
    return first


def augment_images(
    images: DataFrame,
    key: str,
    seed: int,
    copies: int = 1,
    shape: tuple[int, int, int] = IMAGE_SHAPE,
    shift: float = 0.1,
) -> DataFrame:
    """`copies` variants of each interleaved image: mirrored or not, moved by whole pixels.

    The moves go up to the fraction `shift` of each side. The choices come from
    a hash of key, seed and copy, so they repeat. Adds copy, flip, dx and dy.
    """
    channels, height, width = shape
    most_x, most_y = int(width * shift), int(height * shift)
    variants = images.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    choice = keyed_hash(F.col(key), seed, F.col("copy"))
    variants = variants.withColumns(
        {
            "flip": hash_pick(choice, 0, 2) == 1,
            "dx": hash_pick(choice, 8, 2 * most_x + 1) - most_x,
            "dy": hash_pick(choice, 16, 2 * most_y + 1) - most_y,
        }
    )
    moved = flip_and_shift(F.col("pixels"), F.col("flip"), F.col("dx"), F.col("dy"), channels, height, width)
    return variants.withColumn("pixels", moved)
