"""Column expressions on image arrays held as flat arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once per row.

    A column that a lambda refers to may be replaced by the expression it comes
    from, which would then run again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def planar_to_interleaved(pixels: Column, channels: int, height: int, width: int) -> Column:
    """Reorder (channel, row, column) planes to (row, column, channel)."""
    plane = height * width

    def interleaved(planes):
        # Cell i of the result is channel i % channels of pixel i // channels.
        return F.transform(
            F.sequence(F.lit(0), F.lit(channels * plane - 1)),
            lambda i: F.get(planes, ((i % channels) * plane + F.floor(i / channels)).cast("int")),
        )

    return bind(pixels, interleaved)


def scale_pixels(pixels: Column, full: float = 255.0) -> Column:
    """Pixel values 0..full as floats 0..1."""
    return F.transform(pixels, lambda x: (x.cast("double") / F.lit(full)).cast("float"))


def one_hot(label: Column, classes: int) -> Column:
    """An array of `classes` floats, 1 at the label and 0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("float"))


def flip_and_shift(
    pixels: Column, flip: Column, dx: Column, dy: Column, channels: int, height: int, width: int
) -> Column:
    """Mirror an interleaved image left-right where `flip`, then move it by (dx, dy).

    Cells that the move leaves empty take the nearest edge value.
    """

    def moved(given):
        def source(i):
            row = F.floor(i / (width * channels)).cast("int")
            column = F.floor(i / channels).cast("int") % width
            from_row = F.least(F.greatest(row - given["dy"], F.lit(0)), F.lit(height - 1))
            from_column = F.least(F.greatest(column - given["dx"], F.lit(0)), F.lit(width - 1))
            from_column = F.when(given["flip"], F.lit(width - 1) - from_column).otherwise(from_column)
            return F.get(given["pixels"], (from_row * width + from_column) * channels + i % channels)

        return F.transform(F.sequence(F.lit(0), F.lit(channels * height * width - 1)), source)

    given = F.struct(pixels.alias("pixels"), flip.alias("flip"), dx.alias("dx"), dy.alias("dy"))
    return bind(given, moved)


def softmax(scores: Column) -> Column:
    """Scores of the classes as probabilities."""

    def powers(top):
        return F.transform(scores, lambda s: F.exp(s - top))

    def shares(terms):
        total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
        return bind(total, lambda whole: F.transform(terms, lambda p: p / whole))

    return bind(bind(F.array_max(scores), powers), shares)


def parse_matrix(body: Column) -> Column:
    """The matrix of a JSON body {"data": [[...], ...]}; NULL for a malformed body."""
    return F.from_json(body, "struct<data:array<array<double>>>")["data"]
