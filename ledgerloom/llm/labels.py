"""Labels of documents and the part of them that models may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept for tests: crc32 of its id as text leaves no remainder.

    A null doc_id counts as the empty text, whose crc32 is 0.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows to learn from, one row per document.

    Held-out documents, null ids and labels other than 0 and 1 are left out; of
    several labels of one document the smallest counts.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def label_sample(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label to learn from, chosen by a hash of the id.

    All rows if there are fewer. The share follows from two counts, so no rows
    are ranked or gathered. So few ids are marked for broadcast: about
    2 * per_label rows, one per document, at any size of the tables.
    """
    known = learnable(labels, label)
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30))
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = wanted | ((F.col("label") == value) & (place < int((1 << 30) * min(1.0, per_label / n))))
    return F.broadcast(known.where(wanted))
