"""Image labels: thresholds, best labels per image, the keyed label table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import latest_per_key, top_k_per_group

# Limits of the stored table and of the interactive listing.
TABLE_LABELS, TABLE_CONFIDENCE = 5, 96.0
LISTING_LABELS, LISTING_CONFIDENCE = 10, 95.0

LABELS_TYPE = "array<struct<name:string,confidence:double>>"
KEYS = ("image_id", "tag")


def best_labels(labels: Column, max_labels: int, min_confidence: float) -> Column:
    """The surest labels of one detector response, an array of (name, confidence)."""
    sure = F.filter(labels, lambda x: x["confidence"] >= min_confidence)
    ranked = F.array_sort(
        F.transform(sure, lambda x: F.struct((-x["confidence"]).alias("minus"), x["name"].alias("name")))
    )
    kept = F.slice(ranked, 1, max_labels)
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("confidence")))


def label_listing(
    responses: DataFrame, max_labels: int = LISTING_LABELS, min_confidence: float = LISTING_CONFIDENCE
) -> DataFrame:
    """(image_id, rank, name, confidence) of the best labels of each response.

    `responses` has image_id and labels; an image without labels gives no rows.
    """
    best = best_labels(F.col("labels"), max_labels, min_confidence)
    return responses.select("image_id", F.posexplode(best).alias("_rank", "_label")).select(
        "image_id",
        (F.col("_rank") + 1).alias("rank"),
        F.col("_label.name").alias("name"),
        F.col("_label.confidence").alias("confidence"),
    )


def label_items(
    labels: DataFrame, max_labels: int = TABLE_LABELS, min_confidence: float = TABLE_CONFIDENCE
) -> DataFrame:
    """The items to store from label rows (image_id, response, tag, confidence, seq).

    Keeps the surest labels of each response of an image, with the confidence
    as decimal. For responses that arrive whole; `streaming.label_state` takes
    those that come in pieces.
    """
    sure = labels.where(F.col("confidence") >= min_confidence)
    order = [F.col("confidence").desc_nulls_last(), F.col("tag").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    best = top_k_per_group(sure, max_labels, ["image_id", "response"], order, ["confidence", "tag", "seq"])
    return best.select("image_id", "tag", F.col("confidence").cast("decimal(38,18)").alias("conf"), "seq")


def label_table(
    labels: DataFrame, max_labels: int = TABLE_LABELS, min_confidence: float = TABLE_CONFIDENCE
) -> DataFrame:
    """The stored table: one row per (image_id, tag), the last one written."""
    return latest_per_key(label_items(labels, max_labels, min_confidence), KEYS, ["seq"])


def response_items(
    responses: DataFrame, max_labels: int = TABLE_LABELS, min_confidence: float = TABLE_CONFIDENCE
) -> DataFrame:
    """As label_items for detector responses (image_id, labels, seq)."""
    best = best_labels(F.col("labels"), max_labels, min_confidence)
    return responses.select("image_id", F.explode(best).alias("_label"), "seq").select(
        "image_id",
        F.col("_label.name").alias("tag"),
        F.col("_label.confidence").cast("decimal(38,18)").alias("conf"),
        "seq",
    )
