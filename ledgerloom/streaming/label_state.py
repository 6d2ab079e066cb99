"""Labels whose responses arrive in pieces: the best of each response, kept as state.

What a new piece pushes out of a response's best labels is taken back, so the
table is the one that the whole responses give, however they were cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators.ranking import latest_per_key
from ledgerloom.plans.labels import KEYS, TABLE_CONFIDENCE, TABLE_LABELS
from ledgerloom.streaming.keyed_table import KeyedTable, upsert_stream

# The process on the driver that prepares stateful processors gets no shipped packages: send the code itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What names one label of a response; it changes once in a batch at most.
ITEM_KEYS = ("image_id", "response", "tag", "seq", "confidence")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_CHANGE = Row("image_id", "response", "tag", "confidence", "seq", "gone")


def _order(label: tuple) -> tuple:
    """Surest first, then by tag and seq; nulls last."""
    tag, confidence, seq = label
    return -confidence, tag is None, tag or "", seq is None, seq or 0


class BestLabels(StatefulProcessor):
    """The surest labels of each (image_id, response); gives the labels that come in and those that go out."""

    def __init__(self, labels: int, confidence: float, ttl_ms: int | None):
        self.labels, self.confidence, self.ttl_ms = labels, confidence, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "tags array<string>, confidences array<double>, seqs array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.best.get()  # None for a response that has no state; asking first is a round trip more
        before = list(zip(*held)) if held else []
        best = list(before)
        for row in rows:
            if row["confidence"] is not None and row["confidence"] >= self.confidence:
                best.append((row["tag"], row["confidence"], row["seq"]))
                if len(best) > 4 * self.labels:
                    best = sorted(best, key=_order)[: self.labels]
        best = sorted(best, key=_order)[: self.labels]
        if best == before:
            return
        self.best.update(tuple(map(list, zip(*best))))
        for label in before:
            if label not in best:
                yield _CHANGE(*key, *label, True)
        for label in best:
            if label not in before:
                yield _CHANGE(*key, *label, False)

    def close(self) -> None:
        pass


def label_changes(
    labels: DataFrame, max_labels: int = TABLE_LABELS, min_confidence: float = TABLE_CONFIDENCE, ttl_ms: int | None = None
) -> DataFrame:
    """Label rows (image_id, response, tag, confidence, seq) of a stream to changes of the stored items.

    The rows of a response may come in any number of batches. `gone` marks an
    item that better ones have replaced. State is at most `max_labels` labels per
    response; with `ttl_ms` it goes when a response has had no change for so
    long, and later pieces count as a response of their own. Rows that are not
    sure enough change nothing, so they are dropped before the shuffle: a
    response without others never reaches the state.
    """
    keyed = labels.select("image_id", "response", F.col("tag").cast("string"), F.col("confidence").cast("double"), F.col("seq").cast("bigint"))
    sure = (F.col("confidence") >= min_confidence) & ~F.isnan("confidence")
    keyed = keyed.where(sure)
    output = T.StructType([*keyed.schema.fields, T.StructField("gone", T.BooleanType())])
    processor = BestLabels(max_labels, min_confidence, ttl_ms)
    time_mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("image_id", "response").transformWithState(processor, output, "Update", time_mode)


def label_state_table(path: str, **options) -> KeyedTable:
    """The table of items that `label_stream` keeps, with those taken back marked as gone."""
    return KeyedTable(path, ITEM_KEYS, "gone", **options)


def label_stream(labels: DataFrame, table: KeyedTable, checkpoint: str, **options) -> StreamingQuery:
    """Put all label rows that have arrived into the table and stop.

    The state lies in RocksDB below the checkpoint, as stateful processors need.
    """
    spark = labels.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return upsert_stream(label_changes(labels, **options), table, checkpoint, output_mode="update")
    finally:  # a stream keeps the settings it was started with
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def current_labels(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """The label table: one row per (image_id, tag), the last one written, as `label_table` gives it."""
    held = table.rows(spark).where(~F.col("gone"))
    items = held.select("image_id", "tag", F.col("confidence").cast("decimal(38,18)").alias("conf"), "seq")
    return latest_per_key(items, KEYS, ["seq"])
