import json
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.labels import KEYS, label_items, label_table, response_items
from ledgerloom.session import ship_package
from ledgerloom.streaming.keyed_table import ConcurrentWriteError, KeyedTable, upsert_stream
from ledgerloom.streaming.label_state import current_labels, label_changes, label_state_table, label_stream

ITEM = "image_id string, tag string, conf double, seq long"


def _items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def _table(tmp_path, **options):
    return KeyedTable(str(tmp_path / "table"), KEYS, "seq", **{"buckets": 4, **options})


def _rows(spark, table, version=None):
    return sorted((tuple(r) for r in table.rows(spark, version).collect()), key=str)


def _folders(tmp_path):
    """The bucket folders of every run that is there."""
    rows = tmp_path / "table" / "rows"
    return {run: {n for n in os.listdir(rows / run) if n.startswith("bucket=")} for run in os.listdir(rows)}


def test_last_write_wins_within_and_across_batches(spark, tmp_path):
    table = _table(tmp_path)
    table.put(_items(spark, ("i", "cat", 97.0, 1), ("i", "cat", 96.5, 3), ("i", "dog", 99.0, 2)), 0)
    # A later batch wins, even with a smaller sequence number.
    second = _items(spark, ("i", "cat", 98.0, 0), ("j", "cat", 96.0, 4))
    made = table.put(second, 1)
    # The repeat of a batch after a failure counts once.
    assert table.put(second, 1) == made == table.version(spark)
    expected = [("i", "cat", 98.0, 0), ("i", "dog", 99.0, 2), ("j", "cat", 96.0, 4)]
    assert _rows(spark, table) == expected
    for _ in range(2):  # a merge that is repeated changes nothing
        merged = table.merge(spark)
        assert _rows(spark, table) == expected and all(len(runs) == 1 for runs in merged.runs.values())
    table.put(_items(spark, ("j", "cat", 99.5, 0)), 2)
    assert ("j", "cat", 99.5, 0) in _rows(spark, table)


def test_many_batches_against_a_dictionary(spark, tmp_path):
    rng, table, expected = random.Random(1), _table(tmp_path, fan=3, kept_versions=2), {}
    for batch in range(12):
        rows = [
            (rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), float(batch), rng.randrange(50)) for _ in range(rng.randrange(1, 6))
        ]
        table.put(_items(spark, *rows), batch)
        newest = {}
        for image, tag, conf, seq in sorted(rows, key=lambda r: r[3]):
            newest[image, tag] = (image, tag, conf, seq)
        expected.update(newest)
        assert _rows(spark, table) == sorted(expected.values(), key=str)
        levels = [r.level for runs in table.version(spark).runs.values() for r in runs]
        assert max(levels.count(n) for n in set(levels)) <= 3 * 4
    for runs in table.version(spark).runs.values():
        assert all(sum(r.level == level for r in runs) < 3 for level in range(5))
    table.vacuum(spark)
    assert _rows(spark, table) == sorted(expected.values(), key=str)


def test_merges_touch_only_changed_buckets(spark, tmp_path):
    table = _table(tmp_path, buckets=8, fan=3)
    first = table.put(_items(spark, *((f"i{n}", "t", 1.0, n) for n in range(60))), 0)
    assert set(first.runs) == set(range(8))
    one = ("i7", "t")
    (bucket,) = {r[0] for r in _items(spark, (*one, 0.0, 0)).select(table.bucket()).collect()}
    for batch in (1, 2, 3):
        version = table.put(_items(spark, (*one, 2.0, batch)), batch)
    assert all(version.runs[b] == first.runs[b] for b in range(8) if b != bucket)
    assert [r.level for r in version.runs[bucket]] == [1, 0]
    merged = [run for run, buckets in _folders(tmp_path).items() if run not in first.names()]
    assert all(_folders(tmp_path)[run] == {f"bucket={bucket}"} for run in merged)
    assert sum(r[3] for r in _rows(spark, table)) == sum(range(60)) - 7 + 3


def test_a_reader_sees_one_version_while_others_are_made(spark, tmp_path):
    table = _table(tmp_path, fan=2)
    old = table.put(_items(spark, *((f"i{n}", "t", 1.0, n) for n in range(20))), 0)
    reader = table.rows(spark, old)
    for batch in (1, 2, 3):
        table.put(_items(spark, *((f"i{n}", "t", 2.0, 100 * batch + n) for n in range(20))), batch)
    table.vacuum(spark)
    assert {r["conf"] for r in reader.collect()} == {1.0} and {r[2] for r in _rows(spark, table)} == {2.0}


def test_what_old_versions_held_is_removed(spark, tmp_path):
    table = _table(tmp_path, fan=2, kept_versions=1)
    for batch in range(5):
        version = table.put(_items(spark, ("i", "t", float(batch), batch)), batch)
    before = _rows(spark, table)
    gone = table.vacuum(spark)
    assert gone and set(_folders(tmp_path)) == version.names() and table.vacuum(spark) == []
    assert _rows(spark, table) == before == [("i", "t", 4.0, 4)]
    assert len([n for n in os.listdir(tmp_path / "table" / "versions") if not n.startswith(".")]) == 1


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    table = _table(tmp_path)
    before = table.put(_items(spark, ("i", "t", 1.0, 1)), 0)
    table.put(_items(spark, ("i", "t", 2.0, 2)), 1)
    monkeypatch.setattr(KeyedTable, "version", lambda self, spark: before)  # it read before the other had written
    with pytest.raises(ConcurrentWriteError):
        table.put(_items(spark, ("i", "t", 3.0, 3)), 1)
    monkeypatch.undo()
    assert _rows(spark, table) == [("i", "t", 2.0, 2)]
    assert len(os.listdir(tmp_path / "table" / "versions")) <= 4  # two files and their checksums


def test_a_write_that_fails_leaves_the_version(spark, tmp_path, monkeypatch):
    table = _table(tmp_path)
    table.put(_items(spark, ("i", "t", 1.0, 1)), 0)
    monkeypatch.setattr(KeyedTable, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.put(_items(spark, ("i", "t", 2.0, 2)), 1)
    monkeypatch.undo()
    assert _rows(spark, table) == [("i", "t", 1.0, 1)]
    table.put(_items(spark, ("i", "t", 2.0, 2)), 1)
    assert len(table.vacuum(spark)) == 1 and _rows(spark, table) == [("i", "t", 2.0, 2)]


def test_columns_may_be_added_but_not_retyped(spark, tmp_path):
    table = _table(tmp_path)
    table.put(_items(spark, ("i", "t", 1.0, 1)), 0)
    table.put(_items(spark, ("j", "t", 1.0, 1)).withColumn("more", F.lit(5)), 1)
    assert sorted((r["image_id"], r["more"]) for r in table.rows(spark).collect()) == [("i", None), ("j", 5)]
    with pytest.raises(ValueError, match="conf"):
        table.put(_items(spark, ("j", "t", 1.0, 1)).withColumn("conf", F.lit("x")), 2)


def test_empty_batches_and_an_empty_table(spark, tmp_path):
    table = _table(tmp_path)
    with pytest.raises(ValueError):
        table.rows(spark)
    table.put(_items(spark).where("false"), 0)
    assert _rows(spark, table) == [] and table.version(spark).last_batch == 0
    table.put(_items(spark, ("i", "t", 1.0, 1)), 1)
    assert len(_rows(spark, table)) == 1


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    table = _table(tmp_path, buckets=16)
    table.put(_items(spark, *((f"i{n}", None if n % 2 else "t", 1.0, n) for n in range(100))), 0)
    wanted = spark.createDataFrame([("i7", None), ("i7", None), ("i8", "no")], "image_id string, tag string")
    found = table.lookup(wanted)
    assert [(r["image_id"], r["seq"]) for r in found.collect()] == [("i7", 7)]
    assert len({path.rsplit("/", 2)[1] for path in found.inputFiles()}) <= 2
    plan = table.rows(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # one run per bucket: nothing to resolve


def _arrivals(spark, source, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_streams_merge_and_clean_up(spark, tmp_path):
    source = str(tmp_path / "events")
    for i in range(5):
        _items(spark, ("i", f"t{i % 2}", 90.0 + i, i)).coalesce(1).write.mode("append").parquet(source)
    table = _table(tmp_path, fan=2, kept_versions=2)
    upsert_stream(_arrivals(spark, source, ITEM), table, str(tmp_path / "c")).awaitTermination()
    assert [(r[1], r[3]) for r in _rows(spark, table)] == [("t0", 4), ("t1", 3)]
    assert max(r.level for runs in table.version(spark).runs.values() for r in runs) >= 1
    assert set(_folders(tmp_path)) >= table.version(spark).names() and len(_folders(tmp_path)) <= 8


LABEL = "image_id string, response long, tag string, confidence double, seq long"


def test_label_stream(spark, tmp_path):
    source, table = str(tmp_path / "events"), _table(tmp_path)

    def run():
        upsert_stream(_arrivals(spark, source, LABEL), table, str(tmp_path / "c"), label_items).awaitTermination()
        return sorted((r["image_id"], r["tag"], r["conf"]) for r in table.rows(spark).collect())

    spark.createDataFrame([("i", 1, "cat", 97.0, 1), ("i", 1, "low", 95.9, 2)], LABEL).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("i", "cat", Decimal("97"))]
    spark.createDataFrame([("i", 2, "cat", 96.0, 3), ("k", 2, "sky", 100.0, 4)], LABEL).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("i", "cat", Decimal("96")), ("k", "sky", Decimal("100"))]


def test_responses_stream_without_a_batch_step(spark, tmp_path):
    source, table = str(tmp_path / "responses"), _table(tmp_path)
    schema = "image_id string, labels array<struct<name:string,confidence:double>>, seq long"
    spark.createDataFrame([("i", [("a", 99.0), ("b", 50.0)], 1), ("j", None, 2)], schema).write.parquet(source)
    upsert_stream(response_items(_arrivals(spark, source, schema)), table, str(tmp_path / "c")).awaitTermination()
    assert [(r["image_id"], r["tag"]) for r in table.rows(spark).collect()] == [("i", "a")]


@pytest.mark.parametrize("seed", range(2))
def test_responses_in_pieces_give_the_batch_table(spark, tmp_path, seed):
    """Responses cut over three batches; a later piece pushes labels out, and an image's older label comes back."""
    ship_package(spark)
    rng = random.Random(seed)
    data = [
        (rng.choice(["a", "b", None]), rng.randrange(3), rng.choice(["t1", "t2", "t3", "t4", None]), rng.choice([95.0, 96.0, 97.5, 98.0, 99.0, None]), seq)
        for seq in range(150)
    ]
    source, expected = str(tmp_path / "events"), spark.createDataFrame(data, LABEL)
    table = label_state_table(str(tmp_path / "table"), buckets=3, fan=2)
    rng.shuffle(data)
    for i in range(3):
        spark.createDataFrame(data[i::3], LABEL).coalesce(1).write.mode("append").parquet(source)
        label_stream(_arrivals(spark, source, LABEL), table, str(tmp_path / "c"), max_labels=3).awaitTermination()
    assert table.version(spark).last_batch >= 2
    found, wanted = (sorted(map(tuple, d.collect()), key=str) for d in (current_labels(spark, table), label_table(expected, max_labels=3)))
    assert found == wanted
    held = [json.loads(r[0]) for r in table.rows(spark).select(F.to_json(F.struct("gone"))).collect()]
    assert any(r["gone"] for r in held)


def test_only_sure_rows_reach_the_state(spark, tmp_path):
    """A row below the limit, without one or with NaN goes before the shuffle to the state, not in it."""
    source = str(tmp_path / "events")
    rows = [("i", 1, "cat", 97.0, 1), ("i", 2, "low", 95.9, 2), ("j", 1, "none", None, 3), ("k", 1, "nan", float("nan"), 4)]
    spark.createDataFrame(rows, LABEL).write.parquet(source)
    changes = label_changes(_arrivals(spark, source, LABEL))
    plan = changes._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "Filter" in plan.split("TransformWithState", 1)[1]
    below = plan.split("Filter", 1)[1].split("\n", 1)[0]
    assert "96.0" in below and "isnan" in below
    ship_package(spark)
    table = label_state_table(str(tmp_path / "table"), buckets=3)
    label_stream(_arrivals(spark, source, LABEL), table, str(tmp_path / "c")).awaitTermination()
    assert [(r["image_id"], r["tag"]) for r in current_labels(spark, table).collect()] == [("i", "cat")]
