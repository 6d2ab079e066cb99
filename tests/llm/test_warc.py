import collections
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc
from ledgerloom.llm.storage import file_system, work_dir

PAGES = "page_id bigint, url string, html string, shard string, start int"


def _pages(spark, n=120):
    rng = random.Random(n)
    rows = [(i, f"http://a.example/{i}", "<p>" + "x y " * rng.randrange(200) + f"{i}</p>", "z", 1) for i in range(n)]
    rows += [(None, None, None, None, None), (5, "u\r\nv", "", "z", 2), (5, "u", "é\x00\U0001f600", "z", 3)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.fixture(scope="module")
def written(spark):
    folder = work_dir(spark, "test-warc")
    return folder, warc.write_warc(_pages(spark), folder, shard_bytes=4000)


def test_records_come_back(spark, written):
    folder, index = written
    found = warc.read_warc(folder, index).collect()
    wanted = collections.Counter((r["page_id"], (r["html"] or "").encode()) for r in _pages(spark).collect())
    assert collections.Counter((r["page_id"], bytes(r["payload"])) for r in found) == wanted
    assert {r["url"] for r in found if r["page_id"] == 7} == {"http://a.example/7"}
    assert index.select("shard").distinct().count() > 3


def test_files_are_plain_warc(written):
    folder, index = written
    system, root = file_system(folder)
    for row in index.limit(5).collect():
        data = gzip.decompress(system.open_input_file(f"{root}/{row['path']}").read_at(row["end"] - row["start"], row["start"]))
        fields, payload = warc.parse_record(data)
        assert data.startswith(b"WARC/1.0\r\nWARC-Type: resource\r\n") and data.endswith(b"\r\n\r\n")
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()


def _differing(folder, other, index):
    """Brute force: records whose stored bytes differ."""
    (a, x), (b, y) = file_system(folder), file_system(other)
    found = set()
    for r in index.collect():
        there = b.get_file_info(f"{y}/{r['path']}").is_file
        one, two = ((s.open_input_file(f"{p}/{r['path']}").read() if ok else b"") for s, p, ok in ((a, x, True), (b, y, there)))
        if len(two) < r["end"] or one[r["start"] : r["end"]] != two[r["start"] : r["end"]]:
            found.add((r["shard"], r["seq"]))
    return found


def _audit(folder, other, index):
    rows = warc.audit(warc.merkle_tree(index, folder), warc.merkle_tree(index, other)).collect()
    return {(r["shard"], r["seq"]) for r in rows}


def test_audit_finds_what_was_damaged(spark, written, monkeypatch):
    monkeypatch.setattr(warc, "FANOUT", 4)
    folder, index = written
    copy = work_dir(spark, "test-copy")
    warc.copy_shards(index, folder, copy, F.col("page_id").isin(3, 5, 77))
    found = _audit(folder, copy, index)
    assert found == _differing(folder, copy, index) and len(found) == 5
    good = work_dir(spark, "test-copy")
    assert warc.copy_shards(index, folder, good).count() == index.select("shard").distinct().count()
    assert _audit(folder, good, index) == set()


def test_short_and_missing_files(spark, written):
    folder, index = written
    copy = work_dir(spark, "test-copy")
    warc.copy_shards(index, folder, copy)
    _, root = file_system(copy)
    files = sorted(f for f in os.listdir(root) if f.endswith(".gz"))
    with open(f"{root}/{files[0]}", "r+b") as f:
        f.truncate(os.path.getsize(f.name) // 2)
    os.remove(f"{root}/{files[1]}")
    assert _audit(folder, copy, index) == _differing(folder, copy, index)
    assert warc.read_warc(copy, index).where("payload is null").count() == len(_differing(folder, copy, index))


def test_one_shard_and_none(spark):
    folder, copy = work_dir(spark, "test-one"), work_dir(spark, "test-copy")
    index = warc.write_warc(_pages(spark, 6).coalesce(1), folder)
    warc.copy_shards(index, folder, copy, F.col("page_id") == 2)
    assert _audit(folder, copy, index) == _differing(folder, copy, index)
    empty = work_dir(spark, "test-none")
    none = warc.write_warc(_pages(spark).where("false"), empty)
    assert none.count() == 0 and _audit(empty, empty, none) == set()
    assert warc.read_warc(empty, none).count() == 0
