"""WARC shards of web pages, and a Merkle audit of their replicas.

A shard holds one gzip member per record. Its tree hashes the stored bytes of
each record as leaves and, above them, the offset range and the hashes of
FANOUT ordered children; the shards' roots are the leaves of a tree over all
shards. Two replicas agree if their roots do; where they do not, only branches
that differ are followed down to the records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import file_system, saved, work_dir

FANOUT = 64
SHARD_BYTES = 64 << 20
# Tree levels inside a shard, and the records that so many levels hold.
SHARD_LEVELS = 3
SHARD_RECORDS = FANOUT**SHARD_LEVELS
# Payload bytes that a task holds at a time.
_HELD = 16 << 20
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "shard bigint, path string, seq bigint, page_id bigint, start bigint, end bigint"
_INDEX_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("path", pa.string()), *((n, pa.int64()) for n in ("seq", "page_id", "start", "end"))]
)


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """A WARC resource record. A null url has no target line, a null page_id no id line."""
    digest = hashlib.sha256(payload).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.0",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header lines and the payload of a record."""
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, body[: int(fields["Content-Length"])]


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        task, part = TaskContext.get().partitionId(), 0
        out = draft = name = None
        at, rows = 0, []

        def close():
            nonlocal out, part, at, rows
            out.close()
            system.move(draft, f"{root}/{name}")  # a task that runs again replaces its files whole
            found = pa.RecordBatch.from_pylist(rows, _INDEX_SCHEMA)
            out, part, at, rows = None, part + 1, 0, []
            return found

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                if out is None:
                    name = f"pages-{task:06d}-{part:05d}.warc.gz"
                    draft = f"{root}/{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft, compression=None)
                stored = _member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "replace")))
                out.write(stored)
                shard = (task << 20) + part
                rows.append(dict(zip(_INDEX_SCHEMA.names, (shard, name, len(rows), page_id.as_py(), at, at + len(stored)), strict=True)))
                at += len(stored)
                if at >= shard_bytes or len(rows) == SHARD_RECORDS:
                    yield close()
        if out is not None:
            yield close()

    return write


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write page_id, url and html to WARC shards in `folder`; returns the saved index of records.

    The index has shard, path, seq (place in the shard), page_id and the offset
    range start to end of the stored bytes. Each task writes its rows where they
    are, without a shuffle, and starts a new shard after `shard_bytes` or
    SHARD_RECORDS. A null
    html is an empty payload; rows of one page_id are all written; no rows
    write no shards. Other columns are not read.
    """
    narrow = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    written = saved(narrow.mapInArrow(_writer(folder, shard_bytes), _INDEX), "warc-written")
    # Shards are numbered without gaps; one row per shard goes through one task.
    place = F.row_number().over(Window.orderBy("shard")) - 1
    numbers = written.select("shard").distinct().withColumn("number", place.cast("bigint"))
    numbered = written.join(numbers, "shard").withColumn("shard", F.col("number"))
    return saved(numbered.select(*_INDEX_SCHEMA.names), "warc-index")


def _shards(index: DataFrame) -> DataFrame:
    """The index with the records of a shard together and in order."""
    return index.repartition("shard").sortWithinPartitions("shard", "seq")


class _Open:
    """The shard file that is being read."""

    def __init__(self, folder: str):
        self.system, self.root = file_system(folder)
        self.path, self.file, self.size = None, None, 0

    def read(self, path: str, start: int, end: int) -> bytes | None:
        """The bytes of a range; None if the file or a part of the range is missing."""
        if path != self.path:
            self.path, where = path, f"{self.root}/{path}"
            there = self.system.get_file_info(where).is_file
            self.file = self.system.open_input_file(where) if there else None
            self.size = self.file.size() if there else 0
        return self.file.read_at(end - start, start) if end <= self.size else None


def read_warc(folder: str, index: DataFrame) -> DataFrame:
    """shard, seq, page_id, url, payload (binary) of every record, from the files; null if unreadable."""
    names = pa.schema([(n, pa.int64()) for n in ("shard", "seq", "page_id")] + [("url", pa.string()), ("payload", pa.binary())])

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.types, strict=True)], schema=names
        )

    def read(batches):
        shard = _Open(folder)
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                try:
                    fields, payload = parse_record(zlib.decompress(shard.read(row["path"], row["start"], row["end"]), 31))
                except (TypeError, ValueError, KeyError, zlib.error):
                    fields, payload = {}, None
                rows.append((row["shard"], row["seq"], row["page_id"], fields.get("WARC-Target-URI"), payload))
                held += len(payload or b"")
                if held >= _HELD:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return _shards(index).mapInArrow(read, "shard bigint, seq bigint, page_id bigint, url string, payload binary")


def copy_shards(index: DataFrame, source: str, target: str, damaged: Column | None = None) -> DataFrame:
    """Copy the shards to another folder; returns the saved (path) of each shard copied.

    For tests and drills, records for which `damaged` holds get the bits of
    their middle byte turned over in the copy.
    """
    marked = _shards(index.withColumn("damaged", F.coalesce(damaged, F.lit(False)) if damaged is not None else F.lit(False)))

    def copy(batches):
        shard, (system, root) = _Open(source), file_system(target)
        system.create_dir(root, recursive=True)
        path = out = draft = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if out is not None:
                        out.close()
                        system.move(draft, f"{root}/{path}")
                        yield pa.RecordBatch.from_pydict({"path": [path]})
                    path, draft = row["path"], f"{root}/{row['path']}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft, compression=None)
                data = bytearray(shard.read(path, row["start"], row["end"]))
                if row["damaged"]:
                    data[len(data) // 2] ^= 0xFF
                out.write(bytes(data))
        if out is not None:
            out.close()
            system.move(draft, f"{root}/{path}")
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return saved(marked.mapInArrow(copy, "path string"), "copied-shards")


def _parent(children: list[tuple[int, int, bytes]]) -> tuple[int, int, bytes]:
    start, end = children[0][0], children[-1][1]
    return start, end, hashlib.sha256(b"\x01%d-%d" % (start, end) + b"".join(c[2] for c in children)).digest()


_NODES = "shard bigint, level int, place bigint, start bigint, end bigint, hash binary"
_NODE_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("level", pa.int32()), *((n, pa.int64()) for n in ("place", "start", "end")), ("hash", pa.binary())]
)


def _shard_trees(folder: str):
    """Nodes of each shard's tree, made while the records stream by; open branches hold FANOUT nodes a level."""

    def hash_all(batches):
        shard = _Open(folder)
        number, levels, rows = None, [], []

        def put(level, node):
            if level == len(levels):
                levels.append([0, []])
            place, waiting = levels[level]
            rows.append((number, level, place, *node))
            levels[level][0] += 1
            waiting.append(node)
            if len(waiting) == FANOUT and level < SHARD_LEVELS:
                levels[level][1] = []
                put(level + 1, _parent(waiting))

        def finish():
            level = 0
            while level < SHARD_LEVELS:
                waiting = levels[level][1] if level < len(levels) else []
                if waiting:
                    levels[level][1] = []
                    put(level + 1, _parent(waiting))
                level += 1

        def table():
            found = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODE_SCHEMA.types, strict=True)], schema=_NODE_SCHEMA
            )
            rows.clear()
            return found

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != number:
                    if number is not None:
                        finish()
                    number, levels = row["shard"], []
                data = shard.read(row["path"], row["start"], row["end"])
                leaf = hashlib.sha256(b"\x00" + data).digest() if data is not None else b""
                put(0, (row["start"], row["end"], leaf))
            if rows:
                yield table()
        if number is not None:
            finish()
        if rows:
            yield table()

    return hash_all


def merkle_tree(index: DataFrame, folder: str) -> DataFrame:
    """The saved nodes of the trees of a replica: shard, level, place, start, end, hash.

    Level 0 has the records of the index, by their stored bytes; a record that
    lies beyond the end of its file, or in a missing file, has an empty hash.
    A node of level l and place p has the nodes FANOUT * p and on of level l - 1
    as children. The root of a shard is its one node of level SHARD_LEVELS; from
    there on up shard is -1 and the place of level SHARD_LEVELS + 1 is the
    number of the shard divided by FANOUT, and so on to one root.
    """
    nodes = saved(_shards(index).mapInArrow(_shard_trees(folder), _NODES), "merkle-shards")
    tops, above = [nodes], nodes.where(F.col("level") == SHARD_LEVELS).withColumn("place", F.col("shard"))
    level, most = SHARD_LEVELS, nodes.agg(F.max("shard")).first()[0]
    while most:
        most //= FANOUT
        level += 1
        children = F.array_sort(F.collect_list(F.struct("place", "start", "end", "hash")))
        grouped = above.groupBy((F.col("place") - F.pmod("place", F.lit(FANOUT))).alias("first")).agg(children.alias("c"))
        texts = F.transform("c", lambda x: F.concat_ws("-", x["place"], x["start"], x["end"], F.hex(x["hash"])))
        above = grouped.select(
            F.lit(-1).cast("bigint").alias("shard"),
            F.lit(level).alias("level"),
            (F.col("first") / FANOUT).cast("bigint").alias("place"),
            F.lit(0).cast("bigint").alias("start"),
            F.aggregate("c", F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"]).alias("end"),
            F.unhex(F.sha2(F.array_join(texts, ","), 256)).alias("hash"),
        )
        above = saved(above, "merkle-top")
        tops.append(above)
    whole = tops[0]
    for top in tops[1:]:
        whole = whole.unionByName(top)
    return whole


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """shard, seq of the records that differ between two trees of the same index.

    The comparison starts at the root and goes down one level at a time; only
    children of nodes that differ are compared. Equal roots end it at once.
    """
    top = one.agg(F.max("level")).first()[0]
    columns = ("shard", "place", "hash")
    none = one.where(F.lit(False)).select("shard", F.col("place").alias("seq"))
    if top is None:
        return none
    suspects = None
    for level in range(top, -1, -1):
        here = [t.where(F.col("level") == level).select(*columns) for t in (one, other)]
        keys = ["shard", "place"]
        if suspects is not None:
            if level > SHARD_LEVELS:
                parent = F.floor(F.col("place") / FANOUT)
                own = F.lit(-1).cast("bigint")
            elif level == SHARD_LEVELS:  # the roots of shards, by the number of the shard
                parent, own = F.floor(F.col("shard") / FANOUT), F.lit(-1).cast("bigint")
            else:
                parent, own = F.floor(F.col("place") / FANOUT), F.col("shard")
            above = suspects.select(F.col("shard").alias("above_shard"), F.col("place").alias("above"))
            here = [t.join(above, (parent == F.col("above")) & (own == F.col("above_shard")), "left_semi") for t in here]
        there = here[1].withColumnRenamed("hash", "other_hash")
        differ = here[0].join(there, keys, "full_outer").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        suspects = saved(differ.select(*keys), "merkle-suspects")
        if suspects.isEmpty():
            return none
    return suspects.select("shard", F.col("place").alias("seq"))


def fixity(spark, folder) -> DataFrame:
    """Pages written as WARC, copied with every 97th page damaged, audited and read back."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    first, second = work_dir(spark, "warc"), work_dir(spark, "warc-replica")
    index = write_warc(pages, first)
    copy_shards(index, first, second, F.col("page_id") % 97 == 0)
    found = audit(merkle_tree(index, first), merkle_tree(index, second)).withColumn("found", F.lit(True))
    payloads = read_warc(first, index).join(found, ["shard", "seq"], "left")
    return payloads.select(
        "page_id",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.col("found").isNull().alias("intact"),
    )


FIXITY_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_sha256,
       NOT coalesce(page_id % 97 = 0, false) AS intact
FROM pages
"""
