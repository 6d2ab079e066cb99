"""Token ids of a corpus in binary shards of patched frame-of-reference blocks.

A shard holds documents in ascending order of doc_id (null first):

    magic | blocks of all ids (see pfor.py) | uint64 start of each block |
    per document: int64 doc_id, uint8 whether it is null, uint64 number of ids |
    uint64 blocks, uint64 documents, uint64 ids | magic

The documents of a corpus lie in ascending order over the shards 0, 1, 2, ...
The block starts give access to any range of ids without decoding the rest.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import pfor
from ledgerloom.llm.storage import file_system, saved, work_dir

MAGIC = b"LLPFOR01"
END_ID = 2
# Words whose ids a worker remembers; beyond it the memory starts afresh.
MEMORY = 400_000
# Words encoded in one call, divided by a symbol that is a token of its own.
_TOGETHER = 50
_MARK = "~"
# Blocks decoded at a time: 256 Ki ids.
_DECODED = 256
_TAIL = 3 * 8 + len(MAGIC)
_MANIFEST = "shard int, path string, documents bigint, ids bigint"


class WordEncoder:
    """Ids of whole texts, each distinct word of a batch encoded once.

    Only for tokenizers that ignore case in ASCII, never join text across ASCII
    white space and give it no id, and always divide an ASCII letter or digit
    from a dot or comma after it. Between two such places the ids of a text are
    those of the parts alone, so parts can be looked up.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids([_MARK])[0]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The ids of all words, the number of each, and the places of the words in that order."""
        letters, mixed, odd = [], [], []
        for i, w in enumerate(words):
            (letters if w.isalpha() else odd if _MARK in w or "<|" in w else mixed).append(i)
        found = [
            self._together([words[i] for i in letters], " ", self.closes),
            self._together([words[i] for i in mixed], f" {_MARK} ", None),
            self._alone([words[i] for i in odd]),
        ]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), letters + mixed + odd

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x, np.uint32) for x in self._ids(words)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _together(self, words: list[str], between: str, closes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Words in a few calls; an id of `closes` is the last of its word, else the mark comes after it."""
        if not words:
            return self._alone(words)
        groups = [between.join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        if closes is None:
            groups = [f"{g} {_MARK}" for g in groups]
        flat = np.concatenate([np.array(x, np.uint32) for x in self._ids(groups)])
        last = closes[flat] if closes is not None else flat == self.mark
        sizes = np.diff(np.flatnonzero(last), prepend=-1)
        if len(sizes) != len(words) or (len(flat) and not last[-1]):
            return self._alone(words)
        return (flat, sizes) if closes is not None else (flat[~last], sizes - 1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END_ID, and the number of each."""
        split = pc.ascii_split_whitespace(_parted(texts))
        bounds = split.offsets.to_numpy()
        coded = pc.dictionary_encode(split.values[bounds[0] : bounds[-1]])
        bounds = bounds - bounds[0]
        words, each = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        place = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        new_ids, new_sizes, order = self._encoded([words[i] for i in new.tolist()])
        place[new[order]] = len(self.sizes) + np.arange(len(new))
        ids, sizes = np.concatenate([self.ids, new_ids]), np.concatenate([self.sizes, new_sizes])

        starts = (np.cumsum(sizes) - sizes)[place][each]
        of_words = sizes[place][each]
        ahead = np.concatenate([[0], np.cumsum(of_words)])
        n_ids = np.diff(ahead[bounds])
        # Where each id is read from: consecutive ids but for the jumps between words.
        jump = np.ones(ahead[-1], np.int64)
        some = of_words > 0
        first, read = ahead[:-1][some], starts[some]
        jump[first] = np.diff(read, prepend=0) - np.diff(first, prepend=0) + 1
        jump[first[:1]] = read[:1]
        out = np.empty(ahead[-1] + len(texts), np.uint32)
        ends = np.cumsum(n_ids + 1) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = ids[np.cumsum(jump)]
        out[ends] = END_ID
        self._remember(words, new, np.bincount(each, minlength=len(words)), place, ids, sizes)
        return out, n_ids + 1

    def _remember(self, words, new, counts, place, ids, sizes) -> None:
        """Keep the new words that came more than once; others rarely come again."""
        if len(self.known) > MEMORY:
            self._forget()
        kept = new[counts[new] > 1]
        starts = np.cumsum(sizes) - sizes
        rows = place[kept]
        n = sizes[rows]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = len(self.sizes)
        self.ids = np.concatenate([self.ids, ids[np.repeat(starts[rows], n) + step]])
        self.sizes = np.concatenate([self.sizes, n])
        self.known.update(zip((words[i] for i in kept.tolist()), range(at, at + len(kept)), strict=True))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
_STOP = np.isin(np.arange(256), list(b".,"))


def _parted(texts: pa.Array) -> pa.Array:
    """The texts with ASCII in lower case and a space between a letter or digit and a dot or comma after it."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    parting = np.zeros(len(data), bool)
    parting[1:] = _STOP[data[1:]] & _ALNUM[data[:-1]]
    at = np.flatnonzero(parting)
    moved = offsets + np.searchsorted(at, offsets, "left")
    buffers = [None, pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(np.insert(_LOWER[data], at, 32))]
    return pa.Array.from_buffers(pa.large_string(), len(texts), buffers)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have so many bytes, or one text that has more."""
    sizes = np.nan_to_num(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(sizes) // most_bytes).astype(np.int64)
    for first in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
        yield batch.slice(first, int(np.searchsorted(part, part[first], "right")) - first)


def _shard_writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (system, root) = _encoder(tokenizer), file_system(folder)
        shard = TaskContext.get().partitionId()
        final = f"{root}/shard-{shard:06d}.pfor"
        draft = f"{final}.{uuid.uuid4().hex}"
        system.create_dir(root, recursive=True)
        keys, nulls, sizes, starts, at = [], [], [], [], len(MAGIC)
        rest = np.zeros(0, np.uint32)

        with system.open_output_stream(draft) as out:

            def put(values):
                nonlocal at
                for block in pfor.encode(values):
                    starts.append(at)
                    at += len(block)
                    out.write(block)

            out.write(MAGIC)
            for whole in batches:
                for batch in _slices(whole):
                    ids, n_ids = encoder(pc.fill_null(batch.column("text"), ""))
                    keys.append(pc.fill_null(batch.column("doc_id"), 0).to_numpy())
                    nulls.append(pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False))
                    sizes.append(n_ids)
                    rest = np.concatenate([rest, ids])
                    full = len(rest) // pfor.BLOCK * pfor.BLOCK
                    put(rest[:full])
                    rest = rest[full:]
            put(rest)
            documents = sum(map(len, keys))
            ids = int(sum(x.sum() for x in sizes))
            out.write(np.array(starts, "<u8").tobytes())
            for parts, kind in ((keys, "<i8"), (nulls, "u1"), (sizes, "<u8")):
                out.write(b"".join(x.astype(kind).tobytes() for x in parts))
            out.write(np.array([len(starts), documents, ids], "<u8").tobytes() + MAGIC)
        system.move(draft, final)  # a task that runs again replaces its file whole
        if documents:
            row = {"shard": [shard], "path": [f"shard-{shard:06d}.pfor"], "documents": [documents], "ids": [ids]}
            yield pa.RecordBatch.from_pydict(
                row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
            )

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write doc_id and text as token shards to `folder`; returns the table of shards.

    The table (shard, path, documents, ids) is saved, as the files are written
    only once. A null text counts as empty; every document ends with END_ID, so
    an empty one has one id. Rows of one doc_id are all kept, in the order of a
    hash of their texts. No rows give no shards. Other columns are not read. The
    order costs one shuffle of the texts; the ids are never shuffled.
    """
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie").select(F.col("doc_id").cast("bigint"), "text")
    return saved(ordered.mapInArrow(_shard_writer(folder, tokenizer), _MANIFEST), "token-shards")


class Shard:
    """A shard open for reading."""

    def __init__(self, folder: str, name: str):
        system, root = file_system(folder)
        self.file = system.open_input_file(f"{root}/{name}")
        tail = self._read(self.file.size() - _TAIL, _TAIL)
        if tail[-len(MAGIC) :] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no token shard")
        blocks, documents, self.ids = np.frombuffer(tail, "<u8", 3).tolist()
        index = self.file.size() - _TAIL - 8 * blocks - 17 * documents
        self.starts = np.append(np.frombuffer(self._read(index, 8 * blocks), "<u8"), index).astype(np.int64)
        data = self._read(index + 8 * blocks, 17 * documents)
        self.doc_ids = np.frombuffer(data, "<i8", documents)
        self.null = np.frombuffer(data, "u1", documents, 8 * documents).astype(bool)
        self.sizes = np.frombuffer(data, "<u8", documents, 9 * documents).astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from `first` up to and without `last`."""
        begin, end = int(self.starts[first]), int(self.starts[last])
        return pfor.decode(self._read(begin, end - begin), self.starts[first:last] - begin)

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids at the places `start` up to and without `stop`."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // pfor.BLOCK
        found = self.blocks(first, -(-stop // pfor.BLOCK))
        return found[start - first * pfor.BLOCK : stop - first * pfor.BLOCK]


def _checksums(shard: Shard) -> np.ndarray:
    """Per document the crc32 of its ids; a group of blocks is in memory at a time."""
    ends = np.cumsum(shard.sizes)
    sums = np.zeros(len(ends), np.int64)
    document, place = 0, 0
    for first in range(0, len(shard.starts) - 1, _DECODED):
        ids = shard.blocks(first, min(first + _DECODED, len(shard.starts) - 1)).astype("<u4")
        stop = place + len(ids)
        data, begin = memoryview(ids).cast("B"), place
        while document < len(ends) and place < stop:
            upto = min(int(ends[document]), stop)
            sums[document] = zlib.crc32(data[4 * (place - begin) : 4 * (upto - begin)], int(sums[document]))
            place = upto
            document += int(place == ends[document])
    return sums


def read_token_digests(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it in the corpus. Shards are
    read side by side, one to a task.
    """
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("start", F.coalesce(F.sum("ids").over(ahead), F.lit(0)))
    names = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["path"])
                starts = row["start"] + np.cumsum(shard.sizes) - shard.sizes
                columns = [pa.array(shard.doc_ids, mask=shard.null), starts, shard.sizes, _checksums(shard)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=names)

    tasks = max(1, shards.count())
    spread = placed.repartitionByRange(tasks, "shard")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark, folder) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    target = work_dir(spark, "tokens")
    shards = write_tokens(docs, target, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_digests(spark, target, shards)
