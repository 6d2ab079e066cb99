import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import pfor, tokens
from ledgerloom.llm.storage import work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000), st.sampled_from([1, 50, 90, 100]))
def test_blocks_round_trip(values, percentile):
    blocks = pfor.encode(np.array(values, np.uint32), percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert pfor.decode(b"".join(blocks), starts).tolist() == values
    assert len(blocks) == -(-len(values) // pfor.BLOCK)


def test_outliers_are_exceptions():
    values = np.full(1024, 1000, np.uint32)
    values[::100] = 4_000_000_000
    values[1::2] += 3
    (block,) = pfor.encode(values)
    head = np.frombuffer(block[: pfor._HEAD.itemsize], pfor._HEAD)[0]
    assert (head["width"], head["exceptions"]) == (2, 11)
    assert len(block) == 12 + 1024 * 2 // 8 + 11 * 6


TEXT = st.text(st.characters(codec="utf-8") | st.sampled_from("aZ .,~'1\n\t\x0b́<|ſKẞİé#"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.sampled_from(["<|endoftext|> a.b", "don't. 's", "1.5,2 x..y.,", "~ ~a", "É.é,"]), max_size=8))
def test_words_looked_up_give_the_ids_of_whole_texts(encoder, tokenizer, texts):
    ids, sizes = encoder(pa.array(texts, pa.string()))
    wanted = [[*e.ids, tokens.END_ID] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in wanted]
    assert ids.tolist() == [i for x in wanted for i in x]


def test_memory_starts_afresh(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    encoder = tokens.WordEncoder(PATH)
    for text in ("one two two one three three", "four four five five one", "two two six six six one", "one one"):
        assert encoder(pa.array([text]))[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def _wanted(rows, tokenizer):
    found, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_shards_hold_all_documents_in_order(spark, make_docs, odd_rows, tokenizer):
    folder = work_dir(spark, "test-tokens")
    shards = tokens.write_tokens(make_docs(*odd_rows), folder, PATH)
    found = sorted(map(tuple, tokens.read_token_digests(spark, folder, shards).collect()), key=lambda r: r[1])
    by_id = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in found] == [r[0] for r in by_id]
    wanted = _wanted(by_id, tokenizer)
    assert sorted((str(r[0]), *r[2:]) for r in found) == sorted((str(r[0]), *r[2:]) for r in wanted)
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()


def test_any_range_can_be_read(spark, make_docs, tokenizer):
    text = "some words of a text, again and again. " * 700
    folder = work_dir(spark, "test-range")
    (row,) = tokens.write_tokens(make_docs((1, text)), folder, PATH).collect()
    shard = tokens.Shard(folder, row["path"])
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert shard.ids == len(ids)
    for start, stop in ((0, 5), (1020, 1030), (3000, 6000), (len(ids) - 1, len(ids)), (7, 7)):
        assert shard.range(start, stop).tolist() == ids[start:stop]


def test_no_documents(spark, make_docs):
    folder = work_dir(spark, "test-none")
    shards = tokens.write_tokens(make_docs((1, "a")).where("false"), folder, PATH)
    assert tokens.read_token_digests(spark, folder, shards).count() == 0
