"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by its characters and
words; a small network embeds the codes, gated attention weighs the passages,
and a logistic layer scores their weighted mean. Only documents have labels;
the attention learns from them which passages tell.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labels import held_out, label_sample

# Labelled documents to learn from, per label.
SAMPLE = 3000
PASSAGE_WORDS = 100
THRESHOLD = 0.3
BIGRAMS = 64
HIDDEN = 32
GATE = 16
# Bytes of text encoded at a time. A longer text is cut between passages; a passage of more than
# _LONGEST characters, whose words have some 100,000 each, counts as passages of that length.
_SLICE = 1 << 21
_LONGEST = 1 << 23


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: ASCII signs each their own, and kinds of letters, digits and spaces."""
    table = np.zeros(256, np.int64)
    kinds = [b" ", b"\n", b"\t\r\x0b\x0c", b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), bytes(range(48, 58))]
    for i, members in enumerate(kinds, 1):
        table[list(members)] = i
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[signs] = len(kinds) + 1 + np.arange(len(signs))
    table[128:] = len(kinds) + 1 + len(signs)
    return table, len(kinds) + 2 + len(signs)


_CLASS, _N_CLASSES = _classes()
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_POWERS = np.random.default_rng(7).integers(1, 2**32, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = _N_CLASSES + BIGRAMS + 5


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all passages of texts in UTF-8, and the number of passages of each text.

    Text i is data[offsets[i]:offsets[i + 1]]. A passage is PASSAGE_WORDS words
    with the spaces after them; a text without words has one passage.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(n), lengths)
    gap = _SPACE[data]
    starts = ~gap
    starts[1:] &= gap[:-1] | (text[1:] != text[:-1])
    seen = np.concatenate([[0], np.cumsum(starts)])  # words that begin before a byte
    ahead = seen[offsets[:-1]]
    n_words = seen[offsets[1:]] - ahead
    passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(passages) - passages
    m = int(passages.sum())
    place = base[text] + np.maximum(seen[1:] - ahead[text] - 1, 0) // PASSAGE_WORDS

    kinds = np.bincount(place * _N_CLASSES + _CLASS[data], minlength=m * _N_CLASSES).reshape(m, -1)
    pair = (data[:-1].astype(np.int64) * 131 + data[1:].astype(np.int64) * 7919) % BIGRAMS
    pair = place[:-1] * BIGRAMS + pair
    pairs = np.bincount(pair[text[1:] == text[:-1]], minlength=m * BIGRAMS).reshape(m, -1)

    begin = np.flatnonzero(starts)
    of_word = place[begin]
    words = np.bincount(of_word, minlength=m)
    within = np.arange(len(data)) - begin[np.maximum(seen[1:] - 1, 0)] if len(begin) else np.zeros(len(data), np.int64)
    letters = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63])
    hashes = np.add.reduceat(letters, begin) if len(begin) else np.zeros(0, np.uint64)
    sizes = np.add.reduceat((~gap).astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    keys = (of_word.astype(np.uint64) << np.uint64(32)) | ((hashes >> np.uint64(7)) & np.uint64(0xFFFFFFFF))
    distinct = np.bincount((np.unique(keys) >> np.uint64(32)).astype(np.int64), minlength=m)
    again = keys[1:] == keys[:-1]
    repeats = np.bincount(of_word[1:][again], minlength=m)
    short = np.bincount(of_word, weights=sizes <= 3, minlength=m)

    n_letters = np.bincount(of_word, weights=sizes, minlength=m)
    some, share = np.maximum(words, 1), 1 / np.maximum(n_letters, 1)[:, None]
    codes = np.empty((m, N_FEATURES), np.float32)
    codes[:, :_N_CLASSES] = kinds * share
    codes[:, _N_CLASSES : _N_CLASSES + BIGRAMS] = pairs * share
    codes[:, -5:] = np.stack([n_letters / some / 10, distinct / some, repeats / some, short / some, np.log1p(words) / 5], 1)
    return codes, passages


_PASSAGE = re.compile(r"[ \t-\r]*(?:[^ \t-\r]+[ \t-\r]+){%d}" % PASSAGE_WORDS)


def _cut(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts of some whole passages, about _SLICE bytes together.

    A part that is not the last has one more letter, the first of the next
    passage, as pairs of letters reach over the end; its code is not used.
    """
    size, start, at = _SLICE // 4, 0, 0
    while len(text) - start > size:
        found = _PASSAGE.match(text, at, at + _LONGEST)
        if found is None and len(text) - at <= _LONGEST:
            break
        at = found.end() if found else at + _LONGEST
        if at == len(text):
            break
        if at - start >= size or found is None:
            yield text[start : at + 1], True
            start = at
    yield text[start:], False


def encode_texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, codes, passages of each) for runs of texts of about _SLICE bytes; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy()
    large = sizes > _SLICE
    part = np.cumsum(sizes) // _SLICE + np.cumsum(large) + np.cumsum(np.concatenate([[False], large[:-1]]))
    for first in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
        last = int(np.searchsorted(part, part[first], "right"))
        if large[first]:
            found = [encode_one(x)[: -1 if more else None] for x, more in _cut(texts[first].as_py())]
            codes = np.concatenate(found)
            yield first, last, codes, np.array([len(codes)])
            continue
        some = texts.slice(first, last - first)
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield first, last, *encode(data, offsets - offsets[0])


def encode_one(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return encode(data, np.array([0, len(data)]))[0]


@dataclasses.dataclass(frozen=True)
class AttentionModel:
    """The network: standardised codes, one hidden layer, gated attention, a logistic layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def forward(self, codes: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        w0, b0, v, u, w, c, b = self.weights
        x = np.clip((codes - self.mean) / self.scale, -8, 8)
        hidden = np.maximum(x @ w0 + b0, 0)
        tanh, gate = np.tanh(hidden @ v), 1 / (1 + np.exp(-(hidden @ u)))
        logit = (tanh * gate) @ w
        first = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        power = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        attention = power / np.add.reduceat(power, first)[bag]
        mixed = np.add.reduceat(attention[:, None] * hidden, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(mixed @ c + b, -30, 30)))
        return dict(x=x, hidden=hidden, tanh=tanh, gate=gate, attention=attention, mixed=mixed, score=score, bag=bag, first=first)

    def scores(self, codes: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return self.forward(codes, passages)["score"].astype(np.float64)


def _slopes(model: AttentionModel, codes: np.ndarray, passages: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean cross entropy of some documents with regard to the weights."""
    w0, b0, v, u, w, c, b = model.weights
    f = model.forward(codes, passages)
    error = (f["score"] - labels) / len(labels)
    to_mixed = (error[:, None] * c)[f["bag"]]
    to_hidden = f["attention"][:, None] * to_mixed
    along = (to_mixed * f["hidden"]).sum(axis=1)
    centre = np.add.reduceat(f["attention"] * along, f["first"])[f["bag"]]
    to_logit = f["attention"] * (along - centre)
    gated = f["tanh"] * f["gate"]
    to_tanh = to_logit[:, None] * w * f["gate"] * (1 - f["tanh"] ** 2)
    to_gate = to_logit[:, None] * w * f["tanh"] * f["gate"] * (1 - f["gate"])
    to_hidden = to_hidden + to_tanh @ v.T + to_gate @ u.T
    back = to_hidden * (f["hidden"] > 0)
    h = f["hidden"]
    return [f["x"].T @ back, back.sum(0), h.T @ to_tanh, h.T @ to_gate, gated.T @ to_logit, f["mixed"].T @ error, error.sum()]


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11, epochs: int = 30, batch: int = 64) -> AttentionModel:
    """Fit to the labels of bags of passage codes, both labels with equal weight, by Adam with weight decay."""
    rng = np.random.default_rng(seed)
    together = np.concatenate(bags)
    mean, scale = together.mean(axis=0), together.std(axis=0) + 1e-3
    shapes = [(N_FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), ()]
    weights = [rng.standard_normal(s) / np.sqrt(s[0]) if s else np.zeros(()) for s in shapes]
    weights[1] = np.zeros(HIDDEN)
    weights = [w.astype(np.float32) for w in weights]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    share = {value: float((labels == value).mean()) for value in (0, 1)}
    chance = np.array([0.5 / max(share[int(y)], 1e-9) for y in labels])
    chance /= chance.sum()
    for step in range(1, 1 + epochs * max(1, len(bags) // batch)):
        chosen = rng.choice(len(bags), batch, p=chance)
        model = AttentionModel(mean, scale, tuple(weights))
        passages = np.array([len(bags[i]) for i in chosen])
        slopes = _slopes(model, np.concatenate([bags[i] for i in chosen]), passages, labels[chosen].astype(np.float32))
        rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for i, g in enumerate(slopes):
            first[i] = first[i] + np.float32(0.1) * (g - first[i])
            second[i] = second[i] + np.float32(0.001) * (g * g - second[i])
            weights[i] = (weights[i] * (1 - 1e-5) - rate * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(np.float32)
    return AttentionModel(mean, scale, tuple(weights))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, codes, passages in encode_texts(batch.column(2)):
            ends = np.cumsum(passages)
            found = [codes[e - p : e].tobytes() for e, p in zip(ends.tolist(), passages.tolist(), strict=True)]
            columns = [batch.column(i).slice(first, last - first) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["doc_id", "label", "codes"])


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | None:
    """The model learnt from about `sample` labelled documents of each label; held-out rows are not read.

    Only the passage codes of the sample reach the driver. Without documents of
    both labels there is no model.
    """
    known = label_sample(labels, "quality", sample)
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(F.col("doc_id").cast("bigint"), "label", "text")
    found = rows.mapInArrow(_bags, "doc_id bigint, label int, codes binary").toArrow()
    table = sorted(zip(*(found.column(i).to_pylist() for i in range(3)), strict=True))
    y = np.array([label for _, label, _ in table], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return train([np.frombuffer(codes, np.float32).reshape(-1, N_FEATURES) for *_, codes in table], y)


def _scores(model: AttentionModel | None):
    def score(batches):
        for batch in batches:
            found = np.ones(batch.num_rows)
            for first, last, codes, passages in encode_texts(batch.column(1)) if model and batch.num_rows else ():
                found[first:last] = model.scores(codes, passages)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row; without a model all scores are 1.

    A null or empty text is scored as one passage without words. Rows of one
    doc_id are scored one by one; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return narrow.mapInArrow(_scores(model), "doc_id bigint, score double")


def _keep(model: AttentionModel | None, threshold: float, at: int):
    def keep(batches):
        for batch in batches:
            found = np.ones(batch.num_rows)
            for first, last, codes, passages in encode_texts(batch.column(at)) if model and batch.num_rows else ():
                found[first:last] = model.scores(codes, passages)
            yield batch.filter(pa.array(found >= threshold))

    return keep


def keep_good(docs: DataFrame, model: AttentionModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, with all columns."""
    at = docs.columns.index("text")
    return docs.mapInArrow(_keep(model, threshold, at), docs.schema)


def quality(spark, folder) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality_scores(docs, model)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
