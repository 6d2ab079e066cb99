"""Importance resampling towards a target corpus.

Hashed word counts of the corpus and of the target give each bucket a gain;
the gains are one array that every task looks words up in. A document's weight
is its mean gain, its score the weight plus hash-random Gumbel noise, and the
highest scores are drawn: a sample without replacement by weight. A quantile
sketch brackets the cutoff, exact counts outside validate or widen the bracket,
and only the rows inside are sorted to find it.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import saved

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Rank error of the sketch, as a share of the rows; the bracket begins a little wider.
SKETCH_ACCURACY = 10_000
FIRST_MARGIN = 0.0005

_SLICE = 1 << 20
_KNOWN = 1 << 18
# A-Z become a-z; ASCII other than digits and letters parts words. Bytes from 0x80
# on belong to characters beyond ASCII, which are all part of words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower case, in lists of about _SLICE bytes."""
    plain = text.translate(_TABLE)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + _SLICE)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def _features(text: bytes | None, longest: int) -> Iterator[list[bytes]]:
    """The runs of 1 to `longest` consecutive words of a text, joined by one space, in lists."""
    last: list[bytes] = []
    for words in _slices(text or b""):
        yield words
        for n in range(2, longest + 1):
            joined = [*last[-(n - 1) :], *words]
            yield [b" ".join(joined[i : i + n]) for i in range(len(joined) - n + 1)]
        last = [*last, *words][-(longest - 1) :] if longest > 1 else []


class _Buckets(dict):
    """Bucket by feature; remembers features up to a bound."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket. Null texts have none.

    A task adds its counts up before the shuffle, so that carries at most
    `buckets` rows per task, however often a word occurs.
    """

    def count(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for features in _features(text.as_py(), longest):
                    for feature, n in Counter(features).items():
                        total[known[feature]] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    each = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _count_array(docs: DataFrame, buckets: int, longest: int) -> list[int]:
    found = [0] * buckets
    for row in bucket_counts(docs, buckets, longest).collect():  # at most `buckets` rows
        found[row["bucket"]] = row["n"]
    return found


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n)))) of each of n buckets."""
    n, all_source, all_target = len(source), sum(source), sum(target)
    ratios = [
        (float(t + 1) * float(all_source + n)) / (float(s + 1) * float(all_target + n)) for s, t in zip(source, target)
    ]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


@dataclasses.dataclass(frozen=True)
class Weights:
    """The gain of each bucket, and how features are made."""

    gains: np.ndarray
    longest: int = LONGEST_RUN


def learn_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> Weights:
    """Weights from all texts of both tables."""
    return Weights(gains(_count_array(docs, buckets, longest), _count_array(target, buckets, longest)), longest)


def document_weights(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, n_features, weight of every row.

    The weight is the mean gain of a document's features, rounded down; 0 if it
    has none, as null and empty texts. Long texts are read in pieces. Columns
    other than doc_id and text are not read.
    """

    def measure(batches):
        known = _Buckets(len(weights.gains))
        table = weights.gains.tolist()
        for batch in batches:
            found = []
            for text in batch.column(2).cast(pa.binary()):
                n = total = n_words = 0
                for i, features in enumerate(_features(text.as_py(), weights.longest)):
                    n += len(features)
                    n_words += len(features) if i % weights.longest == 0 else 0
                    total += sum(table[known[f]] for f in features)
                found.append((n_words, n, total // n if n else 0))
            counted = [pa.array(values, pa.int64()) for values in zip(*found)] or [pa.array([], pa.int64())] * 3
            columns = [batch.column(0), batch.column(1), *counted]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n_words", "n_features", "weight"])

    doc_id, tie = F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie")
    narrow = docs.select(doc_id, tie, F.col("text").cast("string"))
    return narrow.mapInArrow(measure, "doc_id bigint, tie bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, rounded down, from SHA-256 of its id; a null id is the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


@dataclasses.dataclass(frozen=True)
class Bracket:
    """Scores between which the cutoff lies, and exactly how many rows are above it and inside."""

    low: int
    high: int
    above: int
    inside: int


def bracket(scored: DataFrame, wanted: int, rows: int, margin: float = FIRST_MARGIN) -> Bracket:
    """The scores between which the `wanted`-th highest of `rows` rows lies, 1 <= wanted <= rows.

    A mergeable quantile sketch gives the two ends. The rows above and inside
    are then counted exactly; if the cutoff is not inside, the margin doubles,
    at last to all rows.
    """
    share = 1 - (wanted - 0.5) / rows
    while True:
        ends = F.percentile_approx("score", [max(0.0, share - margin), min(1.0, share + margin)], SKETCH_ACCURACY)
        low, high = scored.agg(ends.alias("ends")).first()["ends"]
        if margin >= 1:
            low, high = scored.agg(F.min("score"), F.max("score")).first()
        counts = scored.agg(
            F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score").between(low, high)).alias("inside")
        ).first()
        if counts["above"] < wanted <= counts["above"] + counts["inside"]:
            return Bracket(low, high, counts["above"], counts["inside"])
        margin *= 2


def _ordered(rows: DataFrame) -> DataFrame:
    """`rows` with `place`, from 1 on: highest score first, ties to the smaller doc_id (null last), then by `tie`.

    Range-sorted partitions are written once; each row knows its place in its
    partition, and a running total of the partitions' sizes, one row each, gives
    the rest.
    """
    in_order = rows.orderBy(F.col("score").desc(), "no_doc", "doc_id", "tie")
    kept = saved(in_order.withColumn("at", F.monotonically_increasing_id()), "draw-order")
    part = F.shiftright("at", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = kept.withColumn("part", part).join(F.broadcast(offsets), "part")
    place = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("place", place.cast("bigint")).drop("part", "ahead", "at")


def _not_below(last: Row) -> Column:
    """Whether a row comes before the last one drawn or is like it."""
    key = F.struct("no_doc", F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("doc_id"), "tie")
    limit = F.struct(
        F.lit(last["no_doc"]).alias("no_doc"),
        F.lit(last["doc_id"] or 0).cast("bigint").alias("doc_id"),
        F.lit(last["tie"]).alias("tie"),
    )
    return (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (key <= limit))


def cutoff(scored: DataFrame, wanted: int, rows: int) -> Row:
    """The last of the `wanted` rows of `scored` (doc_id, no_doc, tie, score) that are drawn; 1 <= wanted <= rows."""
    found = bracket(scored, wanted, rows)
    inside = scored.where(F.col("score").between(found.low, found.high)).select("score", "no_doc", "doc_id", "tie")
    return _ordered(inside).where(F.col("place") == wanted - found.above).first()


def scored_documents(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, no_doc, tie, n_words, n_features, weight, score of every row of `docs`, written once."""
    weighted = document_weights(docs, learn_weights(docs, target))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    return saved(weighted.withColumn("score", score).withColumn("no_doc", F.col("doc_id").isNull()), "scores")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs` (doc_id, text); rank is null where not drawn.

    Drawn are floor(percent N / 100) of the N rows with at least `least_words`
    words: the highest scores, ties to the smaller doc_id, null last, then by a
    hash of the text; of rows alike in all of these as many as there is room for.
    Ranks are 1, 2, 3... in that order. No rows give no rows, an empty target
    gives weights all the same. The target's other columns are not read either.
    """
    scored = scored_documents(docs, target, seed)
    enough = F.col("n_words") >= least_words
    rows = scored.where(enough).count()
    wanted = percent * rows // 100
    shown = ("doc_id", "n_features", "weight", "score")
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return scored.select(*shown, undrawn)
    top = enough & _not_below(cutoff(scored.where(enough), wanted, rows))
    place = F.when(F.col("place") <= wanted, F.col("place")).alias("rank")
    return _ordered(scored.where(top)).select(*shown, place).unionAll(scored.where(~top).select(*shown, undrawn))


def importance_resampling(spark, folder) -> DataFrame:
    """All documents with their scores towards `benchmark` and the ranks of a tenth. Odd rows as in `resample`."""
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)


# CRC-32 of UTF-8 bytes, one hexadecimal pair at a time.
CRC_SQL = """
    CAST(xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, len(hex(encode(KEY))) // 2),
            lambda i: ('0x' || substr(hex(encode(KEY)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda crc, b: xor(crc >> 8, crc_table[(xor(crc, b) & 255) + 1])
    ), 4294967295::BIGINT) AS BIGINT)
"""
CRC_TABLE_SQL = """
    SELECT list(list_reduce(list_prepend(n::BIGINT, range(0, 8)),
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc_table
    FROM range(0, 256) numbers(n)
"""

RESAMPLING_SQL = f"""
WITH crc_tables AS ({CRC_TABLE_SQL}),
words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS found
    FROM documents
), counted AS (
    SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(found) AS word FROM words) GROUP BY ALL
), wanted AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
    FROM benchmark
), places AS (
    SELECT word, {CRC_SQL.replace("KEY", "word")} % {BUCKETS} AS bucket
    FROM (SELECT word FROM counted UNION SELECT word FROM wanted), crc_tables
), source AS (
    SELECT bucket, sum(n) AS s FROM counted JOIN places USING (word) GROUP BY bucket
), target AS (
    SELECT bucket, count(*) AS t FROM wanted JOIN places USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(
               ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + {BUCKETS})::DOUBLE)
               / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM source FULL JOIN target USING (bucket)
), weights AS (
    SELECT doc_id, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
    FROM counted JOIN places USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scores AS (
    SELECT doc_id, len(found)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)
                                                      / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (doc_id)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
           {PERCENT} * count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () // 100 AS drawn
    FROM scores
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank
FROM ranked
"""
