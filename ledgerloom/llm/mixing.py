"""Mixing sources to target weights, with exact budgets.

Each document gets a hash-random key. Ranges of the key split every source
into buckets; prefix sums over the buckets, then inside each bucket, give the
number of words before each document in the order of its source. No task sees
more than one bucket of one source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import saved
from ledgerloom.llm.words import GAP, WORD, n_words

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 42
# Hex digits of the key that name a bucket: 4096 buckets per source. Each holds
# 1/4096 of a source: at 10^10 documents in one source 2.4 million short rows.
BUCKET_DIGITS = 3


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS
) -> DataFrame:
    """Per source its size, target and cut: source_key, source_size, target, full_epochs, rest.

    `sizes` has source_key (ordered text) and size. Sources take the weights in
    turn, in the order of their keys, and share the size of all. A target stops
    at `epochs` times the source's size; the excess goes to the others by weight
    until none is above. In ascending order of limit per weight, a source is cut
    if its limit lies below its share of what the sources before it leave over.
    The budget is the target rounded down to whole words: `full_epochs` times the
    source and `rest` words more. One row per source goes through one task.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    position = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * epochs)
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    ordered = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("limit").over(ordered), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ordered), F.lit(0))
    limited = ranked.withColumn("total", total).withColumn("limited", F.col("ratio") < left / weight_left)
    spent = F.sum(F.when(F.col("limited"), F.col("limit")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("limited"), 0).otherwise(F.col("weight"))).over(every)
    share = F.col("weight") * ((F.col("total") - spent) / open_weight)
    target = F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(share)
    budget = F.floor("target").cast("bigint")
    full = F.when(F.col("source_size") > 0, F.least((budget / F.col("source_size")).cast("bigint"), F.lit(epochs)))
    return (
        limited.select("source_key", "source_size", target.alias("target"))
        .withColumn("full_epochs", F.coalesce(full, F.lit(0)).cast("bigint"))
        .withColumn("rest", budget - F.col("full_epochs") * F.col("source_size"))
        .select("source_key", "source_size", "target", "full_epochs", "rest")
    )


def _key(parts: Sequence[Column], seed: int) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def _source_key(source: Column) -> Column:
    """Text that sorts sources by code point with null last."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source))


def mix_plan(
    docs: DataFrame,
    size: Column,
    ties: Sequence[Column] = (),
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """`docs` (doc_id, source, any others) with size, source_size, target, full_epochs, extra, taken.

    `taken` words of a document go into the mix: all its words `full_epochs`
    times and the first `extra` of them once more. Extra is 0 or the size of
    the document but for the one per source in which the budget ends.

    Null sizes count as 0, a null source is a source of its own, and a null
    doc_id is a key like any other. Documents with one doc_id and size are
    ordered by `ties`; rows alike in those too are interchangeable. No rows give
    no rows. Columns of `docs` named like a result are replaced.
    """
    added = ("size", "source_size", "target", "full_epochs", "extra", "taken")
    size = F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))
    kept = [name for name in docs.columns if name not in added]
    keyed = docs.select(
        F.struct(*(docs[f"`{name}`"] for name in kept)).alias("row"),
        size.alias("size"),
        _source_key(F.col("source")).alias("source_key"),
        _key([F.col("doc_id"), size, *ties], seed).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    place = ("source_key", "bucket")
    buckets = saved(keyed.groupBy(*place).agg(F.sum("size").alias("size")), "mix-buckets")
    targets = source_targets(buckets, weights, epochs)
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*place, F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*place).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets.join(targets, "source_key"), list(place))
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return placed.withColumn("extra", extra.cast("bigint")).select(
        *(F.col(f"row.`{name}`") for name in kept),
        "size",
        "source_size",
        "target",
        "full_epochs",
        "extra",
        (F.col("full_epochs") * F.col("size") + F.col("extra")).alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{GAP})?{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every copy of every document that is taken, in the columns of `docs`.

    `docs` has doc_id, source and text; sizes are words. The document in which a
    source's budget ends is cut after the word that meets it. Documents without
    words take none of the budget, so they come as often as whole epochs say.
    """
    row = F.struct(*(docs[f"`{name}`"] for name in docs.columns)).alias("_row")
    # Beside the keys a document is one column, so none of its own is taken for one of the plan.
    plan = mix_plan(docs.select("doc_id", "source", row), n_words(F.col("_row.text")), [F.xxhash64("_row.text")], **options)
    copies = F.col("full_epochs") + (F.col("extra") > 0).cast("bigint")
    repeated = plan.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    part = (F.col("copy") > F.col("full_epochs")) & (F.col("extra") < F.col("size"))
    whole = F.col("_row.text")
    text = F.when(part, first_words(whole, F.col("extra"))).otherwise(whole).alias("text")
    return repeated.select(*(text if name == "text" else F.col(f"_row.`{name}`") for name in docs.columns))


def mixing(spark, folder) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sized = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("n")), "mix-sizes")
    plan = mix_plan(sized, F.col("n"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = """
WITH sized AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS source_key,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
    FROM documents
), totals AS (
    SELECT source_key, sum(size)::BIGINT AS source_size,
           1 + (row_number() OVER (ORDER BY source_key) - 1) % 3 AS weight
    FROM sized GROUP BY source_key
), ranked AS (
    SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio,
           sum(source_size) OVER () AS total
    FROM totals
), limits AS (
    SELECT *, ratio < (total - coalesce(sum(cap) OVER smaller, 0))::DOUBLE
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER smaller, 0)) AS limited
    FROM ranked
    WINDOW smaller AS (ORDER BY ratio, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source_key, source_size, CASE WHEN limited THEN cap::DOUBLE ELSE weight * (
               (total - sum(CASE WHEN limited THEN cap ELSE 0 END) OVER ())::DOUBLE
               / sum(CASE WHEN limited THEN 0 ELSE weight END) OVER ()) END AS target
    FROM limits
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target)::BIGINT // source_size, 3) ELSE 0 END AS epochs
    FROM targets
), placed AS (
    SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size
           - coalesce(sum(size) OVER (PARTITION BY source_key
                                      ORDER BY md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR)
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
    FROM sized JOIN budgets USING (source_key)
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken
FROM placed
"""
