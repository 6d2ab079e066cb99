import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """Shares by weight, stopped at `epochs` sizes, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, limited = sum(sizes.values()), set()
    while True:
        spent = sum(epochs * sizes[s] for s in limited)
        free = [s for s in names if s not in limited]
        share = {s: weight[s] * (total - spent) / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        if not above:
            return {**{s: float(epochs * sizes[s]) for s in limited}, **share}
        limited |= above


def plan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    return [r.asDict() for r in mixing.mix_plan(df, F.col("n")).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [None, "b", "a", "é", "Z", ""][: 2 + seed]
    rows = [(i, rng.choices(names, [2 ** k for k in range(len(names))])[0], rng.randrange(0, 40)) for i in range(300)]
    found = plan(spark, rows)
    sizes = collections.Counter()
    for _, source, n in rows:
        sizes[source] += n
    wanted = targets({s: sizes[s] for s in {r[1] for r in rows}})
    taken = collections.Counter()
    order = collections.defaultdict(list)
    for row in found:
        taken[row["source"]] += row["taken"]
        assert row["target"] == pytest.approx(wanted[row["source"]], abs=1e-6)
        assert row["source_size"] == sizes[row["source"]]
        assert 0 <= row["taken"] <= 3 * row["size"]
        key = hashlib.md5(f"42|{row['doc_id']}|{row['size']}".encode()).hexdigest()
        order[row["source"]].append((key, row))
    for source, target in wanted.items():
        assert taken[source] == int(target + 1e-9)
        parts = [row["extra"] / row["size"] for _, row in sorted(order[source], key=lambda x: x[0]) if row["size"]]
        assert sorted(parts, reverse=True) == parts and sum(0 < p < 1 for p in parts) <= 1


def test_reruns_and_partitions_agree(spark):
    rows = [(i % 50, "s" if i % 3 else "t", i % 7) for i in range(200)]
    one, two = plan(spark, rows), plan(spark, rows[::-1])
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(one, key=key) == sorted(two, key=key)


def test_documents_come_as_often_as_planned(spark, make_docs):
    rows = [(i, " ".join(f"w{k}" for k in range(10)), "big") for i in range(60)] + [(100, "a b\tc\n d", "small")]
    docs = make_docs(*rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    texts = [r["text"] for r in mixed.collect() if r["source"] == "small"]
    assert texts == ["a b\tc\n d"] * 3
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == 60 * 10 + 4
    cut = [r["text"] for r in mixed.collect() if r["source"] == "big" and len(r["text"].split()) < 10]
    assert len(cut) <= 1 and all(rows[0][1].startswith(x) for x in cut)


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(*odd_rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    sizes = sum(len((t or "").split()) for _, t, *_ in odd_rows)
    taken = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert abs(taken - sizes) <= 2
    assert mixing.mix_documents(docs.where("false")).count() == 0
    assert mixing.mix_documents(make_docs((1, ""), (2, None))).count() == 0


def test_columns_named_like_those_of_the_plan_are_kept(spark):
    names = ["size", "source_size", "target", "full_epochs", "extra", "taken", "copy", "bucket", "key", "source_key"]
    columns = "doc_id bigint, source string, text string, " + ", ".join(f"{n} bigint" for n in names)
    rows = [(i, "ab"[i % 2], "w " * (i + 1), *(100 * i + j for j in range(len(names)))) for i in range(12)]
    mixed = mixing.mix_documents(spark.createDataFrame(rows, columns))
    assert mixed.columns == columns.replace(" bigint", "").replace(" string", "").split(", ")
    for r in mixed.collect():
        assert [r[n] for n in names] == [100 * r["doc_id"] + j for j in range(len(names))]


def test_plan_has_no_python(spark, make_docs):
    plan = mixing.mix_documents(make_docs((1, "a b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
