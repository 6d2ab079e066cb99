import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import attention as att
from ledgerloom.llm.labels import held_out

from .conftest import sentence


def test_passages():
    texts = [None, "", "a b", " ".join(["w"] * 250), "\n\n" + "é " * 100, "x" * 500]
    ((first, last, codes, passages),) = att.encode_texts(pa.array(texts, pa.string()))
    assert (first, last, passages.tolist(), codes.shape) == (0, 6, [1, 1, 1, 3, 1, 1], (8, att.N_FEATURES))
    assert not codes[:2].any() and np.isfinite(codes).all()
    for i, text in enumerate(texts):
        at = passages[:i].sum()
        assert np.allclose(codes[at : at + passages[i]], att.encode_one(text or ""))


@pytest.mark.parametrize("gap", [" ", "\n\n", "\t \r"])
def test_long_texts_have_the_same_codes_as_whole(monkeypatch, gap):
    """A text is cut between passages, so its codes do not depend on where."""
    rng = np.random.default_rng(4)
    text = gap + gap.join("wé"[i % 2] * int(n) + str(i % 7) for i, n in enumerate(rng.integers(1, 12, 5000)))
    texts = [text, text + gap, "x" * 9000, " " * 9000, text[: len(text) // 2]]
    whole = [att.encode_one(t) for t in texts]
    monkeypatch.setattr(att, "_SLICE", 4000)
    for t, codes in zip(texts, whole):
        runs = list(att.encode_texts(pa.array(["a", t, "b", None], pa.string())))
        assert [(f, l) for f, l, *_ in runs] == [(0, 1), (1, 2), (2, 4)]
        assert runs[1][3].tolist() == [len(codes)] and np.array_equal(runs[1][2], codes)
    assert len(list(att._cut(text))) > 5 and sum(len(part) - more for part, more in att._cut(text)) == len(text)
    monkeypatch.setattr(att, "_LONGEST", 2000)
    assert [len(part) - more for part, more in att._cut("x" * 9000)] == [2000, 2000, 2000, 2000, 1000]


def _setup(seed=0, n=12):
    rng = np.random.default_rng(seed)
    passages = rng.integers(1, 5, n)
    codes = rng.standard_normal((passages.sum(), att.N_FEATURES))
    shapes = [(att.N_FEATURES, 5), (5,), (5, 3), (5, 3), (3,), (5,), ()]
    weights = tuple(np.array(rng.standard_normal(s) * 0.3) for s in shapes)
    return att.AttentionModel(np.zeros(att.N_FEATURES), np.ones(att.N_FEATURES), weights), codes, passages, rng.integers(0, 2, n)


def test_slopes_against_differences():
    model, codes, passages, labels = _setup()

    def loss(weights):
        p = att.AttentionModel(model.mean, model.scale, tuple(weights)).forward(codes, passages)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    slopes = att._slopes(model, codes, passages, labels)
    for i, w in enumerate(model.weights):
        for at in list(np.ndindex(w.shape))[:7]:
            moved = [[x.copy() for x in model.weights] for _ in range(2)]
            moved[0][i][at] += 1e-5
            moved[1][i][at] -= 1e-5
            assert np.isclose((loss(moved[0]) - loss(moved[1])) / 2e-5, slopes[i][at], atol=1e-6)


def test_attention_is_a_share_and_order_does_not_matter():
    model, codes, passages, _ = _setup(1)
    found = model.forward(codes, passages)
    assert np.allclose(np.add.reduceat(found["attention"], found["first"]), 1)
    one = model.scores(codes[: passages[0]], passages[:1])
    assert np.allclose(one, model.scores(codes[: passages[0]][::-1], passages[:1]))
    assert np.allclose(one, found["score"][0])


def _corpus(n=500):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        words, bad = sentence(i, rng.randrange(30, 400)).split(), i % 3 == 0
        if bad:  # one passage in many tells
            at = rng.randrange(len(words) - 20)
            words[at : at + 20] = [w + "%%%" for w in words[at : at + 20]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_learnt_scores_on_held_out_documents(spark, make_docs):
    rows, labels = _corpus()
    docs = make_docs(*rows)
    model = att.learn_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = att.quality_scores(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).where("held_out").collect()
    wanted = {i: q for i, q, _ in labels}
    right = sum((r["score"] >= att.THRESHOLD) == bool(wanted[r["doc_id"]]) for r in found)
    assert len(found) > 80 and right / len(found) > 0.95
    again = att.learn_quality(docs, spark.createDataFrame(labels[::-1], "doc_id bigint, quality int, toxic int"))
    assert all((a == b).all() for a, b in zip(model.weights, again.weights))


def test_odd_rows_and_no_labels(spark, make_docs, odd_rows):
    docs = make_docs(*odd_rows)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert att.learn_quality(docs, none) is None
    assert att.keep_good(docs, None).count() == len(odd_rows)
    odd = spark.createDataFrame([(4, 1, 1), (None, 1, 1), (2, 0, 0), (3, 0, 0), (6, 5, 1), (4, None, 1)], none.schema)
    model = att.learn_quality(docs, odd)
    scores = att.quality_scores(docs, model).collect()
    assert len(scores) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in scores)
    kept = att.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in scores)
    assert att.quality_scores(docs.where("false"), model).count() == 0
