import math
import random

import numpy as np

from ledgerloom.llm import ann, partitions

SCHEMA = "vec_id bigint, embedding array<float>, label int, print string"


def _rows(n, dimension=16, seed=0, clusters=None):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, dimension))
    if clusters:
        vectors = vectors * 0.4 + rng.standard_normal((clusters, dimension))[rng.integers(0, clusters, n)]
    return [(i, v.astype(np.float32).tolist(), 0, "x") for i, v in enumerate(vectors)]


def by_hand(rows, every=50, k=5):
    """query_id -> (-cosine, vec_id) of the k nearest, over all pairs."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    lengths = [len(v) for _, v in good]
    usual = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    good = [(i, v) for i, v in good if len(v) == usual]
    ids, vectors = np.array([i for i, _ in good]), np.array([v for _, v in good])
    norms, found = np.sqrt((vectors * vectors).sum(axis=1)), {}
    for q in np.flatnonzero(ids % every == 0).tolist():
        score = (vectors * vectors[q]).sum(axis=1) / (norms * norms[q])
        near = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != ids[q])
        found[int(ids[q])] = near[:k]
    return found


def _searched(spark, rows, **options):
    found = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA), **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    return {q: [(s, i) for _, s, i in sorted(x)] for q, x in found.items()}


def test_recall_against_brute_force(spark):
    for rows in (_rows(3000, clusters=40), _rows(2000, seed=3)):
        found, wanted = _searched(spark, rows), by_hand(rows)
        assert found.keys() == wanted.keys() and all(len(x) == 5 for x in found.values())
        hits = sum(len({i for _, i in found[q]} & {i for _, i in wanted[q]}) for q in wanted)
        assert hits / (5 * len(wanted)) >= 0.9
        scores = {(q, i): s for q, near in by_hand(rows, k=len(rows)).items() for s, i in near}
        assert all(abs(scores[q, i] - s) < 1e-12 for q, x in found.items() for s, i in x)
        assert all(x == sorted(x) for x in found.values())


def test_copies_and_ties_go_to_smaller_ids(spark):
    rows = _rows(120)
    same = rows[7][1]
    rows += [(1000 + i, same, 0, "x") for i in range(400)] + [(1000, same, 0, "x")] * 3
    found, wanted = _searched(spark, rows), by_hand(sorted({r[0]: r for r in rows}.values()))
    for q in (1000, 1050, 1100, 1350):
        assert [i for _, i in found[q]] == [i for _, i in wanted[q]]


def test_unusable_vectors_take_no_part(spark):
    rows = _rows(60, 4)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 4, [nan, 1.0, 1.0, 1.0], [inf, 0.0, 0.0, 1.0], [None, 1.0, 1.0, 1.0], [1.0], [1e-38, 0.0, 0.0, 0.0]]
    rows += [(100 + 50 * i, v, 1, None) for i, v in enumerate(odd)] + [(None, [1.0, 2.0, 3.0, 4.0], 1, "y")]
    found = _searched(spark, rows, recall=1.0)
    assert found.keys() == {0, 50, 450}
    assert {q: [i for _, i in x] for q, x in found.items()} == {q: [i for _, i in x] for q, x in by_hand(rows).items()}


def test_a_longer_row_does_not_remove_the_others(spark):
    rows = _rows(60, 4) + [(1000, [1.0] * 5, 1, "x"), (1050, [None] * 5, 1, "x"), (1100, [0.5] * 3, 1, "x")]
    found, wanted = _searched(spark, rows, recall=1.0), by_hand(rows)
    assert {q: [i for _, i in x] for q, x in found.items()} == {q: [i for _, i in x] for q, x in wanted.items()}
    assert found.keys() == {0, 50}


def test_recall_on_vectors_that_the_sample_does_not_hold(spark):
    """A sample of a tenth teaches the router and sets the probes; nearly all vectors are new to it."""
    rows = _rows(4000, 16, clusters=40)
    found, wanted = _searched(spark, rows, sample=400), by_hand(rows)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert len(wanted) == 80 and hits / (5 * len(wanted)) >= 0.9


def test_few_rows(spark):
    rows = _rows(3)
    assert {q: [i for _, i in x] for q, x in _searched(spark, rows).items()} == {0: [i for _, i in by_hand(rows)[0]]}
    assert _searched(spark, rows[:1]) == {} and _searched(spark, []) == {}
    assert _searched(spark, [(0, None, 1, "x"), (50, [], 1, "x")]) == {}


def test_split_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rows = _rows(600, clusters=2)
    found, wanted = _searched(spark, rows, every=10, recall=1.0), by_hand(rows, every=10)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert hits / (5 * len(wanted)) >= 0.95


def test_parts_are_balanced_and_cut_few_edges():
    unit = np.array([r[1] for r in _rows(2000, clusters=30)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = partitions.neighbour_graph(unit)
    part = partitions.balanced_parts(unit, graph, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(2000 / 8 * 1.1)
    inside = (part[graph] == part[:, None]).mean()
    shuffled = part[random.Random(0).sample(range(2000), 2000)]
    assert inside > 0.6 > (shuffled[graph] == shuffled[:, None]).mean()
