import collections
import random

import pytest

from ledgerloom.llm import packing


def flat(size):
    return float(size)


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_what_they_may(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 400))), reverse=True)
    bins, places, sizes = packing.best_fit(lengths, (8, 16, 64), flat)
    used = collections.Counter()
    for length, own, place in sorted(zip(lengths, bins, places), key=lambda x: (x[1], x[2])):
        assert place == used[own]
        used[own] += length
    assert all(used[i] <= size and size == min(s for s in (8, 16, 64) if s >= used[i]) for i, size in enumerate(sizes))
    assert sum(sizes) <= sum(lengths) + 64 + 8 * len(sizes)


def test_no_packing_costs_less_on_small_cases():
    def best(lengths, sizes):
        if not lengths:
            return 0
        found, first, rest = float("inf"), lengths[0], lengths[1:]
        for mask in range(1 << len(rest)):
            own = first + sum(x for i, x in enumerate(rest) if mask >> i & 1)
            if own <= max(sizes):
                left = [x for i, x in enumerate(rest) if not mask >> i & 1]
                found = min(found, min(s for s in sizes if s >= own) + best(left, sizes))
        return found

    rng, worse = random.Random(3), 0
    for _ in range(40):
        lengths = sorted((rng.randrange(1, 17) for _ in range(7)), reverse=True)
        total = sum(packing.best_fit(lengths, (4, 8, 16), flat)[2])
        least = best(lengths, (4, 8, 16))
        assert total <= 1.5 * least
        worse += total > least
    assert worse <= 20


def test_costs_choose_the_sizes():
    lengths = [10] * 40
    assert set(packing.best_fit(lengths, (10, 100), lambda s: s * s)[2]) == {10}
    assert set(packing.best_fit(lengths, (10, 100), lambda s: s + 50)[2]) == {100}


def test_every_word_is_placed_once(spark, make_docs, odd_rows):
    docs = make_docs(*odd_rows)
    found = packing.pack(docs, sizes=(16, 64, 256), group=8).collect()
    by_doc = collections.Counter()
    for row in found:
        by_doc[row["doc_id"]] += row["n_words"]
    wanted = collections.Counter()
    for doc_id, text, *_ in odd_rows:
        wanted[doc_id] += len((text or "").split())
    assert by_doc == wanted
    long = sorted((r["piece"], r["start"], r["n_words"]) for r in found if r["doc_id"] == 5)
    assert [p[1] for p in long] == [256 * p[0] for p in long] and all(p[2] == 256 for p in long[:-1])
    bins = collections.defaultdict(list)
    for row in found:
        assert (row["bin_id"] is None) == (row["n_words"] == 0)
        if row["n_words"]:
            bins[row["bin_id"]].append((row["place"], row["n_words"], row["bin_size"]))
    for parts in bins.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:i]) for i in range(len(parts))]
        assert sum(p[1] for p in parts) <= parts[0][2] and len({p[2] for p in parts}) == 1


def test_no_documents(make_docs):
    assert packing.pack(make_docs((1, "a")).where("false")).count() == 0
