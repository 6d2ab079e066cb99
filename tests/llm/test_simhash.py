import itertools
import random

import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components


def by_hand(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > len(shingles))


def groups(values, radius=3):
    """Smallest place reachable over links of at most `radius` bits."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(values)), 2):
            if bin(values[a] ^ values[b]).count("1") <= radius and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
                changed = True
    return root


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one TWO", "A b\x0bc d\x0ce", "é É  x y z", "w " * 70_000):
        assert simhash.fingerprint(text) == by_hand(text)


def test_trees_find_all_that_is_near():
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = np.array(sorted({near(rng, s, rng.randrange(6)) for s in seeds for _ in range(12)}), np.uint64)
    tree = simhash.BKTree(rng.sample(values.tolist(), len(values)))
    for radius in (0, 1, 3, 5):
        query, node = tree.search(values, radius)
        wanted = {(i, int(v)) for i, x in enumerate(values) for v in values if (int(x) ^ int(v)).bit_count() <= radius}
        assert sorted(zip(query.tolist(), tree.values[node].tolist())) == sorted(wanted)


def test_links_in_a_shard():
    rng = random.Random(6)
    values = np.array(sorted({near(rng, s, rng.randrange(5)) for s in range(0, 2**60, 2**55) for _ in range(4)}), np.uint64)
    roots = simhash.tree_links(values, np.ones(len(values), bool))
    assert roots.tolist() == groups([int(v) for v in values])


def _found(spark, values):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint bigint")
    ordered = simhash._shards(df).repartition("shard").sortWithinPartitions("shard")
    links = ordered.mapInArrow(simhash._shard_links, "left bigint, right bigint")
    roots = {r["node"]: r["root"] for r in components(links, "left", "right").collect()}
    return [roots.get(int(np.uint64(v).view(np.int64)), int(np.uint64(v).view(np.int64))) for v in values]


def _same_groups(found, wanted):
    return len(set(zip(found, wanted))) == len(set(found)) == len(set(wanted))


def test_shards_lose_no_link(spark, monkeypatch):
    rng = random.Random(7)
    chain = [rng.getrandbits(64)]
    for _ in range(25):
        chain.append(near(rng, chain[-1], 3))
    star = [near(rng, 0, rng.randrange(4)) for _ in range(60)]
    values = sorted({*chain, *star, *(rng.getrandbits(64) for _ in range(40))})
    wanted = groups(values)
    assert _same_groups(_found(spark, values), wanted)
    monkeypatch.setattr(simhash, "TREE", 8)  # shards in many parts
    assert _same_groups(_found(spark, values), wanted)


def test_documents(spark, make_docs, odd_rows):
    docs = make_docs(*odd_rows, (9, odd_rows[4][1]), (10, "One two"), (11, "one  TWO"))
    found = simhash.near_duplicates(docs).collect()
    rows = [(r[0], by_hand(r[1])) for r in [*odd_rows, (9, odd_rows[4][1]), (10, "One two"), (11, "one  TWO")]]
    roots = groups([fp for _, fp in rows])
    least = {}
    for (doc_id, _), root in zip(rows, roots):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    wanted = [(i, fp, least.get(r)) for (i, fp), r in zip(rows, roots)]
    got = [(r[0], r[1] & (2**64 - 1), r[2]) for r in found]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(wanted, key=key)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(least.get(r)) for r in set(roots))
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.one_of_each(docs.where("false")).count() == 0
