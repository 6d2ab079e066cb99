import random

from ledgerloom.llm.components import components


def _by_hand(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(0, 40)]
    rng.shuffle(path)
    star = [(100, 100 + i) for i in range(1, 60)] + [(500, 100 + i) for i in range(30, 50)]
    loose = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges = [e for e in path + star + loose if e[0] != e[1]]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), (-5, -9)], "a bigint, b bigint")
    found = [(r["node"], r["root"]) for r in components(df, "a", "b").collect()]
    assert len(found) == len(set(found))
    assert dict(found) == _by_hand([*edges, (-5, -9)])
    assert components(df.where("false"), "a", "b").count() == 0
