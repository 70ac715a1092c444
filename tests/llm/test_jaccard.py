import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibweave.llm.jaccard import RTree, components, group_points, jaccard_groups


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "two one"), (7, "é à ü"), (None, "é à ü")]
    for k in range(30):
        base = [word() for _ in range(rng.choice([5, 6, 12, 40, 150, 400]))]
        if k % 3 == 0:
            base += passage
        for c in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 45)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + len(rows), rng.choice([" ", "\n"]).join(copy)))
    rows += [rows[20], (rows[21][0], rows[30][1]), (None, rows[25][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 1024), (2, 2)])
def test_equals_brute_force(spark, seed, tile):
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "key": F.lit(1), "node": F.lit(2)})
    got = sorted(map(tuple, jaccard_groups(docs, tile=tile).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_long_texts_and_small_tiles(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared, rows = [word() for _ in range(1500)], []
    for _ in range(6):
        base = shared + [word() for _ in range(3500)]  # unrelated texts meet in a long passage
        for c in range(4):
            copy = list(base)
            for _ in range(60 * c):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_tree_prunes_unrelated_long_sets():
    rng = np.random.default_rng(4)
    grams = [np.unique(rng.integers(0, 2**63, 8000, dtype=np.uint64) * np.uint64(2)) for _ in range(40)]
    points, sizes = group_points(grams), np.array([len(g) for g in grams])
    tree = RTree(points, sizes)
    assert all(tree.search(points[i], int(sizes[i]), 80).tolist() == [i] for i in range(40))


def test_hub_of_many_edges(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {k: 0 for k in range(1, 3000)} | {5001 + k: 5000 for k in range(40)}


def test_empty_table(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    grams = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in range(0, 200, 2)]
    points, sizes = group_points(grams), np.array([len(g) for g in grams])
    tree = RTree(points, sizes)
    for i, a in enumerate(grams):
        near = {j for j, b in enumerate(grams) if 100 * (o := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - o)}
        assert near <= set(tree.search(points[i], len(a), 80).tolist())
