import itertools
import random

import numpy as np
import pytest

from curatrix.llm import jaccard


def brute_components(texts: dict[int, str | None], n: int, num: int, den: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: find(i) for i in texts}


def near_copies(seed: int, families: int = 12, members: int = 9) -> dict[int, str]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choices(words, k=40))
    out, i = {}, 0
    for _ in range(families):
        base = r.choices(words, k=r.choice([1, 2, 3, 12, 60, 150]))
        for _ in range(members):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.2:
                w += passage.split()
            out[i] = r.choice([" ", "\n", "\t "]).join(w)
            i += 1
    out[i], out[i + 1], out[i + 2] = "", " \n ", "Same WORDS é"
    out[i + 3] = "same words é"
    return out


@pytest.mark.parametrize("seed", range(6))
def test_prefix_tree_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(r.random(60) < 0.04, r.integers(0, 1 << 40, 60), base)) for _ in range(40)]
    sets += [np.unique(r.integers(0, 30, k)) for k in (1, 2, 5, 9, 10, 10, 11)] + [sets[0][:58], sets[0]]
    for num in (80, 90):
        links = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))}
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in jaccard.join_sets(sets, None, num, 100):
            assert tuple(sorted((i, j))) in links
            root[find(i)] = find(j)
        assert all(find(i) == find(j) for i, j in links)
        asked = jaccard.join_sets(sets[:20], sets[20:], num, 100)
        assert all((min(j, i + 20), max(j, i + 20)) in links for i, j in asked if i >= 0)


@pytest.mark.parametrize("seed, tree_hashes", [(1, 10**6), (2, 10**6), (3, 600), (4, 250)])
def test_components_equal_brute_force(spark, seed, tree_hashes):
    texts = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n string")
    for n, num in ((3, 90), (5, 80)):
        got = {r.doc_id: r.component_id for r in jaccard.link_components(docs, n, num, 100, tree_hashes=tree_hashes).collect()}
        assert got == brute_components(texts, n, num, 100)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d", 1), (3, None, 2), (4, "", 3), (5, "a b c d", 4), (6, "A b\tc  d", 5), (6, "A b\tc  d", 5)], "doc_id long, text string, rep int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.link_components(docs, 3, 90, 100).collect())
    assert got == [(-1, 2, None), (3, 0, 3), (4, 0, 4), (5, 2, 5), (6, 2, 5), (6, 2, 5)]
    assert jaccard.link_components(docs.where("false")).count() == 0
    assert sorted((r.doc_id or -1) for r in jaccard.one_of_each(docs).collect()) == [-1, 3, 4, 5]


def test_a_third_of_all_documents_in_one_family(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = r.choices(words, k=90)
    texts = {}
    for i in range(150):
        w = list(base) if i % 3 == 0 else r.choices(words, k=60)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 5]) if i % 3 == 0 else 0):
            w[r.randrange(len(w))] = f"new{i}x{r.randrange(99)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, num in ((3, 90), (5, 80)):
        got = {r.doc_id: r.component_id for r in jaccard.link_components(docs, n, num, 100, tree_hashes=1500).collect()}
        assert got == brute_components(texts, n, num, 100)
