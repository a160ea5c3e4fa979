"""What the pipeline's stages hold or start on the driver."""

import tracemalloc

import numpy as np

from candlewick.llm import components, toxicity


def test_pair_counts_of_the_fit_are_held_in_stripes(monkeypatch):
    """All counts of 2,048 terms at once, by class, would be 32 MB, and their last addend 16 MB more."""
    rng = np.random.default_rng(3)
    k, docs = 2048, []
    label = (np.arange(1200) % 3 == 0).astype(float)
    for n, y in enumerate(label):  # terms 5 and 900 alone are in both classes alike, together in class 1 alone
        pair = [5, 900] if y and n % 2 == 0 else [[5], [900]][n % 2] if not y else []
        docs.append(np.union1d(rng.integers(0, k, 40), pair))
    flat, ends = np.concatenate(docs).astype(np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tracemalloc.start()
    found = toxicity._joint(flat, ends, label, np.arange(k), k, 1 / 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {5, 900} <= set(found.tolist())
    assert most < 24e6
    for stripe in (100, k):
        monkeypatch.setattr(toxicity, "STRIPE", stripe, raising=False)
        assert toxicity._joint(flat, ends, label, np.arange(k), k, 1 / 3).tolist() == found.tolist()


def smallest_reachable(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent) if find(x) != x}


def test_components_end_where_all_are_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: written.append(name) or f(df, name))
    rng = np.random.default_rng(4)
    stars = [(int(b), 10 * (k // 9)) for k, b in enumerate(rng.integers(1000, 2**40, 60))]
    cases = {
        "none": ([], 1),
        "stars": ([*stars, (7, 7), stars[0]], 1),
        "a hub that is not the least": ([(500, x) for x in (3, 8, 600, 700)], 2),
        "a chain": ([(x, x + 1) for x in range(40)], 8),
        "at random": ([tuple(x) for x in rng.integers(0, 300, (280, 2)).tolist()], 8),
        "a clique and repeats": ([(a, b) for a in range(9) for b in range(9)], 2),
    }
    for name, (edges, most) in cases.items():
        written.clear()
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted(smallest_reachable(edges).items()), name
        assert len(written) <= most, name
