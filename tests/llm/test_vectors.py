"""Exact top-k search and whitening against brute force."""

import numpy as np
import pytest
from oracles import assert_same, connect

from candlewick.llm import eigen, queries, top_k, whitening

NAN, INF = float("nan"), float("inf")


def valid(rows):
    return [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def brute_top(rows, k=5):
    own = list(dict.fromkeys((i, tuple(np.floor(256 * v).astype(int).tolist())) for i, v in valid(rows)))
    width = max((len(x) for _, x in own), default=0)
    own = [(i, (*x, *[0] * (width - len(x)))) for i, x in own]
    out = []
    for q, x in own:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in own if (i, y) != (q, x))
            out += [(q, at, None if null else i, -s) for at, (s, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def searched(df, **how):
    found = top_k.top_k(df, **how)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, x string, block int"


def test_top_k_equals_sql(spark, sf):
    assert_same(queries.op12_top_k(spark, sf), connect(sf), top_k.ORACLE)


@pytest.mark.parametrize("how", [{}, {"block": 100, "group": 4}])
def test_top_k_of_odd_rows(spark, how):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 800)]  # one vector that many rows share, queries among them
    rows += [(900, [1.0, None] + [0.0] * 4), (901, [NAN] * 6), (902, [INF] * 6), (903, None), (950, None), (None, [0.9] * 6), (None, [0.5] * 6), (904, []), (1000, []), (905, [0.7]), (1050, [3e4] * 6)]
    rows += rows[:60]  # repeats
    rows.append((50, [0.25] * 6))  # a second vector under one id
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA).repartition(6)
    assert searched(df, **how) == brute_top(rows)


def test_top_k_of_large_components(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, -1.0]), (2, [-1e20, 0.0]), (3, [0.0, 5.0])]
    got = searched(spark.createDataFrame([(*r, "", 0) for r in rows], "vec_id long, embedding array<double>, x string, block int"))
    assert [(q, at, i) for q, at, i, _ in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]


def test_top_k_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0], "", 0)], SCHEMA)
    for df in (one, one.limit(0), one.withColumn("embedding", one["embedding"].cast("array<float>")).where("false"), spark.createDataFrame([(1, [1.0], "", 0), (0, None, "", 0)], SCHEMA)):
        assert searched(df) == []


def test_a_query_stops_only_on_proof():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, d, levels = rng.integers(1, 500), rng.integers(1, 12), rng.integers(1, 40)
        x = rng.integers(-9, 10, (n, d)) if rng.random() < 0.5 else rng.normal(0, 40, (n, d)).astype(int)
        ids = rng.permutation(n)
        index = top_k.ImpactIndex(ids, x, levels)
        for q in x[:8]:
            rows, scores = index.search(q, 6)
            best = sorted(zip((-(x @ q)).tolist(), ids.tolist()))[:6]
            assert list(zip((-scores).tolist(), index.ids[rows].tolist())) == best


def reference(rows):
    """Whitening in numpy, by its own eigensolver."""
    own = valid(rows)
    x = np.array([np.floor(64 * v) + 1_000_000 for _, v in own]).astype(int)
    fitted = np.unique(x, axis=0)
    n, total = len(fitted), fitted.sum(0)
    y = fitted - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    z = (x - total / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return own, n, ((n * x - total) ** 2).sum(1), z, values / np.trace(y.T @ y / n)


def test_whitening_equals_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.unionByName(rows.limit(40)).collect()
    rows += [(9001, rows[0][1]), (9002, None), (9003, [NAN] * 64), (9004, [1.0] * 63 + [None]), (9005, [-INF] * 64), (None, rows[7][1])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, "clash") for r in rows], "vec_id long, embedding array<float>, component int, whitened string").repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    own, n, deviation, z, explained = reference([(r[0], r[1]) for r in rows])
    found = got.collect()
    assert len(found) == 16 * len(own) and {r["n"] for r in found} == {n}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    by = {(r["vec_id"], r["component"]): r for r in found}
    signs = [np.sign(by[own[3][0], c]["whitened"] * z[3, c - 1]) for c in range(1, 17)]
    for (i, _), d, one in zip(own, deviation, z, strict=True):
        for c in range(1, 17):
            r = by[i, c]
            assert r["deviation"] == d and abs(r["whitened"] - signs[c - 1] * one[c - 1]) < 1e-8 and abs(r["explained"] / explained[c - 1] - 1) < 1e-9


def test_whitening_of_small_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([(1, None)]).collect() == make([]).collect() == make([(1, [])]).collect() == []
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect() == []  # no variance
    two = make([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [])]).orderBy("vec_id", "component").collect()
    assert {r["component"] for r in two} == {1, 2} and {r["n"] for r in two} == {3} and two[0]["identity_error"] < 1e-9
    line = make([(k, [float(k), float(2 * k)]) for k in range(9)]).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    huge = make([(1, [1e15]), (2, [-1e15])]).collect()
    assert [r["deviation"] for r in huge] == [None, None] and sorted(round(r["whitened"], 9) for r in huge) == [-1, 1]


@pytest.mark.parametrize("kind", ["full", "diagonal", "equal", "zero", "low rank", "two values"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((48, 48))
    q, _ = np.linalg.qr(a)
    low = a[:, :3]
    a = {"full": a @ a.T, "diagonal": np.diag(np.arange(48.0)), "equal": np.eye(48), "zero": np.zeros((48, 48)), "low rank": low @ low.T, "two values": q @ np.diag([5.0] * 20 + [1.0] * 28) @ q.T}[kind]
    a = (a + a.T) / 2
    values, vectors = eigen.leading(a, 16)
    scale = max(1, np.abs(a).max())
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() < 1e-12 * scale * 10
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-11 * scale
