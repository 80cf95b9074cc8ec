"""The neighbour graph against brute force, and the layout's trustworthiness."""

import numpy as np
import pytest

from preflux.operators import neighbours, visual


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "row_index long, e array<double>")


def clusters(n=900, d=10, k=12, seed=0):
    r = np.random.default_rng(seed)
    return r.normal(size=(k, d))[np.arange(n) % k] * 3 + r.normal(size=(n, d))


def nearest(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return d.argsort(1, kind="stable")[:, :k]


def test_graph_in_one_block_is_exact(spark):
    x = clusters(200)
    got = {(r.row_index, r["rank"]): r.neighbour for r in neighbours.knn_graph(frame(spark, x), 6).collect()}
    assert got == {(i, j + 1): int(n) for i, row in enumerate(nearest(x, 6)) for j, n in enumerate(row)}
    assert neighbours.knn_graph(frame(spark, x[:3]), 6).count() == 6
    assert neighbours.knn_graph(frame(spark, x[:1]), 6).count() == 0 == neighbours.knn_graph(frame(spark, x[:1]).limit(0), 6).count()


def test_descent_recalls_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    x = clusters()
    graph = neighbours.knn_graph(frame(spark, x), 8).collect()
    want = nearest(x, 8)
    found = np.mean([r.neighbour in want[r.row_index] for r in graph])
    print("recall", found)
    assert len(graph) == 8 * len(x) and found >= 0.9
    assert all(abs(r.distance - np.linalg.norm(x[r.row_index] - x[r.neighbour])) < 1e-9 for r in graph)


def trustworthiness(x, y, k=8):
    near, n = nearest(y, k), len(x)
    place = np.empty((n, n), int)
    for i, row in enumerate(nearest(x, n - 1)):
        place[i, row] = np.arange(1, n)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, place[i, j] - k) for i in range(n) for j in near[i])


def test_layout_keeps_neighbours_better_than_two_components(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LAYOUT_BLOCK", 150)
    x = clusters(400)
    rows = frame(spark, x)
    start = visual.project(rows, *visual.fit_pca(rows, 2))
    out = neighbours.layout(neighbours.knn_graph(rows, 8), start, 8)
    of = lambda df: np.array([(r.x, r.y) for r in df.orderBy("row_index").collect()])
    a, b = trustworthiness(x, of(out)), trustworthiness(x, of(start))
    print("trustworthiness", a, b)
    assert len(of(out)) == 400 and a > b and a > 0.85


@pytest.mark.parametrize("k", [2, 8])
def test_fuzzy_weights(spark, k):
    x = clusters(60)
    w = {(r.row_index, r.neighbour): r.weight for r in neighbours.fuzzy_union(neighbours.knn_graph(frame(spark, x), k), k).collect()}
    assert all(0 < v <= 1 + 1e-12 and abs(w[j, i] - v) < 1e-12 for (i, j), v in w.items())
    assert all(abs(w[i, int(n)] - 1) < 1e-9 for i, (n, *_) in enumerate(nearest(x, k)))


def test_exact_graph_is_brute_force_over_waves(spark, monkeypatch):
    """Clusters that a descent may miss, many equal vectors, several waves: every neighbour is the right one, ties by id."""
    monkeypatch.setattr(neighbours, "WAVE_BYTES", 10_000)
    x = np.vstack([clusters(300), np.ones((40, 10)), np.zeros((1, 10))])
    got = {(r.row_index, r["rank"]): r.neighbour for r in neighbours.exact_graph(frame(spark, x), 5).collect()}
    assert got == {(i, j + 1): int(n) for i, row in enumerate(nearest(x, 5)) for j, n in enumerate(row)}
    assert neighbours.exact_graph(frame(spark, x[:3]), 5).count() == 6 and neighbours.exact_graph(frame(spark, x[:1]), 5).count() == 0
    assert neighbours.exact_graph(frame(spark, x[:1]).limit(0), 5).count() == 0


def test_groups_together_give_what_each_gives_alone():
    """Stacks of groups against one group at a time; edges beyond a row's reach are left out."""
    r = np.random.default_rng(3)
    group = np.sort(r.integers(0, 40, 300))
    ids = np.concatenate([r.choice(1_000, n, replace=False) for n in np.unique(group, return_counts=True)[1]])
    x = r.normal(size=(300, 6))
    far = np.where(np.arange(300) % 3 == 0, 2.0, np.inf)
    got = sorted(zip(*neighbours._nearest_in_groups(group, ids, x, far, 4), strict=True))
    want = []
    for g in np.unique(group):
        own = group == g
        reach = dict(zip(ids[own], far[own], strict=True))
        want += [e for e in zip(*neighbours._nearest(ids[own], x[own], 4).to_pydict().values(), strict=True) if e[2] <= reach[e[0]]]
    assert [e[:2] for e in got] == [e[:2] for e in sorted(want)] and np.allclose([e[2] for e in got], [e[2] for e in sorted(want)])
