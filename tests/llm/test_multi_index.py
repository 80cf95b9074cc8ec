"""The inverted multi-index against brute force: exact links, measured recall, classes of copies."""

import math

import numpy as np
import pytest

from preflux.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, node long, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "v", 3, 4) for i, x in rows], SCHEMA)


def brute(rows, least=0.95):
    """(links, component's smallest id) of each row, by all cosines."""
    width = max((len(x) for _, x in rows if x), default=1)
    good = [k for k, (_, x) in enumerate(rows) if x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    u = np.array([rows[k][1] + [0.0] * (width - len(rows[k][1])) for k in good]).reshape(len(good), width)
    u = u / np.abs(u).max(1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(good))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(good)).min(1, initial=len(good)))
        if (new == label).all():
            break
        label = new
    links, parts = [0] * len(rows), [i for i, _ in rows]
    for c in set(label.tolist()):
        members = [good[k] for k in np.flatnonzero(label == c)]
        least_id = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        for k in members:
            parts[k] = least_id
    for k, n in zip(good, near.sum(1).tolist(), strict=True):
        links[k] = n
    return links, parts


def clustered(seed=1, noise=0.12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(1200, 16))
    x[300:800] = x[r.integers(0, 60, 500)] + noise * r.normal(size=(500, 16)) * np.linalg.norm(x[0]) / 4
    x[800:900] = x[5] * r.uniform(0.5, 3, 100)[:, None]
    return [(int(i), row) for i, row in zip(r.permutation(5000)[: len(x)], x.tolist(), strict=True)] + [(9000 + i, x[7].tolist()) for i in range(300)]


def by_id(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_links_are_exact_and_recall_is_high(spark):
    rows = clustered()
    links, parts = brute(rows)
    got = by_id(M.near_vectors(table(spark, rows)))
    assert len(got) == len(rows)
    found = sum(got[i][0] for i, _ in rows)
    assert all(got[i][0] <= n for (i, _), n in zip(rows, links, strict=True))
    assert found >= 0.98 * sum(links) and sum(links) > 100_000
    assert sum(got[i][1] == p for (i, _), p in zip(rows, parts, strict=True)) >= 0.98 * len(rows)
    assert all(kept == (component == i) for i, (_, component, kept) in got.items())


def test_blocks_of_a_crowded_cell_give_the_same(spark, monkeypatch):
    df = table(spark, clustered())
    whole = by_id(M.near_vectors(df))
    monkeypatch.setattr(M, "BLOCK", 20)
    monkeypatch.setattr(M, "EMIT", 64)
    assert by_id(M.near_vectors(df)) == whole


def test_wide_slack_finds_every_link(spark):
    """With a target of all pairs of a noisier table, counts and components are those of brute force."""
    rows = clustered(2, 0.05)
    links, parts = brute(rows)
    got = by_id(M.near_vectors(table(spark, rows), target=1.0))
    assert [got[i][:2] for i, _ in rows] == list(zip(links, parts, strict=True))


def test_odd_rows(spark):
    """Nulls, zeros, non-finite and huge components, short vectors, repeated ids and rows."""
    e = [1.0, 2.0, -1.0, 0.5]
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None]), (5, [math.nan] * 4), (6, [math.inf, 0.0]), (7, e), (7, e), (8, [x * 1e300 for x in e]), (9, [x * 1e-300 for x in e]), (None, e), (None, [5.0, -1.0]), (10, [5.0, -1.0, 0.0, 0.0]), (11, [-x for x in e]), (12, [0.0, 0.0, 0.0, 1.0])]
    out = M.near_vectors(table(spark, rows))
    links, parts = brute(rows)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=str) == sorted(((i, n, p) for (i, _), n, p in zip(rows, links, parts, strict=True)), key=str)
    assert M.near_vectors(table(spark, rows).limit(0)).count() == 0
    assert by_id(M.near_vectors(table(spark, rows[:6])))[3] == (0, 3, True)


def test_recall_on_given_vectors_with_planted_copies(spark, sf):
    """Given vectors at their own size, each fourth with a copy at a cosine between 0.95 and 1."""
    r = np.random.default_rng(0)
    base = [(x.vec_id, list(x.embedding)) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = list(base)
    for i, x in base[::4]:
        x, n = np.array(x), r.normal(size=len(x))
        n -= (n @ x) / (x @ x) * x
        c = r.uniform(0.951, 1.0)
        rows.append((10_000 + i, (c * x / np.linalg.norm(x) + math.sqrt(1 - c * c) * n / np.linalg.norm(n)).tolist()))
    links, _ = brute(rows)
    got = by_id(M.near_vectors(table(spark, rows)))
    assert sum(got[i][0] for i, _ in rows) >= 0.95 * sum(links) > 200


@pytest.mark.parametrize("k", [1, 7])
def test_traversal_visits_all_cells_within_the_slack(k):
    r = np.random.default_rng(k)
    u = r.normal(size=(50, 6))
    u /= np.linalg.norm(u, axis=1)[:, None]
    grid = M.Grid(np.round(r.normal(size=(k, 3)) * 2000), np.round(r.normal(size=(k, 3)) * 2000), 3e6)
    a, b = grid.distances(u)
    rows, cells = grid.visits((a, b))
    want = {(i, x * k + y) for i in range(50) for x in range(k) for y in range(k) if a[i, x] + b[i, y] <= a[i].min() + b[i].min() + 3e6}
    assert set(zip(rows.tolist(), cells.tolist(), strict=True)) == want and len(rows) == len(want)
