import numpy as np

from preflux.config import PreferenceConfig
from preflux.operators import gp, learner
from preflux.streaming import sessions
from preflux.streaming.ratings import follow_ratings


def test_follow(spark, tmp_path):
    spark.createDataFrame([(5, 1.0, 0), (6, -1.0, 1), (5, 0.0, 2), (None, 1.0, 3)], "row_index long, rating double, seq long").write.parquet(f"{tmp_path}/in")
    s, fits = learner.Session(), []
    q = follow_ratings(spark.readStream.schema("row_index long, rating double, seq long").parquet(f"{tmp_path}/in"), s, f"{tmp_path}/ck", lambda x: fits.append(len(x.ratings)))
    q.processAllAvailable()
    q.stop()
    assert dict(zip(s.rated_indices, s.ratings, strict=True)) == {5: 1.0, 6: -1.0} and fits[-1] == 2


def _catalogue(spark, n=40):
    r = np.random.default_rng(0)
    x = r.normal(size=(n, 5))
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "row_index long, e array<double>")


def _write(spark, path, rows):
    spark.createDataFrame(rows, "user long, item long, rating double, seq long").coalesce(1).write.mode("append").parquet(path)


def test_sessions_append_instead_of_fitting_and_survive_a_restart(spark, tmp_path):
    """Two runs from one checkpoint give the session of one run; weights and likelihood are those of a fit from scratch, to 1e-8."""
    x, catalogue = _catalogue(spark)
    config = PreferenceConfig(length_scale=1.4, variance=1.1, noise=0.2)
    first = [(u, (7 * u + k) % 40, float(k % 3 - 1), k) for u in (1, 2) for k in range(12)] + [(1, 7, 5.0, 99), (1, None, 1.0, 3), (2, 900, 1.0, 4)]
    second = [(1, 30, 1.0, 200), (1, 31, -1.0, 201), (3, 5, 1.0, 202), (2, 14, 9.0, 203)]
    src, out, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    _write(spark, src, first)
    stream = lambda: sessions.follow_sessions(spark.readStream.schema("user long, item long, rating double, seq long").parquet(src), catalogue, config)
    before = {r.user: r for r in sessions.run_to_end(spark, stream(), ck, out).collect()}
    assert {u: r.n for u, r in before.items()} == {1: 12, 2: 12}
    _write(spark, src, second)
    after = {r.user: r for r in sessions.run_to_end(spark, stream(), ck, out).collect()}
    assert {u: r.n for u, r in after.items()} == {1: 14, 2: 12, 3: 1} and after[1].rated == before[1].rated + [30, 31]
    at_once = {r.user: r for r in sessions.run_to_end(spark, stream(), f"{ck}2", f"{out}2").collect()}
    for u, r in after.items():
        want = gp.fit(x[r.rated], np.array(r.ratings), 1.4, 1.1, 0.2)
        assert np.allclose(r.alpha, want.alpha, atol=1e-8) and abs(r.lml - want.lml) < 1e-8
        assert r.rated == at_once[u].rated and np.allclose(r.alpha, at_once[u].alpha)


def test_next_items_of_sessions(spark, monkeypatch):
    """Picks equal those of a full fit, in one wave and in several, ties to the lowest row."""
    x, catalogue = _catalogue(spark)
    config = PreferenceConfig(length_scale=1.4, noise=0.2)
    rows = []
    for user, items in ((1, [3, 4, 5, 9]), (2, [0]), (3, list(range(40)))):
        s = sessions.RatedItems(config)
        assert s.rate(items[0], 1.0, x[items[0]]) and s.rate(items[0], -1.0, x[items[0]]) is None
        for i in items[1:]:
            s.rate(i, float(i % 2), x[i])
        rows.append(s.summary(user))
    table = spark.createDataFrame([(r["user"], r["n"], r["lml"], r["rated"], r["ratings"], r["alpha"].tolist(), bytearray(r["x"]), bytearray(r["low"])) for r in rows], sessions.SESSION)
    want = set()
    for r in rows[:2]:
        mean, variance = gp.posterior(gp.fit(x[r["rated"]], np.array(r["ratings"]), 1.4, 1.0, 0.2), x)
        free = [i for i in range(40) if i not in r["rated"]]
        want |= {(r["user"], "exploit", max(free, key=lambda i: (round(mean[i], 9), -i))), (r["user"], "explore", max(free, key=lambda i: (round(variance[i], 9), -i)))}
    for size in (64 << 20, 300):
        monkeypatch.setattr(sessions, "WAVE_BYTES", size)
        assert {(r.user, r.kind, r.row_index) for r in sessions.next_items(catalogue, table, config).collect()} == want
