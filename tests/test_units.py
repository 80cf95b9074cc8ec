"""Hand-made rows for what the tables don't show."""

import json
import unicodedata
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from preflux.config import DEFAULT, PreferenceConfig
from preflux.functions import text as T
from preflux.operators import acquire, benchstats, blr, corpus, gp, impute, interfaces, learner, search, synthetic, visual
from preflux.sources import files, readers, writers

TRICKY = "ﬁrst line “x” ‘y’ – — −\r\nsecond\tline\rthird on\n\n\n\n\n\nlast ß  "


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


def test_normalize_text(spark):
    want = unicodedata.normalize("NFKC", TRICKY)
    for a, b in zip("‘’“”–—−", "''\"\"---", strict=True):
        want = want.replace(a, b)
    want = "\n".join(" ".join(x.split()) for x in want.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()
    while "\n\n\n" in want:
        want = want.replace("\n\n\n", "\n\n")
    assert one(spark, TRICKY, T.normalize_text) == want
    assert one(spark, TRICKY, lambda c: T.loose(T.normalize_text(c))) == " ".join(want.lower().split())
    assert one(spark, "  A  b\n c", T.first_line) == "a  b"
    assert one(spark, None, T.normalize_text) is None


def test_predicates(spark):
    rows = spark.createDataFrame([(None,), ("",), (" Anonymous ",), ("Unknown  Poet",), ("unknown hand",), ("John  KEATS",)], "p string")
    out = rows.select(T.is_missing_poet(F.col("p")), T.is_usable_poet(F.col("p")), T.is_canonical(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [(True, False, False), (True, False, False), (True, False, False), (True, False, False), (False, False, False), (False, True, True)]
    assert len(T.CANONICAL_POETS) == 52
    assert one(spark, "Straße", lambda c: T.contains_literal(c, "strasse")) and not one(spark, "a.c", lambda c: T.contains_literal(c, "abc"))


def test_columns(spark):
    df = spark.createDataFrame([("b", "x", None)], "body string, author string, poem_title string")
    assert readers.detect_columns(df) == readers.DetectedColumns(None, "poem_title", "author", "body")
    assert readers.canonicalize(df).first().asDict() == {"poem_id": "0", "title": "", "poet": "x", "text": "b"}
    with pytest.raises(ValueError, match="no text column"):
        readers.detect_columns(df.drop("body"))
    assert readers.parse_names("ALL") is None and readers.parse_names("a, b") == {"a", "b"}
    with pytest.raises(ValueError):
        readers.parse_names(" , ")


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "T", "A", 'x "q"\ny'), (2, None, None, None)], "id long, title string, poet string, text string")
    rows.write.parquet(f"{tmp_path}/a.parquet")
    (tmp_path / "b.jsonl").write_text('{"id": 1, "poem": "hi"}\n{"id": 2, "poem": "ho"}\n')
    (tmp_path / "c.json").write_text('[{"id": 3, "content": "hey"}]')
    (tmp_path / "d.csv").write_text('id,text\n4,"two ""q""\nlines"\n')
    manifest = [{"name": n[0], "kind": "local", "location": f"{tmp_path}/{n}"} for n in ("a.parquet", "b.jsonl", "c.json", "d.csv")] + [{"name": "off", "kind": "x", "location": "y", "enabled": False}]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    specs = readers.load_manifest(f"{tmp_path}/m.json")
    assert specs[0].priority == 100 and len(readers.select_sources(specs)) == 4
    every, audit = readers.load_sources(spark, specs)
    got = {r.poem_id: r.text for r in every.collect()}
    assert got == {"a:1": 'x "q"\ny', "a:2": "", "b:1": "hi", "b:2": "ho", "c:3": "hey", "d:4": 'two "q"\nlines'}
    assert {r.source_name: r.rows_loaded for r in audit.collect()} == {"a": 2, "b": 2, "c": 1, "d": 1}
    assert readers.load_sources(spark, specs, limit=1)[0].count() == 4
    with pytest.raises(ValueError, match="unsupported"):
        readers.scan(spark, readers.SourceSpec("z", "local", "z.xyz"))
    with pytest.raises(ValueError, match="no enabled"):
        readers.select_sources(specs, {"off"})
    hub = readers.SourceSpec("h", "hub", "", split="a.parquet+a.parquet")
    assert readers.scan(spark, hub, str(tmp_path)).count() == 4
    assert set(audit.columns) == {"source_name", "source_kind", "source_location", "rows_loaded", "rows_canonical", "detected_columns"}
    assert {r.source_name for r in readers.load_sources(spark, specs, names={"a", "c"})[1].collect()} == {"a", "c"}


def test_hub_manifest(spark, tmp_path):
    """A manifest of kind ``huggingface`` loads from a folder that mirrors the hub, splits joined by a plus sign."""
    for split, rows in (("train", [("a", "x")]), ("test", [("b", "y"), ("c", None)])):
        spark.createDataFrame(rows, "title string, content string").coalesce(1).write.parquet(f"{tmp_path}/me/poems/{split}")
    manifest = [{"name": "h", "kind": "huggingface", "location": "me/poems", "split": "train+test", "license_family": "cc"}]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    every, audit = readers.load_sources(spark, readers.load_manifest(f"{tmp_path}/m.json"), hub_root=str(tmp_path))
    assert sorted((r.poem_id, r.title, r.text) for r in every.collect()) == [("h:0", "a", "x"), ("h:1", "b", "y"), ("h:2", "c", "")]
    assert audit.first().rows_canonical == 3 and audit.first().source_kind == "huggingface"


def test_file_order(spark, tmp_path):
    """A limit takes the first rows of the file, and rows without an id are numbered in file order."""
    (tmp_path / "a.csv").write_text("id,text\n9,z\n10,y\n1,x\n")
    (tmp_path / "b.jsonl").write_text('{"poem": "z"}\n{"poem": "a"}\n{"poem": "m"}\n')
    a, b = (readers.SourceSpec(n[0], "local", f"{tmp_path}/{n}") for n in ("a.csv", "b.jsonl"))
    assert [r.poem_id for r in readers.load_sources(spark, [a], limit=1)[0].collect()] == ["a:9"]
    assert {r.poem_id: r.text for r in readers.load_sources(spark, [b])[0].collect()} == {"b:0": "z", "b:1": "a", "b:2": "m"}
    assert {r.poem_id: r.text for r in readers.load_sources(spark, [b], limit=2)[0].collect()} == {"b:0": "z", "b:1": "a"}
    rows = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, i int")
    assert {(r.g, r.i) for r in readers.first_rows_by(rows, "g", 2, ["i"]).collect()} == {(g, i) for g in range(3) for i in (g, g + 3)}


def test_each_text_is_normalised_once(spark):
    from preflux.plans import registry

    for name in ("normalize_text", "dedupe_kept", "duplicate_groups", "source_summary"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, (name, plan)


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    writers.write_step(df, str(tmp_path), "scores", 1)
    writers.write_step(df.limit(1), str(tmp_path), "scores", 2)
    assert writers.read_latest(spark, str(tmp_path), "scores").count() == 1
    writers.promote(spark, df, str(tmp_path), "v1")
    assert writers.read_promoted(spark, str(tmp_path)).count() == 3
    writers.append_csv(df, f"{tmp_path}/csv")
    writers.append_csv(df, f"{tmp_path}/csv")
    assert writers.union_csv(spark, [f"{tmp_path}/csv"]).count() == 6
    writers.write_json_lines(df, f"{tmp_path}/jl")
    assert spark.read.json(f"{tmp_path}/jl").count() == 3


def rows_of(spark, rows):
    return readers.with_keys(spark.createDataFrame(rows, "poem_id string, source_name string, source_priority int, title string, poet string, text string"))


def test_dedupe(spark, tmp_path):
    long = "x" * 90
    df = rows_of(spark, [("a:2", "a", 1, "t", "", long), ("a:1", "a", 1, "t", "p", long), ("a:10", "a", 1, "t", "p", long), ("b:1", "b", 0, "", "", long.upper()), ("c:1", "c", 1, "", "", "short")])
    ranked = corpus.rank_duplicates(df)
    assert [r.poem_id for r in ranked.orderBy("dedupe_rank").collect()] == ["b:1", "a:1", "a:10", "a:2"]
    assert {r.stage: r.n_rows for r in corpus.dedupe_summary(df).collect()} == {"input_rows": 5, "after_min_chars": 4, "deduped_rows": 1, "removed_as_duplicates": 3}
    assert [tuple(r) for r in corpus.source_winloss(ranked).collect()] == [("b", "a", 1)]
    assert [tuple(r) for r in corpus.source_overlap(ranked).collect()] == [("a", "b", 1)]
    again = corpus.rank_duplicates(ranked.where("kept_representative").select(df.columns))
    assert again.count() == 1
    writers.overlap_report(corpus.source_overlap(ranked), corpus.source_winloss(ranked), f"{tmp_path}/r.md")
    assert "a / b: 1" in (tmp_path / "r.md").read_text()
    assert corpus.rank_duplicates(df.limit(0)).count() == 0


def test_first_line_tie(spark):
    p = spark.createDataFrame([(0, "b", "L\nx"), (1, "a", "l\ny"), (2, None, "L"), (3, "", ""), (4, "unknown", "alone")], "row_index long, poet string, text string")
    assert [tuple(r) for r in impute.first_line_fill(p).collect()] == [(2, "a")]


def test_similarity(spark):
    rows = [(i, [1.0, 0.01 * i], "a") for i in range(5)] + [(10, [1.0, 0.02], None), (11, [0.0, 1.0], None), (12, [0.0, 0.0], None)]
    v = spark.createDataFrame(rows, "row_index long, e array<double>, poet string")
    out = impute.similarity_fill(v, "poet", 0.95).collect()
    assert [(r.row_index, r.poet_new) for r in out] == [(10, "a")]


def line(i, text, kind="succeeded"):
    return json.dumps({"custom_id": i, "result": {"type": kind, "message": {"content": [{"text": text}]}}})


def test_llm_lines(spark):
    lines = [
        line("poem_0", '{"poet": "P", "title": "T", "confidence": "HIGH"}'), "{bad", line("poem_1", "{bad"), line("poem_1", "[1]"), line("poem_1", "{}", "errored"),
        json.dumps({"custom_id": "poem_1", "result": {"type": "succeeded", "message": {"content": []}}}), line("poem_99", '{"poet": "X", "confidence": "high"}'),
        line("poem_0", '{"poet": "Q", "confidence": "high"}'), line("poem_1", '{"poet": "null", "title": "U", "confidence": "odd"}'), line("x_1", "{}"),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    poems = spark.createDataFrame([(0, "", "", False, False, 0.0, 0.0), (1, "", "", False, False, 0.0, 0.0)], "row_index long, poet string, title string, poet_imputed boolean, title_imputed boolean, poet_imputation_confidence double, title_imputation_confidence double")
    out, stats = impute.apply_llm_results(poems, impute.parse_llm_results(df), 1)
    got = {r.row_index: (r.poet, r.title, r.poet_imputed, r.poet_imputation_confidence) for r in out.collect()}
    assert got == {0: ("P", "T", True, 1.0), 1: ("", "", False, 0.0)}
    assert stats.first().asDict() == {"total_results": 10, "parse_errors": 6, "skipped_low_confidence": 1, "skipped_already_imputed": 1, "applied_poet": 1, "applied_title": 1, "applied_both": 1}
    requests = impute.llm_requests(out.withColumn("text", F.lit("body")), "m").collect()
    assert [r.custom_id for r in requests] == ["poem_1"] and json.loads(requests[0].request)["params"]["model"] == "m"
    assert impute.request_cost(impute.llm_requests(out.withColumn("text", F.lit("b")), "m")).first().n_requests == 1


def data(m=30, d=5, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(m, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True), r.normal(size=m)


def test_gp():
    x, y = data()
    s = gp.fit(x, y, noise=0.1)
    k = gp.kernel(x, x, 1.0, 1.0) + 0.01 * np.eye(len(x))
    assert np.allclose(k @ s.alpha, y)
    mean, var = gp.posterior(s, x)
    assert (var >= 0).all() and (var <= 1).all()
    more = gp.posterior(gp.fit(np.r_[x, x[:1] * 0.5], np.r_[y, 0.0], noise=0.1), x)[1]
    assert (more <= var + 1e-12).all()
    for bad in [(x[0], y), (x, y[:-1]), (x[:0], y[:0])]:
        with pytest.raises(ValueError):
            gp.fit(*bad)
    with pytest.raises(ValueError):
        gp.fit(x, y, noise=0.0)
    with pytest.raises(ValueError):
        gp.posterior(gp.fit(x, y, with_variance=False), x)
    gp.fit(np.zeros((1, 3)), np.ones(1))
    gp.fit(np.ones((2, 3)), np.ones(2))


def test_gp_gradient_and_search():
    x, y = data()
    p = (0.8, 1.3, 0.3)
    g = gp.lml_gradient(x, y, p)
    for i in range(3):
        hi, lo = list(p), list(p)
        hi[i] += 1e-5
        lo[i] -= 1e-5
        numeric = (gp._factor(x, y, tuple(hi))[2] - gp._factor(x, y, tuple(lo))[2]) / 2e-5
        assert abs(numeric - g[i]) < 1e-4
    found, info = gp.optimize(x, y, p)
    assert info["lml"] >= info["start_lml"] and all(a - 1e-9 <= v <= b + 1e-9 for v, (a, b) in zip(found, gp.BOX.values(), strict=True))
    grid = max(gp._factor(x, y, (a, b, c))[2] for a in (0.3, 1, 3) for b in (0.3, 1, 3) for c in (0.1, 0.5, 1))
    assert info["lml"] >= grid - 0.5
    with pytest.raises(ValueError):
        gp.fit(x[:1], y[:1], optimize_hyperparameters=True)


def test_paths_agree(spark):
    x, y = data(8, 4)
    s = gp.fit(x, y)
    c = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data(40, 4, 2)[0])], "row_index long, e array<double>")
    out = benchstats.agreement(gp.score(c, s), gp.score_by_expression(c, s)).first()
    assert out.n == 40 and out.max_abs_mean < 1e-9 and out.max_abs_variance < 1e-9 and out.same_mean_pick


def test_acquire(spark):
    s = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.5, 1.0), (2, 0.5, 1.0)], "row_index long, mean double, variance double")
    ei = {r.row_index: r.score for r in acquire.with_score(s, "expected_improvement", best_rating=0.0).collect()}
    assert ei[0] == 0.0 and abs(ei[1] - 0.6977966) < 1e-6
    assert acquire.top(acquire.with_score(s, "max_variance")).first().row_index == 1
    assert acquire.top(acquire.with_score(s, "max_mean"), excluded=s).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        acquire.with_score(s, "nope")
    with pytest.raises(ValueError, match="variance"):
        acquire.with_score(s.drop("variance"), "ucb")
    acquire.register_strategy("sum", lambda: F.col("mean") + F.col("variance"))
    assert acquire.top(acquire.with_score(s, "sum")).first().row_index == 1


def test_session(spark, tmp_path):
    s = learner.Session.load(f"{tmp_path}/none.json")
    assert s.rate(0, "l") and s.rate(3, "d") and not s.rate(0, "n")
    c = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "row_index long, e array<double>")
    a = learner.ActiveLearner(c, s)
    step = a.step()
    assert step.exploit not in (0, 3) and a.summary(step)["n_rated"] == 2 and s.current_index == step.exploit
    s.save(f"{tmp_path}/ratings_ann.json")
    assert learner.users(str(tmp_path)) == ["ann"] and learner.Session.load(f"{tmp_path}/ratings_ann.json").ratings == [1.0, -1.0]
    (tmp_path / "ratings_bad.json").write_text('{"rated_indices": [1], "ratings": []}')
    with pytest.raises(ValueError):
        learner.Session.load(f"{tmp_path}/ratings_bad.json")
    for i in range(6):
        s.rate(i, 0.0)
    done = a.step()
    assert done.exploit is None and done.explore is None
    assert learner.plan_backend(10, 10) == "expression" and learner.plan_backend(10**6, 100) == "batch"


def test_config():
    assert PreferenceConfig.from_dict(DEFAULT.to_dict() | {"odd": 1}) == DEFAULT


def test_blr(spark):
    x, y = data(20, 3)
    rows = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_index long, e array<double>, y double")
    s = blr.fit(rows)
    d = np.c_[np.ones(20), x]
    assert np.allclose(s.mean, np.linalg.solve(np.eye(4) + d.T @ d, d.T @ y))
    out = blr.predict(rows, s).orderBy("row_index").collect()
    assert all(r.variance >= 1 for r in out) and abs(out[0].mean - d[0] @ s.mean) < 1e-9
    with pytest.raises(ValueError):
        blr.fit(rows, prior_precision=0)


def test_visual(spark):
    three = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.01, 0.0), (2, 1.0, 1.0)], "row_index long, x double, y double")
    assert visual.spaced_points(three, 2) == [0, 2] and visual.spaced_points(three, 5, 0.0) == [0, 1, 2] and visual.spaced_points(three.limit(0), 5) == []
    r = np.random.default_rng(0)
    v = spark.createDataFrame([(i, [float(3 * a), float(a + 0.1 * b), float(b)]) for i, (a, b) in enumerate(r.normal(size=(50, 2)))], "row_index long, e array<double>")
    mean, comp = visual.fit_pca(v, 2)
    assert np.allclose(comp.T @ comp, np.eye(2)) and np.allclose(visual.fit_pca(v, 3)[1], np.eye(3))
    p = np.array([[x.x, x.y] for x in visual.project(v, mean, comp).collect()])
    assert abs(p.mean()) < 1e-9 and p[:, 0].var() > p[:, 1].var()
    e = visual.embed_hashing(spark.createDataFrame([(0, "abc def"), (1, ""), (2, None)], "row_index long, t string"), "t", 8).collect()
    assert len(e) == 3 and all(abs(sum(x * x for x in r.e) - 1) < 1e-9 for r in e)
    kept = visual.downsample(v, v.where("row_index = 49"), 10)
    assert kept.count() == 10 and 49 in {r.row_index for r in kept.collect()}


def test_synthetic_and_interfaces(spark, tmp_path):
    items = synthetic.catalogue(spark, 30, 5, 3)
    same = synthetic.catalogue(spark, 30, 5, 3).repartition(7)
    assert sorted(map(str, items.collect())) == sorted(map(str, same.collect()))
    assert {r.row_index for r in synthetic.ratings(items, 10).collect()} == {r.row_index for r in synthetic.ratings(same, 10).collect()}
    xy = interfaces.PCAReducer().fit(items).transform(items)
    assert xy.columns == ["row_index", "x", "y"] and xy.count() == 30
    made = []
    for fresh in (False, False, True):
        out = learner.reuse_scores(spark, str(tmp_path), "scores", lambda: made.append(1) or xy, fresh)
    assert len(made) == 2 and out.count() == 30
    texts = spark.createDataFrame([(0, "a b"), (1, "")], "row_index long, t string")
    assert interfaces.HashingEncoder(8).encode(texts, "t").count() == 2


def test_files_follow_the_path(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    assert files.names(root) == [] and not files.exists(root)
    files.write_text(f"{root}/é.txt", "long text é\n")
    files.write_text(f"{root}/é.txt", "é\n")
    assert files.read_text(f"{root}/é.txt") == "é\n" and "é.txt" in files.names(root)
    learner.Session(3, [1, 3], [1.0, -1.0]).save(f"{root}/ratings_bo.json")
    assert learner.users(root) == ["bo"] and learner.Session.load(f"{root}/ratings_bo.json").rated_indices == [1, 3]


def test_promotion_keeps_the_original(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(5).write.parquet(f"{root}/vectors")
    assert writers.promote(spark, spark.range(3), root, "v1") == []
    with pytest.warns(UserWarning, match="centroids"):
        assert writers.promote(spark, spark.range(4), root, "v2", {"vectors": f"{root}/vectors", "centroids": f"{root}/none"}) == ["centroids"]
    assert writers.read_promoted(spark, root).count() == 4 and writers.read_promoted(spark, root, original=True).count() == 3
    assert writers.read_promoted(spark, root, "vectors").count() == 5


def test_search(spark):
    poems = spark.createDataFrame([(0, "a:1", "Ode", "Keats"), (1, "a:2", "To the Ode", "Clare"), (2, "a:3", None, None)], "row_index long, poem_id string, title string, poet string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])], "row_index long, e array<double>")
    assert search.find_row(poems, poem_id="a:3") == 2 and search.find_row(poems, title="ODE") == 0 and search.find_row(poems, title="the o") == 1
    for wrong in ({}, {"poem_id": "x"}, {"title": "sonnet"}):
        with pytest.raises(ValueError):
            search.find_row(poems, **wrong)
    assert [r.row_index for r in search.nearest_to_row(vectors, 0, 5).collect()] == [1, 2]
    assert [r.row_index for r in search.nearest_to_row(vectors, 0, 1, exclude_self=False).collect()] == [0]
    with pytest.raises(ValueError):
        search.nearest_to_row(vectors, 9, 1)
    encoder = interfaces.HashingEncoder(2)
    got = search.nearest_to_phrase(poems, vectors, "a phrase", encoder, 5, "CLAR").collect()
    assert [r.row_index for r in got] == [1]
    with pytest.raises(ValueError):
        search.nearest_to_phrase(poems, vectors, "a phrase", encoder, 5, "nobody")


def test_must_keep(spark):
    flags = ["is_rated", "is_current", "is_exploit", "is_explore"]
    rows = [(i, float(i), *[i == k for k in range(4)]) for i in range(9)]
    f = spark.createDataFrame(rows, "row_index long, x double, " + ", ".join(f"{c} boolean" for c in flags))
    assert {r.row_index for r in visual.must_keep(f).collect()} == {0, 1, 2, 3}
    assert {0, 1, 2, 3} < {r.row_index for r in visual.downsample(f, visual.must_keep(f), 6).collect()}


def test_lower_solves():
    low = np.linalg.cholesky(gp.kernel(*[data(150, 20)[0]] * 2, 1.0, 1.0) + 0.1 * np.eye(150))
    b = np.arange(150.0)
    assert np.allclose(low @ gp.lower_solve(low, b), b) and np.allclose(low.T @ gp.upper_solve(low, b), b)
    assert np.allclose(low @ gp.lower_inverse(low), np.eye(150))


def test_normal_cdf():
    """Against the error function, far tails included."""
    import math

    z = np.r_[np.linspace(-37, 12, 2000), -5.0, 0.0, 5.0]
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    assert np.allclose(acquire._normal_cdf(z), want, rtol=1e-10, atol=0)


def test_moments_against_numpy(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(3, 1, (70, 5)), r.normal(size=70)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_index long, e array<double>, y double").repartition(3)
    got = {(c.i, c.j): c.value for c in blr.moments(rows, "e", "y", True).collect()}
    one = np.hstack([np.ones((70, 1)), x])
    assert np.allclose([[got[i, j] for j in range(6)] for i in range(6)], one.T @ one) and np.allclose([got[i, -1] for i in range(6)], one.T @ y)
    cov = {(c.i, c.j): c.value for c in visual.covariance(rows).collect()}
    assert np.allclose([[cov[i, j] for j in range(5)] for i in range(5)], np.cov(x.T))
    assert blr.moments(rows.limit(0), "e").count() == 0 and visual.covariance(rows.limit(0)).count() == 0


def test_step_options(spark):
    """Flags, block size and backend act on a step."""
    items = synthetic.catalogue(spark, 60, 8)
    base = PreferenceConfig(block_size=7)
    s = lambda c: learner.Session(rated_indices=[1, 2, 3], ratings=[1.0, -1.0, 0.0], config=c)
    batch, expression = (learner.ActiveLearner(items, s(replace(base, score_backend=b))).step() for b in ("batch", "expression"))
    assert (batch.exploit, batch.explore) == (expression.exploit, expression.explore)
    assert "variance" not in learner.ActiveLearner(items, s(replace(base, compute_variance=False, exploration_strategy="none"))).step().scored.columns
    with pytest.raises(ValueError, match="variance"):
        learner.ActiveLearner(items, s(replace(base, compute_variance=False))).step()


def test_nearest_centroids_skip_far_balls(spark, monkeypatch):
    """The best centroid of each row, ties to the smallest name, by a small share of all dot products."""
    monkeypatch.setattr(impute, "BALL", 8)
    monkeypatch.setattr(impute, "SHARE", 50)
    r = np.random.default_rng(2)
    middle = r.normal(size=(20, 8))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit(middle[np.arange(200) % 20] + 0.02 * r.normal(size=(200, 8)))
    c[7] = c[27]
    q = np.vstack([unit(c[np.arange(120)] + 0.02 * r.normal(size=(120, 8))), unit(r.normal(size=(30, 8))), np.zeros((1, 8))])
    centroids = spark.createDataFrame([(f"p{i:03}", x) for i, x in enumerate(c.tolist())], "poet_new string, centroid array<double>")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(q.tolist())], "row_index long, u array<double>")
    s = q @ c.T
    for least in (0.9, 0.0):
        got = {x.row_index: (x.poet_new, round(x.similarity, 9)) for x in impute.nearest_centroids(rows, centroids, least).collect()}
        assert got == {i: (f"p{v.argmax():03}", round(v.max(), 9)) for i, v in enumerate(s) if v.max() >= least}
    done, every = impute.centroid_figures(rows, centroids, 0.9)
    assert every == 151 * 200 and 0 < done < every / 4
    assert impute.nearest_centroids(rows, centroids.limit(0), 0.5).count() == 0


def test_heatmap_joins_nothing(spark):
    p = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 2.0, 3.0), (None, 1.0, 1.0)], "x double, y double, value double")
    h = visual.heatmap(p, 4, 0.2)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
    z = {(r.gx, r.gy): r.z for r in h.collect()}
    assert len(z) == 16 and abs(z[0, 0] - 1.0) < 1e-6 and abs(z[3, 3] - 3.0) < 1e-6
    assert visual.heatmap(p.limit(0), 4, 0.2).count() == 0


def test_spaced_points_are_the_greedy_ones(spark):
    """Rounds over cells give what one pass in order gives, canonical points or not."""
    r = np.random.default_rng(4)
    xy = np.round(r.normal(size=(700, 2)), 2)
    rows = spark.createDataFrame([(i, float(x), float(y), i % 90 == 5) for i, (x, y) in enumerate(xy)] + [(900, None, 1.0, False)], "row_index long, x double, y double, is_canonical boolean")

    def greedy(ids, k, spacing):
        gap, out = spacing * np.sqrt(np.ptp(xy[ids], axis=0) @ np.ptp(xy[ids], axis=0)), []
        for i in ids:
            if len(out) < k and all(np.hypot(*(xy[i] - xy[j])) >= gap for j in out):
                out.append(i)
        return out

    every = list(range(700))
    for k, spacing in ((12, 0.04), (200, 0.1), (3, 0.5), (1000, 0.04)):
        assert visual.spaced_points(rows, k, spacing) == greedy(every, k, spacing)
    canonical = [i for i in every if i % 90 == 5]
    assert visual.label_points(rows, 20) == sorted(canonical + greedy([i for i in every if i % 90 != 5], 20 - len(canonical), 0.04))
    assert visual.label_points(rows, 3) == canonical[:3]


def test_hub_layout(spark, tmp_path):
    """Shards, folders and lone files by split, splits joined, columns pruned in the scan, a dataset that names no split."""
    root = tmp_path / "hub"

    def put(place, name, rows):
        (root / place / name).parent.mkdir(parents=True, exist_ok=True)
        parquet.write_table(pa.table({"title": [r[0] for r in rows], "content": [r[1] for r in rows]}), root / place / name)

    put("me/poems", "data/train-00000-of-00002.parquet", [("a", "x")])
    put("me/poems", "data/train-00001-of-00002.parquet", [("b", "y")])
    put("me/poems", "data/validation-00000-of-00001.parquet", [("c", "z")])
    put("me/poems", "data/test-00000-of-00001.parquet", [("d", "w")])
    put("you/plain", "all.parquet", [("e", "v")])
    put("you/dirs", "en/test/0.parquet", [("f", "u")])
    (root / "you/dirs/en/train").mkdir(parents=True)
    (root / "you/dirs/en/train/0.csv").write_text("title,content\ng,t\n")
    (root / "you/dirs/README.json").mkdir()
    spec = lambda place, split="train", **extra: readers.SourceSpec("h", "huggingface", place, split=split, extra=extra)
    titles = lambda s: sorted(r.title for r in readers.scan(spark, s, str(root)).collect())
    assert titles(spec("me/poems")) == ["a", "b"] and titles(spec("me/poems", "train+validation")) == ["a", "b", "c"] and titles(spec("me/poems", "test")) == ["d"]
    assert titles(spec("you/plain")) == ["e"] and titles(spec("you/dirs", "train+test", data_dir="en")) == ["f", "g"]
    with pytest.raises(ValueError, match="no files"):
        titles(spec("me/poems", "extra"))
    with pytest.raises(ValueError, match="no files"):
        titles(spec("you/plain", "test"))
    plan = readers.scan(spark, spec("me/poems"), str(root)).select("title")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<title:string>" in plan


def test_hashed_texts_shuffle_nothing(spark):
    """One narrow pass, the same cells as Spark's own hash of every gram."""
    docs = spark.createDataFrame([(0, "Abc déf abc"), (1, " \n"), (2, None), (3, "x")], "row_index long, t string")
    out = visual.embed_hashing(docs, "t", 8)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    grams = {0: [" ab", "abc", "bc "] * 2 + [" dé", "déf", "éf "], 1: [""], 2: [""], 3: [" x "]}
    hashes = {r.g: r.h for r in spark.createDataFrame([(g,) for v in grams.values() for g in v], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    for r in out.collect():
        want = np.zeros(8)
        for g in grams[r.row_index]:
            want[hashes[g] % 8] += -1.0 if hashes[g] < 0 else 1.0
        assert np.allclose(r.e, want / max(np.linalg.norm(want), 1e-300))


def test_few_texts_are_strings_at_once(monkeypatch):
    """However many rows a batch has, no more than ROWS of them are turned into Python strings together."""
    seen = []
    monkeypatch.setattr(T, "ROWS", 3)
    monkeypatch.setattr(T, "_tidy", lambda x: seen.append(x) or x)
    monkeypatch.setattr(T, "_loose", lambda x: seen.append("|") or x)
    columns = [pa.array([f"{c}{i}" for i in range(8)]) for c in "abc"]
    out = T._tidy_fields.func(*columns)
    assert len(out) == 8 and out.field("text").to_pylist() == columns[2].to_pylist()
    assert max(len([x for x in run if x]) for run in " ".join(map(str, seen)).split("|") for run in [run.split()]) <= 3
    assert len(T._tidy_fields.func(*[c.slice(0, 0) for c in columns])) == 0
