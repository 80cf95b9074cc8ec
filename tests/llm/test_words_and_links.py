"""SimHash classes, containment, sharding, url rules: against brute force."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from preflux.llm import decontaminate, graph, registry, sharding, simhash, url_filter


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    u = sorted(parent)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in u}


def check_classes(rows, table):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = brute_classes({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = Counter((i, f, least.get(root[f])) for i, f in fps)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in table.collect()) == want


def test_simhash(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = simhash.near_duplicates(docs)
    check_classes(rows, out)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_vantage_simhash(spark, sf).collect()}
    assert got == {r.doc_id: (f"{r.fp % (1 << 64):016x}", r.component_id) for r in out.collect()}


def test_simhash_odd(odd, empty):
    check_classes([(r.doc_id, r.text) for r in odd.collect()], simhash.near_duplicates(odd))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [4, 40, 10**6])
def test_links_of_clusters(spark, limit):
    """Tight and loose clusters, searched in shards of few rows and in one tree."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base[:8]:
        x = b
        for _ in range(60):
            x = x ^ np.uint64(1 << int(r.integers(64))) ^ np.uint64(1 << int(r.integers(64)))
            fps.append(x)
    fps += [base[9] ^ np.uint64(i) for i in range(300)]
    fps = sorted({int(f) for f in fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    parts = {p.node: p.component for p in graph.connected_components(simhash.fingerprint_links(reps, limit)).collect()}
    root = brute_classes(set(fps))
    least = {}
    for n, f in enumerate(fps):
        least[root[f]] = min(least.get(root[f], n), n)
    assert [parts.get(n, n) for n in range(len(fps))] == [least[root[f]] for f in fps]


def test_trees_search_the_documents(spark):
    """Every group of the middle tables is searched by a tree that visits nodes and leaves pairs out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = simhash.with_fingerprints(docs, "doc_id", "text").groupBy("fp").agg(F.min("id").alias("node"))
    rows = simhash.search_figures(fps).collect()
    assert len(rows) > 5 and sum(r.n for r in rows) == 5 * fps.count()
    assert all(r.visits > 0 for r in rows) and 0 < sum(r.compared for r in rows) < sum(r.n**2 for r in rows)


def test_tree_alone():
    r = np.random.default_rng(7)
    fps = np.unique(np.r_[r.integers(0, 1 << 63, 3000, dtype=np.uint64), np.arange(3000, dtype=np.uint64) * np.uint64(7)])
    tree = simhash.VantageTree(fps)
    labels = tree.search()
    a, b = np.arange(len(fps)), labels
    assert tree.visits > 0 and 0 < tree.compared < len(fps) ** 2
    near = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1).tolist()]

    def classes(pairs):
        label = list(range(len(fps)))

        def find(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for x, y in pairs:
            low, high = sorted((find(x), find(y)))
            label[high] = low
        return [find(x) for x in range(len(fps))]

    # Stars may join members of a cluster that are not neighbours, but never two clusters.
    assert near and classes(zip(a.tolist(), b.tolist(), strict=True)) == classes(near)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (102, 100)]
    out = graph.connected_components(spark.createDataFrame(chain, "a long, b long"))
    got = {r.node: r.component for r in out.collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)} and out.count() == 44
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containment_sql(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = Counter(db.execute(registry.ORACLES["op7_benchmark_containment"]).fetchall())
    assert want and Counter(map(tuple, registry.QUERIES["op7_benchmark_containment"](spark, sf).collect())) == want


@pytest.mark.parametrize("limits", [(1_000_000, 48), (0, 48), (0, 1)])
def test_containment_small(spark, monkeypatch, limits):
    """Long documents with many items, short items, ties and nulls; by broadcast, by shuffle, and by postings."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", limits[0])
    monkeypatch.setattr(decontaminate, "BANDS", limits[1])
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(30)] + [(50, "alpha beta"), (51, ""), (52, None), (None, "x y z"), (53, "Alpha, BETA!")]
    cut = items[3][1].split()
    rows = [
        (0, " ".join(t for _, t in items[:30])), (1, "pre " + items[3][1].upper() + ", post"), (2, " ".join(cut[:17])), (3, " ".join(cut[:16])), (3, None), (4, None), (5, ""), (None, items[1][1]),
        (6, "some alpha beta words"), (6, "some alpha beta words"), (7, "alpha x beta"),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shingle int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(d, b).collect())
    assert got == [(0, i) for i in range(30)] + [(1, 3), (2, 3), (6, 50), (6, 53)]
    assert decontaminate.contained_items(d.limit(0), b).count() == 0 and decontaminate.contained_items(d, b.limit(0)).count() == 0


def check_ring(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_ring(spark, sf, docs, odd, empty):
    out = registry.QUERIES["op6_bounded_ring"](spark, sf).collect()
    check_ring(out, docs.count(), 24)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" for r in out)
    few = odd.selectExpr("doc_id", "coalesce(text, '') AS t", "n AS shard", "n AS slot")
    check_ring(sharding.bounded_ring(few, "doc_id", ["t"], 5).collect(), odd.count(), 5)
    assert sharding.bounded_ring(few.limit(0), "doc_id", ["t"], 5).count() == 0


def test_ring_moves_little(spark):
    ids = spark.range(20_000).selectExpr("id", "id AS x")
    a = {r.id: (r.shard, r.home_shard) for r in sharding.bounded_ring(ids, "id", ["x"], 10).collect()}
    b = {r.id: r.shard for r in sharding.bounded_ring(ids, "id", ["x"], 11).collect()}
    assert sum(s == h for s, h in a.values()) > 0.85 * len(a)
    assert sum(a[i][0] == b[i] for i in a) > 0.7 * len(a)  # dealing by id modulo shards would keep a tenth


def test_plan_walks_clockwise():
    nodes = [(1, 0), (5, 1), (9, 0), (12, 2)]
    seg = sharding.plan_segments({0: 7, 1: 1, 3: 1}, nodes, 3)
    assert seg == [(0, 0, 3, 0, 0), (1, 0, 1, 1, 0), (3, 0, 1, 2, 0), (0, 3, 5, 1, 1), (0, 5, 7, 2, 1)]


def brute_rule(host, path):
    best = None
    for h, p, v in url_filter.RULES:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = registry.QUERIES["op10_redirect_rules"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        host, path = split_url(pages[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and r.verdict == (rule[1] if rule else "allow")


def test_url_aliases(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    go = "<meta content='0; url={}' http-equiv=refresh>"
    rows = [
        (0, "https://a.com/x", link.format("https://b.com/y")), (1, "http://b.com/y/", go.format("//bad.net/z")), (2, "https://c.com/", ""), (3, "https://org/fr/p", link.format("http://bad.net/q")),
        (4, "https://d.com/1", link.format("/2")), (5, "https://d.com/2#f", None), (6, None, link.format("http://bad.net/z")), (7, "no scheme", ""), (8, "x://EXAMPLE.net/en/1", ""), (9, "x://m.example.net?q", ""),
        (10, "https://e.com/1", link.format("http://bad.net/q")), (0, "https://a.com/x", link.format("https://b.com/y")),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {
        0: (None, "block"), 1: (None, "block"), 2: (None, "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"),
        8: ("example.net/en/", "allow"), 9: (None, "allow"), 10: (None, "allow"),
    }
    # 3 is allowed by a rule and an alias of 10, so it outweighs the block on their common target.
    assert url_filter.filter_urls(pages).count() == len(rows) and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_simhash_with_more_key_bits(spark, docs, odd, monkeypatch):
    """A table that needs keys of 20 bits and of 27: one group for each choice of two or three untouched parts, the same classes."""
    for rows, choices in ((0.0005, 15), (1e-5, 35)):
        monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
        assert len(simhash.group_keys(200)) == choices
        check_classes([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs))
        check_classes([(r.doc_id, r.text) for r in odd.collect()], simhash.near_duplicates(odd))
    assert len(simhash.group_keys(0)) == 1
