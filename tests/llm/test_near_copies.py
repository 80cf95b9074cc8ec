"""Near copies against brute-force Jaccard similarity, as classes and as the pipeline's stage."""

import random

import numpy as np

import corpus_pipeline as cp
from preflux.llm import near_copies


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_stay(rows):
    """Ids that stay of rows (id, text), ids in order."""
    label = {i: i for i, _ in rows}
    sets = [(i, shingle_set(t)) for i, t in rows]

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return {i for i in label if find(i) == i}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return " ".join(words)


def corpus():
    """Pairs at every similarity, a cluster of many edited copies, and texts with a long common passage."""
    r, out = random.Random(4), []
    for k in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice((8, 40, 150, 400)))]
        out += [" ".join(base), edited(r, base, 1 + len(base) * (k % 12) // 200), " ".join(base).upper()]
    hub = [f"h{i}" for i in range(120)]
    out += [edited(r, hub, e) for e in (1, 2, 3, 4) for _ in range(30)]
    common = [f"c{i}" for i in range(60)]
    out += [" ".join(common + [f"o{r.randrange(10**6)}" for _ in range(r.randrange(8, 25))]) for _ in range(60)]
    out += [None, "", " \n", "one", "One", "one two three"]
    r.shuffle(out)
    return list(enumerate(out))


def stay(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in dict(cp.STAGES)["SimHash near-dedup"](spark, docs, "").collect()}


def test_stage_against_brute_jaccard(spark):
    rows = corpus()
    assert stay(spark, rows) == brute_stay(rows)


def test_stage_on_documents(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert stay(spark, rows) == brute_stay(rows)


def test_blocks(spark):
    """Blocks of a few rows give the same classes."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.key: r.component for r in near_copies.near_copies(docs, "doc_id", "text", block_rows=3).collect()}
    assert {i for i, c in classes.items() if i == c} == brute_stay(rows)


def test_sketches_rule_out_no_pair():
    """Bits that differ, at any width, are no more than the shingles that one set lacks."""
    r = np.random.default_rng(3)
    for n in (1, 5, 40, 700, 9000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0, 0.05, 0.2, 0.5):
            b = np.unique(np.r_[a[int(n * share) :], r.integers(0, 1 << 63, int(n * share) + 1, dtype=np.uint64)])
            x, y = near_copies.parity_sketch(a), near_copies.parity_sketch(b)
            while len(x) != len(y):
                x, y = (near_copies.folded(x), y) if len(x) > len(y) else (x, near_copies.folded(y))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_a_hot_group_gives_few_links(spark, monkeypatch):
    """Near copies that share many bands come to the components with two links a row at most, and SimHash is asked first."""
    r, sizes, asked = random.Random(7), [], []
    components, pairs = near_copies.connected_components, near_copies._simhash_pairs
    monkeypatch.setattr(near_copies, "connected_components", lambda links: sizes.append(links.count()) or components(links))
    monkeypatch.setattr(near_copies, "_simhash_pairs", lambda *a: asked.append(1) or pairs(*a))
    hub = [f"h{i}" for i in range(200)]
    rows = [(i, edited(r, hub, 1 + i % 3)) for i in range(150)]
    classes = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert asked == [1] and len(classes) == 150 and len({c.component for c in classes}) == 1
    assert max(sizes) <= 2 * len(rows)
