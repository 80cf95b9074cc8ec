"""Language model, personal data, BPE, repeats and quality: against brute force, the library, and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from preflux.llm import bpe, chunks, language_model, pii, quality, substring, suffix_dedup
from preflux.llm.registry import QUERIES


@pytest.fixture
def small_chunks(monkeypatch):
    """Many chunks and buckets even for little data."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 1 << 16)
    for m in (substring, language_model):
        monkeypatch.setattr(m, "BUCKET_HASHES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_PHRASES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 50_000)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 30_000)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- substring dedup


def brute_windows(rows, n=35):
    lists = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + n]) for _, w in lists for k in range(len(w) - n + 1))
    out = Counter()
    for i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        out[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    return out


@pytest.mark.usefixtures("small_chunks")
def test_windows(spark, docs, odd, sf):
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        out = substring.remove_repeats(table).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_windows(rows)
        assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in out)
    assert substring.remove_repeats(odd.limit(0)).count() == 0
    want = {i: (n, g, sha(k.encode())) for i, n, g, k in brute_windows([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_window_dedup"](spark, sf).collect()} == want


# --- repeated strings


def brute_strings(rows, n=100):
    seen, out = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return out


@pytest.mark.usefixtures("small_chunks")
def test_strings(spark, docs, odd, sf):
    r = random.Random(4)
    runs = ["".join(r.choice("ab") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["a" * 500, "ab" * 300, "x" + "ab" * 300, "é" * 200, "z" * 99, "z" * 100, "z" * 100]
    synthetic = spark.createDataFrame(list(enumerate(runs + [a[:150] + b[-180:] for a, b in zip(runs, runs[1:], strict=False)])), "doc_id long, text string")
    for table in (docs, odd, synthetic):
        rows = [(x.doc_id, x.text) for x in table.collect()]
        out = suffix_dedup.remove_repeated_strings(table).collect()
        assert Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in out) == brute_strings(rows)
    assert suffix_dedup.remove_repeated_strings(odd.limit(0)).count() == 0
    want = {i: (n, g, s, sha(k)) for i, n, g, s, k in brute_strings([(x.doc_id, x.text) for x in docs.collect()])}
    assert {x.doc_id: tuple(x)[1:] for x in QUERIES["op9_parsed_suffixes"](spark, sf).collect()} == want


def test_equal_suffixes():
    r = np.random.default_rng(3)
    text = np.tile(r.integers(97, 99, 400), 3).astype(np.uint8)
    starts = np.flatnonzero(r.random(len(text) - 100) < 0.5)
    seen, want = set(), []
    for s in starts:
        want.append(text[s : s + 100].tobytes() in seen)
        seen.add(text[s : s + 100].tobytes())
    assert suffix_dedup.equal_suffixes(text, starts).tolist() == want


def test_packing():
    r = np.random.default_rng(2)
    for n in (1, 2, 1000):
        h = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (chunks.unpack(chunks.pack(h)) == h).all()
        cuts = chunks.bucket_cuts(h, 7)
        assert cuts[0] == 0 and cuts[-1] == len(h) and len(cuts) == 8
    v = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    v[200:210] = v[50:60]
    s = chunks.prefix(v)
    a, b = chunks.rolling(s, np.array([50, 200]), np.array([60, 210]))
    assert a == b and a != chunks.rolling(s, np.array([51]), np.array([61]))[0]


# --- language model


def brute_scores(rows):
    texts = [(i, (t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False) for i, t in rows]
    c, b, d = Counter(), Counter(), 0
    for _, w, held in texts:
        if not held:
            c.update(w)
            b.update(zip(["start", *w], w, strict=False))
            d += 1
    n, v, k, out = sum(c.values()), len(c), language_model.PRIOR, []
    for i, w, held in texts:
        base = score = 0.0
        before = "start"
        for x in w:
            p = (c[x] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((b[before, x] + k * p) / ((d if before == "start" else c[before]) + k))
            before = x
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


@pytest.mark.usefixtures("small_chunks")
def test_scores(spark, docs, odd):
    law = "crc32(cast(doc_id as string)) % 7 = 2"
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = sorted(map(tuple, language_model.score_texts(table, law).collect()), key=str)
        want = brute_scores(rows)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-10, atol=1e-9)
    assert language_model.score_texts(odd.limit(0), law).count() == 0
    assert {r.score for r in language_model.score_texts(odd.limit(3), "true").collect()} <= {0.0, *(r.base_score for r in language_model.score_texts(odd.limit(3), "true").collect())}


def test_model_is_a_distribution_and_helps(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [r for r in brute_scores(rows) if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    a = language_model.BackoffAutomaton(np.array([3, 5, 0]), np.array([2, 1, 0]), 3, 8, 2)
    # State of word 1, seen 5 times, with arcs to words 0 (twice) and 1 (once); the rest backs off.
    p = 10 ** a.traverse(np.array([1, 0, 1, 1, 1, 2]), np.array([2, 0, 2, 1, 2, 2]), np.array([0, 2, 4]))
    root = np.array([4, 6, 1]) / 11
    assert np.allclose(p[[1, 3, 5]], ([2, 1, 0] + 4 * root) / 9) and np.isclose(root.sum(), 1)


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def library_rows(library, rows):
    out = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    return out


def test_bpe(spark, docs, odd, library, sf):
    for table in (docs, odd):
        got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(table, bpe.vocabulary_path()).collect())
        assert got == library_rows(library, [(r.doc_id, r.text) for r in table.collect()])
    assert bpe.encode(odd.limit(0), bpe.vocabulary_path()).count() == 0
    want = {i: (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(d.encode())) for i, ids, d in library_rows(library, [(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_pair_index_bpe"](spark, sf).collect()} == want


def test_bpe_strings(library):
    r = random.Random(1)
    parts = ["'s", "'RE", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ", "İ", "ß", "é", "\x1c", "\x85", " ", "漢字", "😀", "½", "٣", "aaaa", "don't", "\0", "_", "--", " ", "\n", "the", "ing"]
    texts = ["", "a" * 3000, *("".join(r.choice(parts) for _ in range(r.randint(1, 20))) for _ in range(2000))]
    ids, decoded = bpe.PairIndexBPE(bpe.vocabulary_path()).encode_batch(texts)
    for t, e, i, d in zip(texts, library.encode_batch(texts, add_special_tokens=False), ids, decoded, strict=True):
        assert np.frombuffer(i, "<u4").tolist() == e.ids, t
        assert library.decode(e.ids, skip_special_tokens=False) == d


# --- personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in p.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(3)
    for k in range(20_000):
        t = "".join(r.choice("aB1203.@-+ ()%_é" if k % 2 else "4 -0123456789.+") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 50_000, "a@" * 100_000):
        pii.base_spans(t)  # in time that follows the length


def test_field():
    field = pii.trained_field()
    table = pii._labelled()
    assert sum((a == np.array(y)).all() for (x, y), a in zip(table, field.decode([x for x, _ in table]), strict=True)) >= 0.95 * len(table)
    fresh = {
        "we paid with 4000 1234 5678 9010 then": [(13, 2, 32)], "ask sue(at)mail3.example.net please": [(4, 0, 29)], "token = \"9f8e7d6c5b4a39281706f5e4d3c2b1a098765432\" is new": [], "in 2011 and 1987": [], "": [],
        "call +7 (495) 555-0101 now": [(5, 3, 22)], "tel 030-5550199.": [(4, 3, 15)],
    }
    found = dict(zip(fresh, pii.find_spans(field, list(fresh)), strict=True))
    hits = sum(found[t][1] == s for t, s in fresh.items())
    assert hits >= len(fresh) - 1


def test_viterbi_is_exact():
    field = pii.trained_field()
    chains = [["call", "+1", "(132)", "555-1352"], ["a1"], ["10.0.0.7", "x@y.z", "4417123456789113"]]
    n = len(pii.LABELS)
    for chain, got in zip(chains, field.decode(chains), strict=True):
        scores = [field.emit[[field.index[f] for f in x if f in field.index]].sum(axis=0) for x in pii.chain_features(chain)]
        best, path = -1e18, None
        for code in range(n ** len(chain)):
            tags = [code // n**k % n for k in range(len(chain))]
            s = field.first[tags[0]] + sum(scores[k][t] for k, t in enumerate(tags)) + sum(field.step[a, b] for a, b in zip(tags, tags[1:], strict=False))
            if s > best:
                best, path = s, tags
        assert got.tolist() == path


def test_pii_query(spark, docs, odd, sf):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op3_shape_field"](spark, sf).collect():
        base = brute_spans(text[r.doc_id])
        names = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == sha(",".join(names).encode()) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for _, x, _ in base) for i in range(4)]
        assert set(names) <= set(r.spans.split(","))
    out = pii.with_spans(odd).collect()
    assert Counter((r.doc_id, r.text, r.w) for r in out) == Counter((r.doc_id, r.text, r.w) for r in odd.collect())
    last = next(r for r in out if r.doc_id == 9)
    assert [s.kind for s in last.spans] == ["email", "phone", "ip", "card"] and last.masked_text == "Σ mail [EMAIL] [PHONE] [IP] [CARD]"
    assert pii.with_spans(odd.limit(0)).count() == 0


# --- quality


def brute_statistics(t):
    t = t or ""
    w = t.encode().split()
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if x.encode().split():
            dup += x in lines
            lines.add(x)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall("[#*$%&|<>]", t)), dup, len(covered)


def test_statistics(spark, docs, odd, sf):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op8_decision_list"](spark, sf).collect():
        s = brute_statistics(text[r.doc_id])
        assert tuple(r)[1:6] == s
        assert r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and r.kept == (not r.base_failed and r.rule is None)
    out = quality.with_statistics(odd).collect()
    assert Counter((r.doc_id, r.text, *r.quality_stats[:5]) for r in out) == Counter((r.doc_id, r.text, *brute_statistics(r.text)) for r in odd.collect())
    assert quality.with_statistics(odd.limit(0)).count() == 0


def test_rules(spark):
    """Learned on one part, held against another."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels, "doc_id").where("doc_id % 2 = 1 AND NOT base_failed").select("quality", "rule").collect()
    bad = [r for r in out if r.quality == 0]
    assert sum(r.rule is not None for r in bad) > 0.9 * len(bad)
    clean = [r for r in out if r.quality == 1]
    assert sum(r.rule is not None for r in clean) < 0.01 * len(clean)


def test_rules_edges(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(odd, labels) == []
    out = quality.judge(odd, labels)
    assert out.count() == odd.count() and out.where("kept").count() == out.where("NOT base_failed").count()
    same = {f: np.zeros(40) for f in quality.FEATURES}
    assert quality.learn_rules(same, np.arange(40) % 2 == 0, np.arange(40) % 3 != 0) == []
    x = {f: np.zeros(300) for f in quality.FEATURES} | {"symbol_share": np.r_[np.full(100, 0.5), np.zeros(200)]}
    rules = quality.learn_rules(x, np.arange(300) < 100, np.arange(300) % 3 != 0)
    assert [[(c.feature, c.above) for c in r.conditions] for r in rules] == [[("symbol_share", True)]]
