"""The prefix trie against a brute-force one, on the given tables and on odd ones."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from preflux.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, block string, tokens string, ka long"


def ordered(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[conv].append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(role, text) for _, role, _, text in sorted(turns)] for c, turns in out.items()}


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = paths.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    rows = Counter()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        rows[
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below),
                sum(not any(len(m) > len(n) and m[: len(n)] == n for m in below) for n in below),
                sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        ] += 1
    return rows


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    paths = ordered([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(prefix_trie.op11_prefix_owners(spark, sf)) == brute(rebuilt(paths))
    assert rows_of(prefix_trie.conversation_trie(table)) == brute(paths)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, turnless results of the rebuilding, absent bases, a long and a very long conversation."""
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, 1, "ai", "a b"), (0, 2, "", "c")]
    rows += [(c, t, "user", w) for c in range(1, 45) for t, w in enumerate(("hello there", "how\tare you", f"x{c % 3}", None)[: c % 5])]
    rows += [(61, 0, "user", "own"), (62, 0, "user", "own"), (62, 1, "user", "more"), (-7, 0, "user", "hello there")]
    rows += [(20, t, "user", f"turn {t}") for t in range(300)] + [(20, 5, "user", "w " * 50_000)]
    return spark.createDataFrame([(*r, 1, "b", "t", 2) for r in rows], SCHEMA)


def test_odd_rows(odd):
    raw = [tuple(r) for r in odd.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.conversation_trie(odd)) == brute(ordered(raw))
    turns = prefix_trie.ordered_turns(odd)
    assert rows_of(prefix_trie.prefix_trie(*prefix_trie.rebuilt_paths(turns))) == brute(rebuilt(ordered(raw)))


def test_empty_table(odd):
    assert prefix_trie.conversation_trie(odd.limit(0)).count() == 0


def test_blocks_cut_one_conversation(spark, monkeypatch):
    """A conversation that spans all partitions, with ties across their borders, gives what one partition gives."""
    rows = [(7, t // 3, "user", f"word {t % 5}") for t in range(400)] + [(8, t // 3, "user", f"word {t % 5}") for t in range(90)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.ordered_turns(table)
    assert turns.where("conv_id = 7").select("block").distinct().count() > 1
    assert [r.pos for r in turns.where("conv_id = 7").orderBy("pos").collect()] == list(range(1, 401))
    got = {(r.depth, r.conv_id): (r.n_convs, r.saved_tokens) for r in prefix_trie.conversation_trie(table).collect()}
    want = {(k[1], k[0]): (k[3], k[6]) for k in brute_deep(ordered(rows))}
    assert got == want


def brute_deep(paths):
    """As ``brute`` for two long paths, by their common prefix."""
    a, b = paths[7], paths[8]
    common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tokens = [len(t.split()) for _, t in a]
    shared = [(7, d, None, 2, None, None, sum(tokens[max(0, d - 1) : common])) for d in range(common + 1)]
    return shared + [(7, d, None, 1, None, None, 0) for d in range(common + 1, len(a) + 1)] + [(8, d, None, 1, None, None, 0) for d in range(common + 1, len(b) + 1)]


def test_crowded_parents_are_looked_up(spark):
    """A root with many children: the parents' owners come by broadcast and by join alike."""
    rows = [(c, 0, "user", f"first {c}") for c in range(300)] + [(c, 1, "user", "same") for c in range(300)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_children) for r in got.collect()}
    assert out[0, 0] == (None, 300)
    assert all(out[1, c] == (0, 1) and out[2, c] == (c, 0) for c in range(300))
