"""What the field finds in whole texts: nothing that it would label lies outside its chains."""

import re

from preflux.llm import pii


def labelled_texts():
    """(text, spans) of each line of the labelled table; spans without the punctuation around them."""
    for line in pii.LABELLED.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[at\])+)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), pii.KINDS.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        yield text + line[at:], spans


def test_labelled_lines():
    table = dict((t, s) for t, s in labelled_texts())
    found = {t: s for t, (_, s) in zip(table, pii.find_spans(pii.trained_field(), list(table)), strict=True)}
    wrong = [t for t in table if found[t] != table[t]]
    assert len(wrong) <= 0.05 * len(table), [(t, found[t], table[t]) for t in wrong]
    kim = "reach kim[at]post.example.net or call"
    assert found[kim] == table[kim] == [(6, 0, 29)]


def test_addresses_without_digits():
    texts = {
        "please write to sue(at)mail.example.net today": [(16, 0, 39)], "ask lee[at]shop.example.org, or not": [(4, 0, 27)],
        "one two three four five six write to BOB(AT)Post.Example.com soon": [(37, 0, 60)],
    }
    assert {t: s for t, (_, s) in zip(texts, pii.find_spans(pii.trained_field(), list(texts)), strict=True)} == texts


def test_chains_hold_every_label(docs):
    """Decoding all words of the documents labels none outside the chains."""
    texts = [r.text or "" for r in docs.collect()] + [t for t, _ in labelled_texts()]
    spans = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    rows = [(t, s) for t, s in zip(texts, spans, strict=True) if s]
    for (t, s), tags in zip(rows, pii.trained_field().decode([[t[a:b] for a, b in s] for t, s in rows]), strict=True):
        inside = {x for c in pii._chains(t) for x in c}
        assert not [t[a:b] for (a, b), tag in zip(s, tags, strict=True) if tag and (a, b) not in inside]
