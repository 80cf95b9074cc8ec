"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns' spans always stay. The field adds spans that the patterns miss
(other separators, failed check digits). It is trained on the driver from the
small labelled table below. Its chains are the stretches of a text within
REACH words of a word with a digit, ``@``, ``(at)`` or ``[at]``: each labelled
span has such a word, and words outside are no personal data by the model's
definition. Batches of chains are decoded by Viterbi in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 2
EPOCHS, RATE, L2 = 120, 0.2, 1e-3
BATCH_CHARS = 4_000_000
#: Features of words up to this length are kept for the next time; longer ones are worked out each time.
KEPT_CHARS = 64

#: The labelled table: [kind|text] marks a span. All values are invented or reserved for examples; none is taken from a corpus.
LABELLED = """
write to [email|ana.b@mail.example] today
contact [email|j_smith@corp7.example.com], please
his address is [email|x99@site.example.org].
mail me: [email|info@shop.example]
my mail [email|tom(at)mail3.example.com] works
reach [email|kim[at]post.example.net] or call
send it to [email|lee@localhost] soon
the host [ip|10.0.0.7] answered
from [ip|192.168.44.120] at noon
ping [ip|8.8.4.4], then wait
server [ip|172.16.254.3]:8080 is down
block [ip|300.12.8.1] and log
traffic of [ip|203.0.113.77] grew
net [ip|121.9.200.33]/24 is ours
card [card|4417123456789113] was charged
paid with [card|4929001182736452] in all
number [card|5500 0000 0000 0004] expires
use [card|6011-1111-1111-1117] here
visa [card|4532 7597 3454 5858], please
se cobró con [card|9711048833016625] en enero.
avec [card|7120559940381264] et puis
number [card|1234-5678-9012-3456] was refused
of [card|7903311875520468] the same
amex [card|378282246310005] is old
call [phone|+1 (217) 555-0101] now
or [phone|+1 (646) 555-0177] the same day
tel [phone|+49 30 1234567] or write
phone: [phone|555-0199-221], evenings
ring [phone|(212) 555-0188] after six
fax [phone|+33 1 42 68 53 00] only
his number is [phone|0171-5550123].
mobile [phone|+44 7700 900123] please
call [phone|1-800-555-0147] free
dial [phone|+1-202-555-0173] and wait
token = "9f1c07d25ab3e8846d0f2b91c7a35e6804d1bb72" in the file
key = "c3d80a17fe529b64e0271fd38ba45c96e41f" is secret
on 2024-05-17 we met
at 12:30 and 14:45 daily
version 2.0 of the License
License, Version 2.0. Apache
release 3.11.4 came out
cost 19.99 or 1,299.00 each
chapter 7 page 312 of 800
in 1999 and 2003 there
room 12b on floor 3
scored 3-2 in the game
only 45% of 1000 rows
about 15 people and 27 dogs
take 500mg twice
the id 8831 is free
lines 10-20 and 33-41
@home we say @all hello
follow @nobody for news
sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709 matches
part 12345678 in stock
order 20240517 was sent
x1 + y2 = z3 holds
model A320 and B737 fly
range 0.5-0.75 is fine
sum 100000 of 250000 points
from 1987 to 2011 only
and 1812 or 1945 too
the 6789 units and 4242 more
year 2020, then 2021.
4000 men and 1234 women
page 1066 of 5678 pages
born 1931 died 2005
the 2222 rows
call [phone|020 7946 0958] today
phone [phone|0161 496 0000] or wait
ask [email|mia(at)studio.example] first
schreib an [email|lena(at)verein.example.org] bitte
escribe a [email|luis[at]correo.example.com] hoy
mail [email|bob.k[at]firm.example.net], thanks
we meet (at) noon
look [at] this page
Karte [card|4716 9900 1122 3345] gesperrt
tarjeta [card|3714-4963-5398-4310] perdida
blocked [ip|198.51.100.23]:443 again
adresse [ip|192.0.2.45]/28 notée
Telefon [phone|0711/5550142] abends
tél [phone|01 55 50 14 20], merci
mobile [phone|07700 900 482] please
number [phone|(303) 555-0136] is mine
ISBN 978-3-16-148410-0 is listed
build 10.0.19045.3803 is old
am 24.12.2021 um 18.30 Uhr
GPS 48.8584, 2.2945 is near
from 2022-06-30 to 2021-01-15 only
at 08:45 on 2019-02-28
since version 3.1.4 of 2018
section 4c of room 220
bus 17 to stop 350
login as [email|admin@gateway] first
Telefon [phone|040-5550133], danke
mobile [phone|0151 5550 9876] please
"""

_DIGIT = re.compile("[0-9]")
#: What opens a chain.
_GATE = re.compile(r"[0-9@]|\([Aa][Tt]\)|\[[Aa][Tt]\]")
_TOKEN = re.compile(r"\S+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each ``@`` so that long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; matches that fail a check are dropped."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def word_shape(token: str) -> str:
    """Runs of letters and digits with their length up to 5; other characters as they are."""
    out: list[str] = []
    run, n = "", 0
    for c in token:
        k = "9" if c.isdigit() and c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == run and k in "9Aa":
            n += 1
            continue
        if n:
            out.append(run + (str(min(n, 5)) if run in "9Aa" else ""))
        run, n = k, 1
    out.append(run + (str(min(n, 5)) if run in "9Aa" else ""))
    return "".join(out)


def _own_features(token: str) -> tuple[str, ...]:
    return _kept_features(token) if len(token) <= KEPT_CHARS else _features(token)


@lru_cache(maxsize=20_000)
def _kept_features(token: str) -> tuple[str, ...]:
    return _features(token)


def _features(token: str) -> tuple[str, ...]:
    core = token.strip(".,;:!?\"'")
    digits = sum(c.isdigit() for c in core)
    low = core.lower()
    return (
        f"shape={word_shape(core)}",
        f"digits={digits if digits < 4 else '4-7' if digits < 8 else '8-13' if digits < 14 else '14-19' if digits < 20 else '20+'}",
        f"at={'@' in core}", f"atword={'(at)' in low or '[at]' in low}", f"dots={min(core.count('.'), 4)}", f"dashes={min(core.count('-'), 4)}",
        f"hex={len(core) > 15 and all(c in '0123456789abcdefABCDEF' for c in core)}", f"alpha={any(c.isalpha() for c in core)}",
        f"start={core[:1] if core[:1] in '+(@' else ''}", f"alldigits={core.isdigit()}", f"numlen={min(len(core), 20) if core.isdigit() else 0}",
        f"word={low if low in _CUES else ''}",
    )


_CUES = frozenset("call tel phone fax mobile ring dial card visa amex mail email ip host server ping token key sha1 version license".split())


def _run_digits(tokens: list[str]) -> list[str]:
    """For each word without letters how many digits its run has; a plus sign opens a run, dotted words and long numbers are runs of their own."""
    runs: list[list[int]] = []
    own: list[int | None] = []
    closed = True
    for t in tokens:
        if any(c.isalpha() for c in t):
            own.append(None)
            closed = True
            continue
        digits = sum(c.isdigit() for c in t)
        alone = digits > 12 or t.rstrip(".").count(".") > 1
        if closed or alone or t[:1] == "+":
            runs.append([0])
        runs[-1][0] += digits
        own.append(len(runs) - 1)
        closed = alone
    return ["run=" if r is None else f"run={next((n for n in (0, 3, 6, 9, 13, 19) if runs[r][0] <= n), 20)}" for r in own]


def chain_features(tokens: list[str]) -> list[list[str]]:
    own = [_own_features(t) for t in tokens]
    runs = _run_digits(tokens)
    out = []
    for i, f in enumerate(own):
        row = [*f, runs[i]]
        for d in (-1, 1):
            near = own[i + d] if 0 <= i + d < len(own) else None
            row += [f"{d}:{near[0] if near and near[1] != 'digits=0' else 'edge' if near is None else 'text'}", f"{d}:{near[1] if near else ''}", f"{d}:{near[-1] if near else ''}"]
        out.append(row)
    return out


def _labelled() -> list[tuple[list[str], list[int]]]:
    table = []
    for line in LABELLED.strip().split("\n"):
        tokens, tags, at = [], [], 0
        for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[at\])+)\](\S*)", line):
            before = line[at : m.start()].split()
            tokens += before
            tags += [0] * len(before)
            parts = (m[2] + m[3]).split()
            k = KINDS.index(m[1])
            tokens += parts
            tags += [1 + 2 * k] + [2 + 2 * k] * (len(parts) - 1)
            at = m.end()
        rest = line[at:].split()
        table.append((tokens + rest, tags + [0] * len(rest)))
    return table


class Field:
    """Weights of the field: emissions by feature, transitions between labels."""

    def __init__(self) -> None:
        table = _labelled()
        rows = [chain_features(t) for t, _ in table]
        self.index = {f: i for i, f in enumerate(sorted({f for r in rows for x in r for f in x}))}
        n = len(LABELS)
        self.emit = np.zeros((len(self.index) + 1, n))
        self.step = np.zeros((n, n))
        self.first = np.zeros(n)
        data = [([np.array([self.index[f] for f in x]) for x in r], np.array(t)) for r, (_, t) in zip(rows, table, strict=True)]
        squares = [np.full_like(w, 1e-6) for w in (self.emit, self.step, self.first)]
        for _ in range(EPOCHS):
            grads = [L2 * self.emit * len(data), L2 * self.step * len(data), L2 * self.first * len(data)]
            for feats, tags in data:
                self._gradient(feats, tags, grads)
            for w, g, s in zip((self.emit, self.step, self.first), grads, squares, strict=True):
                s += g * g
                w -= RATE * g / np.sqrt(s)
        # A span's inner label follows only its own kind.
        for k in range(len(KINDS)):
            inner = 2 + 2 * k
            self.first[inner] = -1e6
            for j in range(n):
                if j not in (inner, inner - 1):
                    self.step[j, inner] = -1e6

    def _gradient(self, feats: list[np.ndarray], tags: np.ndarray, grads: list[np.ndarray]) -> None:
        scores = np.stack([self.emit[f].sum(axis=0) for f in feats])
        n, k = scores.shape
        alpha, beta = np.empty((n, k)), np.zeros((n, k))
        alpha[0] = self.first + scores[0]
        for i in range(1, n):
            alpha[i] = scores[i] + np.logaddexp.reduce(alpha[i - 1][:, None] + self.step, axis=0)
        for i in range(n - 2, -1, -1):
            beta[i] = np.logaddexp.reduce(self.step + (scores[i + 1] + beta[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(alpha[-1])
        p = np.exp(alpha + beta - z)
        for i, f in enumerate(feats):
            np.add.at(grads[0], f, p[i])
            grads[0][f, tags[i]] -= 1
        for i in range(1, n):
            grads[1] += np.exp(alpha[i - 1][:, None] + self.step + (scores[i] + beta[i])[None, :] - z)
            grads[1][tags[i - 1], tags[i]] -= 1
        grads[2] += p[0]
        grads[2][tags[0]] -= 1

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The best label sequence of each chain, chains of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and end - at < 2048 and (end == at or len(chains[order[end]]) <= len(chains[order[at]]) + 4):
                end += 1
            group = order[at:end]
            self._viterbi(chains, group, out)
            at = end
        return out

    def _viterbi(self, chains: list[list[str]], group: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(chains[i]) for i in group])
        steps, k = int(lengths.max()), len(LABELS)
        scores = np.zeros((len(group), steps, k))
        for row, i in enumerate(group):
            for j, x in enumerate(chain_features(chains[i])):
                scores[row, j] = self.emit[[self.index[f] for f in x if f in self.index]].sum(axis=0)
        back = np.zeros((steps, len(group), k), np.int8)
        best = self.first + scores[:, 0]
        for j in range(1, steps):
            every = best[:, :, None] + self.step[None]
            back[j] = every.argmax(axis=1)
            best = np.where((j < lengths)[:, None], every.max(axis=1) + scores[:, j], best)
        label = best.argmax(axis=1)
        tags = np.zeros((len(group), steps), np.int64)
        for j in range(steps - 1, -1, -1):
            here = j < lengths
            tags[:, j] = np.where(here, label, 0)
            if j:
                label = np.where(here, back[j][np.arange(len(group)), label], label)
        for row, i in enumerate(group):
            out[i] = tags[row, : lengths[row]]


@lru_cache(maxsize=1)
def trained_field() -> Field:
    return Field()


def _chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token intervals of the stretches within REACH tokens of a token that the gate fits."""
    if not _GATE.search(text):
        return
    chain: list[tuple[int, int]] = []
    last: list[tuple[int, int]] = []  # up to REACH tokens before
    left = 0
    for m in _TOKEN.finditer(text):
        span = m.span()
        token = m[0]
        if _GATE.search(token):
            if not left:
                if chain:
                    yield chain
                chain = last[-REACH:]
            chain.append(span)
            left = REACH
            last = []
        elif left:
            chain.append(span)
            left -= 1
            if not left:
                # Kept open: another such word may follow right after.
                last = []
        else:
            last.append(span)
            if len(last) > REACH:
                last.pop(0)
    if chain:
        yield chain


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the field finds in each text; ends are trimmed of punctuation."""
    where: list[tuple[int, list[tuple[int, int]]]] = [(i, c) for i, t in enumerate(texts) for c in _chains(t)]
    labels = field.decode([[texts[i][a:b] for a, b in c] for i, c in where])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, chain), tags in zip(where, labels, strict=True):
        at = 0
        while at < len(chain):
            if tags[at] == 0:
                at += 1
                continue
            kind, end = (int(tags[at]) - 1) // 2, at + 1
            while end < len(chain) and tags[end] == 2 + 2 * kind:
                end += 1
            a, b = chain[at][0], chain[end - 1][1]
            core = texts[i][a:b]
            b -= len(core) - len(core.rstrip(".,;:!?\"'|#*$%&<>"))
            a += len(core) - len(core.lstrip("\"'|#*$%&<>"))
            if a < b:
                out[i].append((a, kind, b))
            at = end
    return out


def find_spans(field: Field, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text: base spans, and all spans (base ones, and the field's that touch none of them)."""
    out = []
    for text, more in zip(texts, field_spans(field, texts), strict=True):
        base = base_spans(text)
        added = [s for s in more if not any(s[0] < b and a < s[2] for a, _, b in base)] if base else more
        out.append((base, sorted(base + added)))
    return out


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans (arrays of kind, start, end in code points) and masked_text.

    A null text counts as empty (its masked_text is null); the field is trained
    on the driver and broadcast (its size depends on the labelled table alone).
    Columns of these names in ``docs`` are replaced.
    """
    from pyspark.sql.types import StructField, StructType

    docs = docs.drop("base_spans", "spans", "masked_text")
    field = docs.sparkSession.sparkContext.broadcast(trained_field())
    added = StructType.fromDDL("base_spans array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>, masked_text string")
    schema = StructType([*docs.schema.fields, *(StructField(f.name, f.dataType) for f in added)])
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            column, i = batch.column(at), 0
            while i < len(column):
                j, size, part = i, 0, []
                while j < len(column) and size < BATCH_CHARS:
                    part.append(column[j].as_py())
                    size += len(part[-1] or "")
                    j += 1
                found = find_spans(model, [t or "" for t in part])
                extra = [
                    pa.array([rows(b) for b, _ in found], span),
                    pa.array([rows(s) for _, s in found], span),
                    pa.array([None if t is None else masked(t, s) for t, (_, s) in zip(part, found, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *extra], schema.names)
                i = j

    return docs.mapInArrow(run, schema)


def _joined(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_shape_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    out = with_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("masked_text", "text")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
