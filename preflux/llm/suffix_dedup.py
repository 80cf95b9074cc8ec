"""Exact removal of repeated 100-byte strings by prefix-free parsing.

Texts are parsed at triggers: in every 100-byte string the 24-byte gram with
the least rolling hash is one, so equal strings have the same trigger at the
same place. The starts that share a trigger form a phrase, whose bytes hold all
their strings. The parse is deduplicated first: of equal phrases only the first
in corpus order can hold anything new, so a copied text costs one hash a
phrase. Phrases that share a gram with a different phrase make up the
dictionary. Its suffixes are sorted bytewise to depth 100, bucket by bucket;
equal suffixes are put in corpus order by their phrases' places in the parse,
and all but the first are repeats. A gram with very many classes would make one
bucket as large as the corpus, so the strings of its phrases are dealt out by
their own hashes.

Chunks are ranges of doc_id, so comparing chunk, phrase and start is comparing
corpus positions. Only packed hashes, dictionary phrases and answer bits move;
the texts' own exchange is used again in each of the three passes over them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bucket_cuts, chunk_count, mix, pack, powers, prefix, rolling, text_bytes, unpack
from .common import read

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Positions that are parsed at once; bounds the memory of a chunk with a very long text.
SEGMENT = 1 << 18
#: Phrases of a bucket of the parse, and bytes of phrases of a bucket of the dictionary, on average.
BUCKET_PHRASES, BUCKET_BYTES = 1 << 18, 2 << 20
#: Phrase classes of one gram, over all chunks, from which its strings are compared by their own hashes instead:
#: where very many texts share a line, the phrases at its ends have one gram and would all meet in one bucket.
HOT_CLASSES = 512
#: Quantiles of doc_id that are asked for; each range between two is cut evenly by id, so the list stays this short.
RANGES = 4096
#: Bytes between triggers, on average.
STEP = (SPAN + 1) // 2


class Parse:
    """The phrases of a chunk: of each its first and last start, its trigger's gram hash and its class.

    Equal phrases (gram, bytes, place of the trigger) are one class.
    """

    def __init__(self, ids: list, texts: list, bits: int):
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, texts[i] or ""))
        self.order = order
        raw = [(texts[i] or "").encode() for i in order]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        self.begins = self.ends - np.fromiter(map(len, raw), np.int64, len(raw))
        parts = [self._segment(a) for a in range(0, max(1, len(self.data)), SEGMENT)]
        first, last, trigger, gram, phrase = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(first) > 1:
            # A phrase that a segment's end cut in two is one again.
            joined = (trigger[1:] == trigger[:-1]) & (first[1:] == last[:-1] + 1)
            if joined.any():
                head = np.flatnonzero(np.r_[True, ~joined])
                tail = np.r_[head[1:] - 1, len(first) - 1]
                last, first, trigger, gram, phrase = last[tail], first[head], trigger[head], gram[head], phrase[head]
                for k in np.flatnonzero(head != tail):
                    a, b = int(first[k]), int(last[k]) + LENGTH
                    phrase[k] = rolling(prefix(self.data[a:b].astype(np.uint64) + np.uint64(1)), np.array([0]), np.array([b - a]))[0]
        self.first, self.last, self.trigger = first, last, trigger
        # Triggers are least hashes, so these crowd at the low end until they are mixed again.
        self.gram = mix(gram.astype(np.uint64)) >> np.uint64(64 - bits)
        key = mix(phrase.astype(np.uint64) + (trigger - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + self.gram * np.uint64(0xE7037ED1A0B428DB))
        # np.unique gives the first place of a value: the class's first phrase in corpus order.
        self.class_key, self.class_first, self.class_of = np.unique(key, return_index=True, return_inverse=True)
        self.class_gram = self.gram[self.class_first]
        self.grams, self.gram_of_class, self.gram_classes = np.unique(self.class_gram, return_inverse=True, return_counts=True)

    def _segment(self, at: int):
        """Phrases with starts in [at, at + SEGMENT)."""
        part = self.data[at : at + SEGMENT + 2 * LENGTH].astype(np.uint64) + np.uint64(1)
        starts = min(SEGMENT, len(part) - LENGTH + 1)
        if starts <= 0:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        sums = prefix(part)
        n = starts + SPAN - 1
        grams = (sums[GRAM : GRAM + n] - sums[:n]) * powers(n)[0]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
        mask = np.uint64((1 << 22) - 1)
        least = (grams & ~mask) | np.arange(n, dtype=np.uint64)
        size = 1
        while size * 2 <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:starts], least[SPAN - size : SPAN - size + starts])
        trigger = (least & mask).astype(np.int64)
        doc = np.searchsorted(self.ends, np.arange(at, at + starts), "right")
        ok = np.flatnonzero(np.arange(at, at + starts) + LENGTH <= self.ends[doc])
        t = trigger[ok]
        head = np.ones(len(ok), bool)
        head[1:] = (t[1:] != t[:-1]) | (ok[1:] != ok[:-1] + 1)
        head = np.flatnonzero(head)
        tail = np.r_[head[1:] - 1, len(ok) - 1] if len(head) else head
        first, last, trigger = ok[head], ok[tail], t[head]
        return first + at, last + at, trigger + at, grams[trigger], rolling(sums, first, last + LENGTH)


def _parsed(table, bits: int) -> Parse:
    return Parse(table.column("id").to_pylist(), table.column("text").to_pylist(), bits)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _send_parse(buckets: int, bits: int):
    """Lists of classes, and lists of grams with the one class that each has in the chunk (0: several) and how many."""

    def run(key, table):
        parse = _parsed(table, bits)
        only = np.zeros(len(parse.grams), np.uint64)
        only[parse.gram_of_class] = parse.class_key
        only[parse.gram_classes > 1] = 0
        rows = []
        cuts = bucket_cuts(parse.class_key, buckets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            rows.append((b, pack(parse.class_key[cuts[b] : cuts[b + 1]]), None, None))
        cuts = bucket_cuts(parse.grams, buckets, bits)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            rows.append((buckets + b, pack(parse.grams[part]), only[part].tobytes(), parse.gram_classes[part].astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "hashes": pa.array(columns[1], pa.binary()), "only": pa.array(columns[2], pa.binary()), "classes": pa.array(columns[3], pa.binary()),
            }
        )

    return run


def _earlier(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For ascending lists in corpus order: which hashes an earlier list has."""
    every = np.concatenate(lists)
    rank = np.argsort(every, kind="stable")
    ranked = every[rank]
    again = np.zeros(len(every), bool)
    again[rank[1:]] = ranked[1:] == ranked[:-1]
    return np.split(again, np.cumsum([len(x) for x in lists])[:-1])


def _compare_parse(table):
    """Of classes a bit: an earlier chunk has it. Of grams two: they have several classes; they have very many."""
    table = table.sort_by("chunk")
    lists = [unpack(b) for b in table.column("hashes").to_pylist()]
    out = table.select(["chunk", "bucket"])
    if table.column("only").null_count:
        flags = _earlier(lists)
        return out.append_column("a", pa.array(map(_bits, flags), pa.binary())).append_column("b", pa.nulls(len(lists), pa.binary()))
    gram = np.concatenate(lists)
    only = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("only").to_pylist()])
    classes = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("classes").to_pylist()])
    distinct, group = np.unique(gram, return_inverse=True)
    least, most = np.full(len(distinct), np.iinfo(np.uint64).max), np.zeros(len(distinct), np.uint64)
    np.minimum.at(least, group, only)
    np.maximum.at(most, group, only)
    several = ((least != most) | (least == 0))[group]
    hot = (np.bincount(group, weights=classes) > HOT_CLASSES)[group]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return out.append_column("a", pa.array(map(_bits, np.split(several, cuts)), pa.binary())).append_column("b", pa.array(map(_bits, np.split(hot, cuts)), pa.binary()))


def _class_flags(parse: Parse, buckets: int, bits: int, answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class: an earlier chunk has it; else, whether it belongs to the dictionary, or to the starts of a hot gram."""
    earlier = np.zeros(len(parse.class_key), bool)
    several, hot = np.zeros((2, len(parse.grams)), bool)
    class_cuts, gram_cuts = bucket_cuts(parse.class_key, buckets), bucket_cuts(parse.grams, buckets, bits)
    for bucket, a, b in answers:
        if b is None:
            x, y = class_cuts[bucket], class_cuts[bucket + 1]
            earlier[x:y] = _flags(a, y - x)
        else:
            x, y = gram_cuts[bucket - buckets], gram_cuts[bucket - buckets + 1]
            several[x:y], hot[x:y] = _flags(a, y - x), _flags(b, y - x)
    new = ~earlier & several[parse.gram_of_class]
    hot = hot[parse.gram_of_class]
    return earlier, new & ~hot, new & hot


def _dictionary(parse: Parse, chosen: np.ndarray, buckets: int, bits: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, phrases in corpus order) of the chosen classes' first phrases, by gram."""
    classes = np.flatnonzero(chosen)
    classes = classes[np.argsort(parse.class_gram[classes], kind="stable")]
    cuts = bucket_cuts(parse.class_gram[classes], buckets, bits)
    return [(b, np.sort(parse.class_first[classes[cuts[b] : cuts[b + 1]]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def _starts(parse: Parse, phrases: np.ndarray) -> np.ndarray:
    n = parse.last[phrases] - parse.first[phrases] + 1
    return np.repeat(parse.first[phrases] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _hot_strings(parse: Parse, chosen: np.ndarray):
    """Starts of the chosen classes in corpus order; their distinct string hashes, first places and numbers."""
    starts = _starts(parse, np.sort(parse.class_first[chosen])) if chosen.any() else np.zeros(0, np.int64)
    hashes = np.zeros(len(starts), np.uint64)
    for a in range(0, len(parse.data), SEGMENT):
        x, y = np.searchsorted(starts, [a, a + SEGMENT])
        if x < y:
            sums = prefix(parse.data[a : a + SEGMENT + LENGTH].astype(np.uint64) + np.uint64(1))
            hashes[x:y] = rolling(sums, starts[x:y] - a, starts[x:y] - a + LENGTH)
    return starts, *np.unique(hashes, return_index=True, return_inverse=True)


_DICTIONARY = "route long, chunk long, bucket long, a binary, b binary, sizes binary, text binary"


def _send_dictionary(buckets: int, word_buckets: int, bits: int):
    def run(left, right):
        parse = _parsed(left, bits)
        chunk = left.column("chunk")[0].as_py()
        answers = list(zip(*(right.column(c).to_pylist() for c in ("bucket", "a", "b")), strict=True))
        _, chosen, hot = _class_flags(parse, buckets, bits, answers)
        # The answers travel on to the last pass, spread over all routes.
        rows = [((chunk * 31 + b) % word_buckets, chunk, b, x, y, None, None) for b, x, y in answers]
        for b, which in _dictionary(parse, chosen, word_buckets, bits):
            a, e = parse.first[which], parse.last[which] + LENGTH
            text = b"".join(parse.data[i:j].tobytes() for i, j in zip(a.tolist(), e.tolist(), strict=True))
            rows.append((b, chunk, b, None, None, (e - a).astype(np.int64).tobytes(), text))
        _, distinct, _, _ = _hot_strings(parse, hot)
        cuts = bucket_cuts(distinct, word_buckets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            rows.append((word_buckets + b, chunk, word_buckets + b, None, None, None, pack(distinct[cuts[b] : cuts[b + 1]])))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["route", "chunk", "bucket", "a", "b", "sizes", "text"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return run


def equal_suffixes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``starts`` begin like an earlier one, over LENGTH bytes.

    The suffixes are sorted by eight bytes at a time; only those that are still
    equal to another are sorted on.
    """
    repeat = np.zeros(len(starts), bool)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(text)]
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        key = words[starts[alive] + depth]
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        alive, group, key = alive[order], group[order], key[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        alone = new & np.r_[new[1:], True]
        group = np.cumsum(new)
        alive, group, new = alive[~alone], group[~alone], new[~alone]
    # Sorting was stable, so the first of a group is the first in corpus order.
    repeat[alive[~new]] = True
    return repeat


def _sort_dictionary(table):
    """Answers that pass through, and for each chunk's phrases a bit for each start: an earlier one begins the same string."""
    table = table.sort_by("chunk")
    rows = table.to_pylist()
    out = [(r["chunk"], r["bucket"], r["a"], r["b"], None) for r in rows if r["text"] is None]
    words = [r for r in rows if r["sizes"] is not None]
    hot = [r for r in rows if r["sizes"] is None and r["text"] is not None]
    if hot:
        for r, flags in zip(hot, _earlier([unpack(r["text"]) for r in hot]), strict=True):
            out.append((r["chunk"], r["bucket"], None, None, _bits(flags)))
    if words:
        text = np.frombuffer(b"".join(r["text"] for r in words), np.uint8)
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in words]
        every = np.concatenate(sizes)
        ends = np.cumsum(every)
        mask = np.ones(len(text), bool)
        tails = (ends[:, None] - np.arange(1, LENGTH)[None, :]).ravel()
        mask[tails] = False
        starts = np.flatnonzero(mask)
        repeat = equal_suffixes(text, starts)
        counts = [int((s - LENGTH + 1).sum()) for s in sizes]
        for r, flags in zip(words, np.split(repeat, np.cumsum(counts)[:-1]), strict=True):
            out.append((r["chunk"], r["bucket"], None, None, _bits(flags)))
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(["chunk", "bucket", "a", "b", "repeats"], columns, types, strict=True)})


def _remove(buckets: int, word_buckets: int, bits: int, id_type: pa.DataType):
    def run(left, right):
        parse = _parsed(left, bits)
        rows = right.to_pylist()
        earlier, chosen, hot = _class_flags(parse, buckets, bits, [(r["bucket"], r["a"], r["b"]) for r in rows if r["repeats"] is None])
        gone = earlier[parse.class_of] | (parse.class_first[parse.class_of] != np.arange(len(parse.class_of)))
        edge = np.zeros(len(parse.data) + 1, np.int64)
        np.add.at(edge, parse.first[gone], 1)
        np.add.at(edge, parse.last[gone] + LENGTH, -1)
        found = {r["bucket"]: r["repeats"] for r in rows if r["repeats"] is not None}
        for b, which in _dictionary(parse, chosen, word_buckets, bits):
            starts = _starts(parse, which)
            hit = starts[_flags(found[b], len(starts))]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + LENGTH, -1)
        starts, distinct, place, number = _hot_strings(parse, hot)
        if len(starts):
            before = np.zeros(len(distinct), bool)
            cuts = bucket_cuts(distinct, word_buckets)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                before[cuts[b] : cuts[b + 1]] = _flags(found[word_buckets + b], cuts[b + 1] - cuts[b])
            hit = starts[before[number] | (place[number] != np.arange(len(starts)))]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + LENGTH, -1)
        removed = np.cumsum(edge)[:-1] > 0
        out: dict[str, list] = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        ids = left.column("id").to_pylist()
        for i, a, b in zip(parse.order, parse.begins.tolist(), parse.ends.tolist(), strict=True):
            mask = removed[a:b]
            at = np.flatnonzero(np.diff(np.r_[False, mask, False])).reshape(-1, 2).tolist()
            out["id"].append(ids[i])
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(mask.sum()))
            out["spans"].append([{"start": x, "end": y} for x, y in at])
            out["kept"].append(parse.data[a:b][~mask].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(out["id"], id_type), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.binary())})

    return run


def id_chunks(ids: pd.Series, edges: np.ndarray, parts: int) -> np.ndarray:
    """Chunks that never fall as ids rise: the range between two edges, then one of its even parts; null ids have the last chunk."""
    x = ids.fillna(0).astype(np.int64).to_numpy()
    place = np.searchsorted(edges[1:-1], x, "right")
    low, high = edges[place], edges[place + 1]
    # Differences are taken unsigned, so ids of either sign fit; ids beyond the outer edges stay in the outer parts.
    step, width = ((y.astype(np.uint64) - low.astype(np.uint64)).astype(np.float64) for y in (np.maximum(x, low), high))
    part = np.minimum(step / np.maximum(width, 1.0) * parts, parts - 1).astype(np.int64)
    return np.where(ids.isna(), (len(edges) - 1) * parts, place * parts + part)


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept) per row: bytes without strings of 100 that start earlier too.

    Ids are integers; rows with a null id come last, rows that share an id are
    ordered by text. A null text is empty, one under 100 bytes is kept whole.
    A cut can fall inside a character, so ``kept`` is binary; spans are byte
    intervals, end exclusive. No rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    size = text_bytes(docs, text_col)
    chunks, phrases = chunk_count(size), max(1, size // STEP)
    buckets, word_buckets = max(1, phrases // BUCKET_PHRASES), max(1, size // 2 // BUCKET_BYTES)
    bits = min(64, phrases.bit_length() + 14)
    ranges = min(chunks, RANGES)
    parts = -(-chunks // ranges)
    edges = np.zeros(2, np.int64)
    if chunks > 1:
        at = [k / ranges for k in range(ranges + 1)]
        edges = np.array(docs.agg(F.percentile_approx(id_col, at, max(10_000, 20 * ranges))).first()[0] or [0, 0], np.int64)

    @F.pandas_udf("long")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(id_chunks(ids, edges, parts))

    id_type = docs.schema[id_col].dataType
    rows = docs.select(chunk_of(F.col(id_col)).alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parses = rows.groupBy("chunk").applyInArrow(_send_parse(buckets, bits), "bucket long, chunk long, hashes binary, only binary, classes binary")
    answers = parses.groupBy("bucket").applyInArrow(_compare_parse, "chunk long, bucket long, a binary, b binary")
    dictionary = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_dictionary(buckets, word_buckets, bits), _DICTIONARY)
    repeats = dictionary.groupBy("route").applyInArrow(_sort_dictionary, "chunk long, bucket long, a binary, b binary, repeats binary")
    out = rows.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(
        _remove(buckets, word_buckets, bits, to_arrow_type(id_type)),
        f"id {id_type.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary",
    )
    return out.withColumnRenamed("id", id_col)


def op9_parsed_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 100-byte strings."""
    out = remove_repeated_strings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
