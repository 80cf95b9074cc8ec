"""Quality rules as a learned decision list.

Every text gets statistics of its words, lines and characters. From a bounded
sample of labelled texts, sequential covering grows one conjunction of
thresholds at a time (best information gain per step), prunes it on rows that
did not grow it, keeps it if it is precise there, and removes what it covers.
The rules come out as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import read

WINDOW = 5
SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\v\f\r"
#: Labelled rows that the list is learned from at most: the first of them by a hash of their id.
LABELLED_ROWS = 6000
#: Rules at most, conditions of a rule at most, and precision that a rule needs on the pruning rows.
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 12, 4, 0.97, 8
CLEAN_WEIGHT = 20
BATCH_CHARS = 4_000_000
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "distinct_share", "pipe_share", "longest_share")
STATS_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, mean_word double, symbol_share double, dup_line_share double, repeat_share double, upper_share double, bang_share double, digit_share double, distinct_share double, pipe_share double, longest_share double"

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[33] = 4


def repeated_words(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: words that lie in a window of five whose words occur there twice or more."""
    out = np.zeros(len(lengths), np.int64)
    if len(ids) < WINDOW:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(doc[: -WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(starts):
        return out
    key = doc[starts].astype(np.uint64) + np.uint64(1)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[starts + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(order), bool)
    twice[order] = same[1:] | same[:-1]
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[starts[twice] + k] = True
    return np.bincount(doc[covered], minlength=len(lengths))


def text_statistics(texts: list[str]) -> dict[str, np.ndarray]:
    vocabulary: dict[bytes, int] = {}
    number = vocabulary.setdefault
    ids, rows, raw = [], [], []
    for text in texts:
        b = text.encode()
        ws = b.split()
        ids.append(np.fromiter([number(w, len(vocabulary)) for w in ws], np.int64, len(ws)))
        lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
        raw.append(b)
        rows.append((len(ws), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), len(set(ws)), text.count("|"), max(map(len, ws), default=0)))
    n, chars, symbols, dup, lines, distinct, pipes, longest = np.array(rows, np.int64).reshape(-1, 8).T
    repeat = repeated_words(np.concatenate(ids) if ids else np.zeros(0, np.int64), n)
    ends = np.cumsum([len(b) for b in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    kinds = _KIND[np.frombuffer(b"".join(raw), np.uint8)]

    def per_text(kind: int) -> np.ndarray:
        total = np.r_[0, np.cumsum(kinds == kind)]
        return np.diff(total[np.r_[0, ends]])

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    upper, lower, digits, bangs = (per_text(k) for k in (1, 2, 3, 4))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "mean_word": share(chars, n), "symbol_share": share(symbols, chars), "dup_line_share": share(dup, lines), "repeat_share": share(repeat, n),
        "upper_share": share(upper, upper + lower), "bang_share": share(bangs, n), "digit_share": share(digits, chars), "distinct_share": share(distinct, n),
        "pipe_share": share(pipes, n), "longest_share": share(longest, chars),
    }


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``quality_stats`` (struct of STATS_SCHEMA); a null text counts as empty."""
    docs = docs.drop("quality_stats")
    schema = StructType([*docs.schema.fields, StructField("quality_stats", StructType.fromDDL(STATS_SCHEMA))])
    at = docs.columns.index(text_col)
    kind = pa.struct([(part.split()[0], pa.int64() if part.split()[1] == "long" else pa.float64()) for part in STATS_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, i = batch.column(at), 0
            while i < len(column):
                j, size, part = i, 0, []
                while j < len(column) and size < BATCH_CHARS:
                    part.append(column[j].as_py() or "")
                    size += len(part[-1])
                    j += 1
                stats = text_statistics(part)
                struct = pa.StructArray.from_arrays([pa.array(stats[f.name], f.type) for f in kind], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, struct], [*batch.schema.names, "quality_stats"])
                i = j

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(f"quality_stats.{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, on: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the best FOIL gain towards ``y`` among the rows ``on``; a clean row weighs CLEAN_WEIGHT."""
    p0, n0 = int(y[on].sum()), CLEAN_WEIGHT * int((~y[on]).sum())
    if not p0 or not n0:
        return 0.0, None
    base, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for feature in FEATURES:
        v = x[feature][on]
        order = np.argsort(v, kind="stable")
        v, pos = v[order], y[on][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p = np.cumsum(pos)[cut]
        below = below_p + CLEAN_WEIGHT * (cut + 1 - below_p)
        for above in (False, True):
            p, t = (p0 - below_p, p0 + n0 - below) if above else (below_p, below)
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / t) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(feature, above, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    return best, found


def _precision(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray, on: np.ndarray) -> tuple[float, int]:
    held = rule.holds(x) & on
    p, t = int(y[held].sum()), int(held.sum())
    return (p + 1) / (t + 2), p


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """Ordered rules for ``bad``; rows of ``grow`` grow rules, the others prune and judge them."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (bad & left & grow).any():
        conditions: list[Condition] = []
        on = left & grow
        while len(conditions) < MAX_CONDITIONS and (~bad[on]).any():
            _, c = _best_condition(x, bad, on)
            if c is None:
                break
            conditions.append(c)
            on &= c.holds(x)
        if not conditions:
            break
        options = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        rule = max(options, key=lambda r: (_precision(r, x, bad, left & ~grow)[0], -len(r.conditions)))
        held = rule.holds(x) & left
        precision = (bad[held].sum() + 1) / (held.sum() + 2)
        judged, _ = _precision(rule, x, bad, left & ~grow)
        # The pruning rows may be few, so a rule is also held against all rows that it covers.
        if held.sum() < MIN_COVER or precision < MIN_PRECISION or judged < min(MIN_PRECISION, 1 - 2 / ((held & ~grow).sum() + 2)):
            left &= ~(held & bad & grow)  # what this try covered no longer grows rules
            if not (held & bad & grow).any():
                break
            continue
        rules.append(rule)
        left &= ~held
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules learned from at most LABELLED_ROWS labelled documents; none without labels of both kinds.

    A document labelled more than once counts by its lowest label; of rows that share a labelled id
    one counts, that whose text has the least hash; null ids and labels are ignored.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(LABELLED_ROWS)
    # The sample's size is fixed, so it is broadcast.
    shared = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text")).join(F.broadcast(sample), "__id")
    rows = shared.groupBy("__id", "__label").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("one")).select("__id", "__label", "one.__text")
    table = with_statistics(rows, "__text").select("__id", "__label", "quality_stats.*").orderBy("__id").toPandas()
    x = {f: table[f].to_numpy(float) for f in FEATURES}
    bad = (table["__label"] == 0).to_numpy(bool)
    grow = np.arange(len(table)) % 3 != 0
    return learn_rules(x, bad, grow)


def verdict(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that rejects a row, else null."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    s = F.col("quality_stats")
    return (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with quality_stats, base_failed, rule (number of the rejecting rule or null) and kept.

    Columns of these names in ``docs`` are replaced. A null text counts as
    empty and fails the base rule; no rows give no rows.
    """
    return (
        with_statistics(docs.drop("base_failed", "rule", "kept"), text_col)
        .withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``apply_rules`` with rules learned from the labelled documents; without labels only the base rule rejects."""
    return apply_rules(docs, fit_rules(docs, labels, id_col, text_col), text_col)


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    s = "quality_stats."
    return out.select("doc_id", s + "n_words", s + "word_chars", s + "n_symbols", s + "n_dup_lines", s + "n_repeat_words", "base_failed", "kept", "rule")
