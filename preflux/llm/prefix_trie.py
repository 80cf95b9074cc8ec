"""Trie of shared conversation prefixes, each node owned by its smallest member.

A conversation is a path of turns from a textless root. The members of a node
are a subset of its parent's, so along a path the smallest member only grows:
what a conversation owns is a suffix of its path, told by one depth. So no row
of a node ever needs the node's other rows: a pre-aggregated minimum gives the
owners, one row per conversation says from which depth it owns, and windows
along its path turn that into what each of its turns adds to the node there:
tokens still to come, minus those of the owned suffix, and the flag of an owned
leaf. One group-by of the prefix sums these up to whole subtrees.

A prefix is named by two 64-bit hashes, each the exclusive or of the hashes of
(turn, depth) along the path. That can be summed up piecewise, so a conversation
of any length is cut into the blocks of a range partitioning, whose totals give
the offsets; the root and other crowded nodes meet only in partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, lookup, materialize, read, words

#: Conversation ids that one list of ends may span.
SEGMENT_BITS = 12
#: The given query: which conversation lends its first turns, and how many at most.
SHARED, HEAD = 20, 3

NODE = ["depth", "ka", "kb"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, pos, turn, tokens): turns numbered from 1 by (turn, null first; role; digest of both texts).

    Rows without a conv_id take no part, a null role or text is empty, repeated
    rows are repeated turns. ``turn`` is now the digest of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), digest.alias("turn"), F.size(words(F.col("text"))).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("tie")
    )
    order = [F.col("at").asc_nulls_first(), F.col("role"), F.col("turn")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, "conv_id", *order, "tie").select("conv_id", "at", "role", "turn", "tokens", F.spark_partition_id().alias("block")), "turns")
    inside = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)).cast("long"))
    counts = dealt.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    out = materialize(_offset(inside, counts, n="sum").select("conv_id", "block", (F.col("pos") + F.col("n_before")).alias("pos"), "turn", "tokens"), "ordered")
    discard(dealt)
    return out


def _offset(rows: DataFrame, totals: DataFrame, **kinds: str) -> DataFrame:
    """``rows`` with x_before for each total x: the sum (or xor) of x over the conversation's earlier blocks, of which there are no more than partitions."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "xor": F.bit_xor}
    offsets = totals.select("conv_id", "block", *[F.coalesce(fold[kind](x).over(earlier), F.lit(0)).alias(f"{x}_before") for x, kind in kinds.items()])
    return rows.join(offsets, ["conv_id", "block"])


def whole_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as they are: (conv_id, block, depth, turn, tokens), and (conv_id, length)."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first turns replaced by those of its base: paths and lengths as ``whole_paths``."""
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % (HEAD + 1)).alias("head")
    convs = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    whole = convs.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", head, (c - c % SHARED).alias("base"))
    lenders = whole.where(c % SHARED == 0).select(c.alias("base"), F.col("n").alias("lent"))
    whole = materialize(whole.join(lenders, "base", "left").select("conv_id", "base", "head", "n", F.least("head", F.coalesce("lent", F.lit(0))).alias("taken")), "rebuilt")
    heads = turns.where((c % SHARED == 0) & (F.col("pos") <= HEAD)).select(c.alias("base"), "pos", "turn", "tokens")
    taken = whole.join(heads, "base").where("pos <= head").select("conv_id", F.lit(-1).alias("block"), F.col("pos").alias("depth"), "turn", "tokens")
    moved = convs.select("conv_id", "block").join(whole, "conv_id").select("conv_id", "block", "head", "taken")
    own = turns.join(moved, ["conv_id", "block"]).where("pos > head").select("conv_id", "block", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "turn", "tokens")
    return taken.unionByName(own), whole.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))


def _occurrences(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and depth, the root's included: the node's key, its parent's, and the tokens before it on the path."""
    hashed = paths.withColumns({"a": F.xxhash64(F.lit(1), "turn", "depth"), "b": F.xxhash64(F.lit(2), "turn", "depth")})
    along = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.withColumns({"xa": F.bit_xor("a").over(along), "xb": F.bit_xor("b").over(along), "xt": F.sum("tokens").over(along)})
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"), F.sum("tokens").alias("tt"))
    ka, kb = F.col("xa").bitwiseXOR(F.col("ta_before")), F.col("xb").bitwiseXOR(F.col("tb_before"))
    keyed = _offset(inside, totals, ta="xor", tb="xor", tt="sum").select(
        "conv_id", "block", "depth", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("a")).alias("pa"), kb.bitwiseXOR(F.col("b")).alias("pb"), (F.col("tt_before") + F.col("xt") - F.col("tokens")).alias("before")
    )
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", F.lit(-2).alias("block"), zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"), zero.alias("pb"), zero.alias("before"))
    lens = totals.select("conv_id", "block").unionByName(roots.select("conv_id", "block")).join(lengths, "conv_id")
    return keyed.unionByName(roots).join(lens, ["conv_id", "block"])


def _ends(occurrences: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: ids are joined in segments of bounded width, which one pass digests in order."""
    text = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")))
    segments = occurrences.where("depth = length").groupBy(*NODE, F.shiftright("conv_id", SEGMENT_BITS).alias("segment")).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if node != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _rows(out)
        if key is not None:
            yield _rows([(*key, digest.hexdigest())])

    return segments.repartition(*NODE).sortWithinPartitions(*NODE, "segment").mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*NODE, "ends_sha256"])


def _with_parents(nodes: DataFrame) -> DataFrame:
    """The owner of each node's parent. Parents with more than a thousandth of all nodes as children, a thousand at most, are broadcast; the others' children meet them in a join."""
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    return lookup(nodes, parents, ["depth", "pa", "pb"], F.col("siblings") > max(64, nodes.count() // 1000))


def prefix_trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: smallest member, depth, smallest member of the parent (root: null), members, children, childless nodes below, tokens saved by sharing, digest of the conversations that end there.

    ``paths`` has (conv_id, block, depth from 1, turn, tokens), ``lengths``
    every conversation (conv_id, length), also those without a turn, which end
    at the root. No conversations: no rows, not even a root. A digest of no ids
    is that of the empty string. Turns are equal if their digests are.
    """
    seen = materialize(_occurrences(paths, lengths), "occurrences")
    owners = seen.groupBy(*NODE).agg(F.min(F.struct("conv_id", "before")).alias("owner"), F.max("length").alias("longest"))
    owned = owners.groupBy(F.col("owner.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", F.col("owner.before").alias("before"))).alias("from"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")
    )
    spans = seen.groupBy("conv_id", "block").agg(F.count("*").alias("n")).join(owned, "conv_id", "left").select("conv_id", "block", "from", "leaf")
    # Before its owned suffix a conversation only repeats what smaller members say: those tokens are saved at every node down to there.
    total = paths.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens")).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))
    spans = spans.join(total, "conv_id", "left").select(
        "conv_id", "block", F.col("from.depth").alias("own_depth"), F.coalesce("from.before", "tokens", F.lit(0)).alias("repeated"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    first_owned = F.coalesce((F.col("own_depth") <= F.col("depth") + 1) & (F.col("depth") < F.col("length")), F.lit(False))
    adds = seen.join(spans, ["conv_id", "block"]).withColumns({"child": first_owned.cast("long"), "saved": F.greatest(F.col("repeated") - F.col("before"), F.lit(0))})
    nodes = materialize(
        adds.groupBy(*NODE).agg(
            F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
        ),
        "nodes",
    )
    ends = materialize(_ends(seen), "ends")
    discard(seen)
    none = F.lit(hashlib.sha256().hexdigest())
    return _with_parents(nodes).join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of a table (conv_id, turn, role, text) as it is; see ``ordered_turns`` for nulls and ties."""
    turns = ordered_turns(conversations)
    out = prefix_trie(*whole_paths(turns))
    discard(turns)
    return out


def op11_prefix_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that twenty neighbours share first turns."""
    turns = ordered_turns(read(spark, sf_dir, "conversations"))
    out = prefix_trie(*rebuilt_paths(turns))
    discard(turns)
    return out


_BYTE = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
OP11_SQL = f"""
WITH raw AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {SHARED} AS base,
  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: {_BYTE}), 4294967295) % {HEAD + 1} AS h FROM raw GROUP BY conv_id),
said AS (
  SELECT c.conv_id, r.role, r.text, r.pos FROM convs c JOIN raw r ON r.conv_id = c.base AND r.pos <= c.h
  UNION ALL SELECT conv_id, role, text, pos + {HEAD} FROM raw JOIN convs USING (conv_id) WHERE pos > h),
turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM said),
paths AS (SELECT conv_id, d, text, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns UNION ALL SELECT conv_id, 0, '', [] FROM convs),
nodes AS (SELECT path, d, min(conv_id) AS owner, count(*) AS n, len(list_filter(regexp_split_to_array(any_value(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tokens FROM paths GROUP BY path, d),
lengths AS (SELECT conv_id, max(d) AS length FROM paths GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM paths JOIN lengths USING (conv_id) WHERE d = length GROUP BY path),
kids AS (SELECT path[:d - 1] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT a.path, sum((b.n - 1) * b.tokens) AS saved, count(*) FILTER (b.path NOT IN (SELECT path FROM kids)) AS leaves
  FROM nodes b JOIN paths p ON p.conv_id = b.owner AND p.d <= b.d JOIN nodes a ON a.path = p.path GROUP BY a.path)
SELECT n.owner AS conv_id, n.d AS depth, up.owner AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes up ON n.d > 0 AND up.path = n.path[:n.d - 1] AND up.d = n.d - 1"""
