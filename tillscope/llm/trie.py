"""Conversation prefix trie: ROLLUP over columns of turn ids aggregates all prefixes together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.functions.ordering import with_position

from .shared import settled

#: Turns per block of columns: ROLLUP makes one row more than that of every block.
WIDTH = 4
#: Conversations whose ids are joined to one piece of text before a node's pieces are hashed.
CHUNK = 4096
TURNS = tuple(f"t{j}" for j in range(1, WIDTH + 1))
KEY = ("k1", "k2")


def placed(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv, place, id, chars) and (conv, first, n).

    place counts a conversation's turns from 0 in the order of their numbers (nulls first, turns of
    one number by id). id are 16 bytes of SHA-256 over role and text, null ones read as empty, and
    chars the text's code points. first grows with conv, n is the number of turns. Rows without a
    conversation are left out; repeated rows are turns of their own; an empty table gives empty
    ones; other columns are not looked at. A conversation may hold any share of the rows: the
    places come from one sort of all turns by range, not from a task per conversation. Texts don't
    move.
    """
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    narrow = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("id"),
        F.length(text).cast("bigint").alias("chars"),
    )
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("id")]
    at = with_position(narrow, order, "at")
    spans = settled(at.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    place = (F.col("at") - F.col("first")).alias("place")
    return at.join(spans, "conv").select("conv", place, "id", "chars"), spans


def rebuilt(
    turns: DataFrame, conversations: DataFrame, base: Column, shared: Column, most: int
) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first `shared` turns of conversation `base` for its own first ones.

    `turns` and `conversations` as `placed` gives them; base and shared are columns of conv, shared
    is at most `most`. A base of fewer turns gives all it has, an absent one none; then the
    conversation's own turns after its first `shared` follow. Returns turns and (conv, first, n).
    """
    whole = conversations.select("*", base.alias("base"), shared.cast("bigint").alias("shared"))
    lengths = conversations.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("shared", F.coalesce("n_base", F.lit(0)))
    own = F.greatest(F.col("n") - F.col("shared"), F.lit(0))
    whole = settled(
        whole.join(lengths, "base", "left").select(
            "conv", "first", "base", "shared", taken.alias("taken"), (taken + own).alias("n")
        )
    )
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv", "base")
    heads = heads.join(whole.select("conv", "base", "taken"), "base").where("place < taken")
    rest = turns.join(whole.select("conv", "shared", "taken"), "conv").where("place >= shared")
    names = ("conv", "place", "id", "chars")
    rest = rest.withColumn("place", F.col("place") - F.col("shared") + F.col("taken"))
    return heads.select(*names).unionByName(rest.select(*names)), whole.select("conv", "first", "n")


def _hashes(place: Column, id_: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its place; a node's key is their sum by XOR."""
    return F.xxhash64(place, id_), F.xxhash64(id_, place)


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and block of WIDTH turns; a turnless conversation has one, too.

    conv, first, n, block, t1.. (ids) and c1.. (code points), null beyond the end, and k1, k2: the
    key of the node in which the block before it ends.
    """
    place = F.col("place")
    one, two = _hashes(place, F.col("id"))
    at = place % WIDTH + 1

    def spread(column: str, name: str) -> list[Column]:
        return [F.max(F.when(at == j, F.col(column))).alias(f"{name}{j}") for j in range(1, WIDTH + 1)]

    rows = turns.groupBy("conv", F.floor(place / WIDTH).cast("bigint").alias("block")).agg(
        *spread("id", "t"), *spread("chars", "c"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2")
    )
    rows = conversations.join(rows, "conv", "left").withColumn("block", F.coalesce("block", F.lit(0)))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    keys = {k: F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)) for k, x in zip(KEY, ("x1", "x2"))}
    return settled(rows.withColumns(keys).drop("x1", "x2"))


def _rolled(frame: DataFrame, *aggregates: str) -> DataFrame:
    """All prefixes of all blocks by one ROLLUP: level, depth, k1, k2 (key), p1, p2 (the parent's)."""
    turns = ", ".join(TURNS)
    rolled = frame.sparkSession.sql(
        f"SELECT block, {', '.join(KEY)}, {turns}, grouping_id() AS gid, {', '.join(aggregates)} "
        f"FROM {{blocks}} GROUP BY block, {', '.join(KEY)}, ROLLUP ({turns})",
        blocks=frame,
    )
    # grouping_id has a bit set for every column that is rolled up.
    level = WIDTH - F.bit_count("gid")
    last = F.coalesce(*[F.when(level == j, F.col(t).isNotNull()) for j, t in enumerate(TURNS, 1)])
    # Level 0 of a further block is the last level of the one before, and a row whose last column
    # is null without being rolled up stands for conversations that have ended.
    rolled = rolled.withColumn("level", level).where(F.when(level == 0, F.col("block") == 0).otherwise(last))

    def key(which: int, upto: Column) -> Column:
        parts = [
            F.when(upto >= j, _hashes(F.col("block") * WIDTH + (j - 1), F.col(t))[which]).otherwise(0)
            for j, t in enumerate(TURNS, 1)
        ]
        return _xor([F.col(KEY[which]), *parts])

    rolled = rolled.withColumns(
        {
            "depth": F.col("block") * WIDTH + F.col("level"),
            "n1": key(0, F.col("level")),
            "n2": key(1, F.col("level")),
            "p1": key(0, F.col("level") - 1),
            "p2": key(1, F.col("level") - 1),
        }
    )
    names = ("block", *TURNS, *KEY, "gid")
    return rolled.drop(*names).withColumnsRenamed({"n1": "k1", "n2": "k2"})


def nodes(blocks: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in `blocks`, the empty one included.

    k1, k2 (the node's key), depth, conv (the smallest member), parent_conv (the parent's smallest
    member), n_convs (members), n_children, n_leaves (childless nodes of its subtree, itself
    included) and saved (over its subtree, n_convs - 1 times the code points of each node's last
    turn). An empty table has no conversation and so no node.

    Sums over subtrees need no walk through the tree. Every node belongs to its smallest member;
    that conversation owns the nodes from its first own depth on. So a first ROLLUP finds, per
    conversation, that depth and whether it owns a leaf. A second one then sums over the members:
    a child is owned by one member of the parent, a leaf by one member of every node above it, and
    of a member's turns below a node those that it doesn't own are saved.
    """
    found = _rolled(blocks, "min(conv) AS conv", "max(n) AS longest")
    owned = found.groupBy("conv").agg(
        F.min("depth").alias("own"), F.max(F.col("longest") == F.col("depth")).alias("leaf")
    )
    # Beyond its end for a conversation that owns nothing.
    own = F.coalesce("own", F.col("n") + 1)
    whole = blocks.join(owned, "conv", "left").withColumn("own", own)
    depths = [F.col("block") * WIDTH + j for j in range(WIDTH + 1)]
    zero = F.lit(0).cast("bigint")
    saved = [F.coalesce(F.when(depths[j] < F.col("own"), F.col(f"c{j}")), zero) for j in range(1, WIDTH + 1)]
    later = W.partitionBy("conv").orderBy("block").rowsBetween(1, W.unboundedFollowing)
    whole = whole.withColumn("here", reduce(lambda a, b: a + b, saved))
    whole = whole.withColumn("later", F.coalesce(F.sum("here").over(later), zero))
    below = {"s0": F.col("here") + F.col("later")}
    for j in range(1, WIDTH + 1):
        below[f"s{j}"] = reduce(lambda a, b: a + b, saved[j - 1 :]) + F.col("later")
    child = {
        f"d{j}": ((F.col("own") <= depths[j] + 1) & (depths[j] + 1 <= F.col("n"))).cast("bigint")
        for j in range(WIDTH + 1)
    }
    measured = whole.select(
        "conv", "block", *KEY, *TURNS, "own", F.coalesce("leaf", F.lit(False)).cast("bigint").alias("leaf"),
        *[c.alias(n) for n, c in (below | child).items()],
    )
    sums = [f"sum({n}) AS {n}" for n in below | child]
    rolled = _rolled(
        measured, "min(struct(conv, own)) AS top", "count(*) AS n_convs", "sum(leaf) AS n_leaves", *sums
    )

    def of_level(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("level") == j, F.col(f"{name}{j}")) for j in range(WIDTH + 1)])

    rolled = settled(
        rolled.select(
            *KEY,
            F.when(F.col("depth") > 0, F.col("p1")).alias("p1"),
            F.when(F.col("depth") > 0, F.col("p2")).alias("p2"),
            "depth",
            F.col("top.conv").alias("conv"),
            (F.col("depth") == F.col("top.own")).alias("first"),
            "n_convs",
            of_level("d").alias("n_children"),
            "n_leaves",
            of_level("s").alias("saved"),
        )
    )
    # Below its first own node a conversation owns the parent, too. The others look it up; a
    # parent of very many children is a hot key on one side, which an adaptive join can split.
    top = F.col("first") & (F.col("depth") > 0)
    parents = rolled.select(
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        (F.col("depth") + 1).alias("depth"),
        F.col("conv").alias("parent_conv"),
    )
    looked_up = rolled.where(top).join(parents, ["p1", "p2", "depth"])
    plain = rolled.where(~top).withColumn("parent_conv", F.when(F.col("depth") > 0, F.col("conv")))
    return looked_up.unionByName(plain).drop("p1", "p2", "first")


def ends(blocks: DataFrame) -> DataFrame:
    """(k1, k2, depth, conv, first): the node in which each conversation ends."""
    depth = F.col("block") * WIDTH + sum(F.col(t).isNotNull().cast("bigint") for t in TURNS)
    keys = []
    for which, k in enumerate(KEY):
        parts = [
            F.when(F.col(t).isNotNull(), _hashes(F.col("block") * WIDTH + j, F.col(t))[which]).otherwise(0)
            for j, t in enumerate(TURNS)
        ]
        keys.append(_xor([F.col(k), *parts]).alias(k))
    return blocks.where(depth == F.col("n")).select(*keys, F.col("n").alias("depth"), "conv", "first")


_DIGESTS = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]
)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key and piece to one digest per key; nothing but the digest is held."""
    current, digest = None, None
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, depth, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (k1, k2, depth) != current:
                if current is not None:
                    rows.append((*current, digest.hexdigest()))
                current, digest = (k1, k2, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGESTS)], schema=_DIGESTS
            )
    if current is not None:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(_DIGESTS.names, (*current, digest.hexdigest())))], schema=_DIGESTS
        )


def ends_digests(ended: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256): SHA-256 of the conversations' ids, ascending, comma-joined.

    The ids of a node are first joined in pieces of CHUNK neighbouring conversations at most, so a
    node in which a third of all conversations end is no group of one task; its pieces then go
    through the digest one after another, in a sort that can spill.
    """
    piece = F.floor(F.col("first") / CHUNK).cast("bigint").alias("piece")
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = ended.groupBy(*KEY, "depth", piece).agg(F.array_join(ids, ",").alias("ids"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "depth", "piece")
    return ordered.select(*KEY, "depth", "ids").mapInArrow(
        _hashed, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string"
    )


def digested(blocks: DataFrame) -> DataFrame:
    """`nodes` with the digest of the conversations that end in each (of none: the empty string's)."""
    found = nodes(blocks).join(ends_digests(ends(blocks)), [*KEY, "depth"], "left")
    none = hashlib.sha256().hexdigest()
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
