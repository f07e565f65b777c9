"""Line dedup: a tree of line templates of fixed depth; templates that recur are dropped."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Memo, components, others, settled

SEED = 42
#: What stands for a token with a digit, which varies from line to line.
FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")
#: Different lines of a leaf that are compared in one task; those of larger leaves are dealt out.
LEAF = 2_000
#: Lines of a large leaf that all its lines are compared with.
PIVOTS = 8
#: Leaves whose lines are compared, and recurring templates, are listed to every task up to this
#: many, and joined beyond.
LISTED = 100_000
#: Bits of the map by which tasks pass over lines of leaves that hold nothing to compare.
MAP_BITS = 1 << 24


def digest(data: bytes) -> int:
    """XXH64 as a signed integer, as Spark's xxhash64 gives it for a string."""
    value = xxhash.xxh64_intdigest(data, SEED)
    return value - (1 << 64) if value >> 63 else value


def tokens_of(line: bytes) -> list[bytes]:
    """The line's tokens, those with a digit as FIELD.

    One or two tokens that all have digits stay as they are: in scripts without spaces they may be a
    whole line, and nothing else would tell them apart.
    """
    tokens = line.split()
    if DIGIT.search(line):
        masked = [FIELD if DIGIT.search(t) else t for t in tokens]
        if len(tokens) > 2 or masked.count(FIELD) < len(tokens):
            return masked
    return tokens


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """The place in the tree: by the number of tokens, then by the leading ones."""
    return digest(b"%d %d " % (len(tokens), depth) + b" ".join(tokens[:depth]))


def _lines(documents: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """(doc, first, leaf, line, n, at): each different line of a text that has a token.

    `doc` is the digest of the whole text: equal texts are one document. `at` are the numbers of
    the lines, from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                data = (value.as_py() or "").encode()
                doc = digest(data)
                found: dict[int, tuple] = {}
                for number, line in enumerate(data.split(b"\n")):
                    tokens = tokens_of(line)
                    if tokens:
                        key = digest(b" ".join(tokens))
                        if key in found:
                            found[key][-1].append(number)
                        else:
                            found[key] = (i, doc, leaf_of(tokens, depth), key, len(tokens), [number])
                rows += found.values()
            own = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[1], pa.int64()), batch.column(0).take(pa.array(own[0], pa.int64()))]
                + [pa.array(c, pa.int64()) for c in own[2:4]]
                + [pa.array(own[4], pa.int32()), pa.array(own[5], pa.list_(pa.int32()))],
                ["doc", "first", "leaf", "line", "n", "at"],
            )

    rows = documents.select(F.col(doc_id).cast("bigint").alias("first"), F.col(text).alias("text"))
    return rows.where("text is not null").mapInArrow(
        run, "doc bigint, first bigint, leaf bigint, line bigint, n int, at array<int>"
    )


def _leaf_map(leaves: DataFrame) -> bytes:
    """A bit for every remainder of a leaf in `leaves`: at most MAP_BITS / 8 bytes, however many."""
    bit = F.pmod("leaf", F.lit(MAP_BITS))
    word = F.call_function("div", bit, F.lit(32)).alias("word")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 32).cast("int")))
    words = leaves.groupBy(word).agg(bits.alias("bits")).collect()
    out = np.zeros(MAP_BITS // 32, np.uint32)
    if words:
        out[[w for w, _ in words]] = [b for _, b in words]
    return out.tobytes()


def _tokens(documents: DataFrame, text: str, similarity: float, depth: int, leaf_map: bytes) -> DataFrame:
    """(leaf, line, tokens): the digests of the tokens of each line that may differ from its template.

    Lines of leaves that aren't in the map are left out before their tokens are digested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Memo(digest, longest=32)
        for batch in batches:
            leaves, keys, lists = [], [], []
            for value in batch.column(0):
                for line in (value.as_py() or "").encode().split(b"\n"):
                    tokens = tokens_of(line)
                    if spare(len(tokens), similarity) > 0:
                        leaf = leaf_of(tokens, depth)
                        bit = leaf % MAP_BITS
                        if leaf_map[bit >> 3] >> (bit & 7) & 1:
                            leaves.append(leaf)
                            keys.append(digest(b" ".join(tokens)))
                            lists.append([one[t] for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.int64()), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["leaf", "line", "tokens"],
            )

    return documents.select(text).mapInArrow(run, "leaf bigint, line bigint, tokens array<bigint>")


def spare(n: int, similarity: float) -> int:
    """In how many of n places lines of one template may differ."""
    return n - math.ceil(similarity * n - 1e-9)


def parse_leaf(lines: np.ndarray, similarity: float) -> np.ndarray:
    """The template (by the place of its first line) of each line of a leaf, in their order.

    Lines that equal each other in `similarity` of all places at least are of one template, and so
    are lines that such lines connect.
    """
    most = spare(lines.shape[1], similarity)
    out = np.full(len(lines), -1)
    left = np.arange(len(lines))
    while len(left):
        first, left = left[0], left[1:]
        out[first] = first
        waiting = [first]
        while waiting and len(left):
            near = (lines[left] != lines[waiting.pop()]).sum(1) <= most
            out[left[near]] = first
            waiting += left[near].tolist()
            left = left[~near]
    return out


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a leaf in their order, and the digests of their tokens."""
    table = table.combine_chunks()
    line, values = table["line"].to_numpy(), table["tokens"].combine_chunks()
    order = np.argsort(line)
    return line[order], values.flatten().to_numpy().reshape(len(values), -1)[order]


def _large_leaves(large: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(line, found): the template of each line that resembles another one of its leaf.

    The same lines are connected as by parse_leaf(), but no task compares more than about twice LEAF
    of them. Each line is compared with a few pivots of its leaf. Then the places behind the leading
    ones are cut into one segment more than places may differ, so that lines that match share a
    segment: lines are compared within the groups that share one. Lines that a pivot connects already
    aren't compared with each other again; a group of over LEAF lines is compared block by block.
    """

    def pivots_of(table):
        line, tokens = _matrix(table)
        found = parse_leaf(tokens, similarity)
        firsts, sizes = np.unique(found, return_counts=True)
        chosen = []
        for first in firsts[np.argsort(-sizes, kind="stable")[:PIVOTS]]:
            own = np.flatnonzero(found == first)
            usual = np.zeros(len(own), np.int64)
            for column in tokens[own].T:
                _, place, often = np.unique(column, return_inverse=True, return_counts=True)
                usual += often[place]
            chosen.append(own[usual.argmax()])
        leaf = table["leaf"].combine_chunks().take(pa.array([0] * len(chosen)))
        lists = pa.array(tokens[chosen].tolist(), pa.list_(pa.int64()))
        return pa.table({"leaf": leaf, "line": line[chosen], "tokens": lists})

    def compare(table):
        line, tokens = _matrix(table)
        found = line[parse_leaf(tokens, similarity)]
        own = found != line
        return pa.table({"a": line[own], "b": found[own]})

    sample = large.where(F.pmod("line", F.ceil(F.col("lines") / LEAF)) == 0)
    pivots = sample.groupBy("leaf").applyInArrow(pivots_of, "leaf bigint, line bigint, tokens array<bigint>")
    pivots = pivots.groupBy("leaf").agg(F.collect_list(F.struct("line", "tokens")).alias("pivots"))
    n = F.size("tokens")
    most = n - F.ceil(similarity * n - 1e-9).cast("int")

    def near(pivot: Column) -> Column:
        differ = F.zip_with("tokens", pivot["tokens"], lambda x, y: (x != y).cast("int"))
        return F.aggregate(differ, F.lit(0), lambda s, x: s + x) <= most

    joined = large.join(settled(pivots), "leaf", "left")
    near_pivots = F.transform(F.filter("pivots", near), lambda pivot: pivot["line"])
    joined = settled(
        joined.select("leaf", "line", "tokens", F.coalesce(near_pivots, F.array().cast("array<bigint>")).alias("near"))
    )
    links = joined.select(F.col("line").alias("a"), F.explode("near").alias("b"))

    def at(i: Column) -> Column:
        return F.floor(i * F.greatest(n - depth, F.lit(0)) / (most + 1)).cast("int") + depth + 1

    keys = F.transform(
        F.sequence(F.lit(0), most),
        lambda i: F.xxhash64("leaf", i, F.slice("tokens", at(i), at(i + 1) - at(i))),
    )
    keyed = settled(
        joined.select(F.explode(keys).alias("key"), "line", F.coalesce(F.get("near", F.lit(0)), "line").alias("label"))
    )
    # Of a group, the lines with the label that most have are connected already.
    groups = keyed.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    groups = groups.agg(F.max(F.struct("n", "label")).alias("hub"), F.sum("n").alias("all"))
    groups = groups.where(F.col("all") > F.col("hub.n"))
    rows = keyed.join(settled(groups), "key")
    inner = F.when(F.col("all") > LEAF, F.ceil(F.col("hub.n") / LEAF)).otherwise(0)
    outer = F.when(F.col("all") > LEAF, F.ceil((F.col("all") - F.col("hub.n")) / LEAF)).otherwise(1)
    rows = rows.select("key", "line", outer.alias("outer"), inner.alias("inner"), (F.col("label") == F.col("hub.label")).alias("is_hub"))
    is_hub = F.col("is_hub") & (F.col("inner") > 0)
    block = F.when(is_hub, F.col("outer") + F.pmod("line", F.greatest("inner", F.lit(1)))).otherwise(F.pmod("line", "outer"))
    rows = rows.withColumn("block", block)
    # Blocks from `outer` on hold connected lines, so they meet only those before them.
    last = F.when(is_hub, F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    rows = rows.select(
        "key", "line", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)).alias("other")
    )
    rows = rows.select("key", "line", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    tasks = rows.join(joined.select("line", "tokens"), "line").groupBy("key", "x", "y")
    links = links.unionByName(tasks.applyInArrow(compare, "a bigint, b bigint"))
    return components(links).select(F.col("node").alias("line"), F.col("root").alias("found"))


def recurring_lines(
    documents: DataFrame,
    doc_id: str,
    text: str,
    depth: int,
    similarity: float,
    short: int,
    recurs: tuple[int, int],
) -> tuple[DataFrame, DataFrame]:
    """(each line of each different text, (line, keeper) of the lines of recurring templates).

    `keeper` is the text in which the template stays.
    """
    lines = settled(
        _lines(documents, doc_id, text, depth)
        .groupBy("line", "doc")
        .agg(F.min("first").alias("first"), F.min("leaf").alias("leaf"), F.min("n").alias("n"), F.min("at").alias("at"))
    )
    known = F.coalesce("first", F.lit((1 << 63) - 1))  # a document without id comes last
    distinct = settled(
        lines.groupBy("line").agg(
            F.min("leaf").alias("leaf"),
            F.min("n").alias("n"),
            F.count("*").alias("docs"),
            F.min(F.struct(known.alias("id"), "doc")).alias("least"),
            F.min("doc").alias("low"),
            F.max("doc").alias("high"),
        )
    )
    # A leaf whose lines occur once in all holds no recurring template.
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("total"))
    leaves = leaves.where(F.col("total") >= min(recurs)).select("leaf", "lines")
    distinct = settled(distinct.join(leaves, "leaf"))
    some = F.ceil(similarity * F.col("n") - 1e-9) < F.col("n")  # else only equal lines match
    shared = settled(distinct.where(some & (F.col("lines") > 1)).select("leaf", "lines").distinct())
    leaf_map = _leaf_map(shared)
    shared = F.broadcast(shared) if shared.count() <= LISTED else shared
    distinct = distinct.drop("lines")
    found = settled(
        _tokens(documents, text, similarity, depth, leaf_map)
        .join(shared, "leaf")
        .groupBy("leaf", "line")
        .agg(F.min("tokens").alias("tokens"), F.min("lines").alias("lines"))
    )

    def run(table):
        line, tokens = _matrix(table)
        return pa.table({"line": line, "found": line[parse_leaf(tokens, similarity)]})

    parsed = found.where(F.col("lines") <= LEAF).groupBy("leaf")
    parsed = parsed.applyInArrow(run, "line bigint, found bigint")
    large = found.where(F.col("lines") > LEAF)
    if not large.isEmpty():
        parsed = parsed.unionByName(_large_leaves(large, depth, similarity))
    keys = (
        distinct.select("line")
        .join(parsed, "line", "left")
        .select("line", F.coalesce("found", "line").alias("template"))
    )
    keyed = settled(distinct.join(keys, "line"))
    needed = F.when(F.col("n") < short, recurs[0]).otherwise(recurs[1])
    templates = settled(
        keyed.groupBy("template")
        .agg(
            F.sum("docs").alias("docs"),
            F.min("least").alias("least"),
            (F.min("low") < F.max("high")).alias("many"),
            F.min("n").alias("n"),
        )
        .where(F.col("many") & (F.col("docs") >= needed))
        .select("template", F.col("least.doc").alias("keeper"))
    )
    # Most lines may be of one template: few templates are listed, else the join can be split.
    templates = F.broadcast(templates) if templates.count() <= LISTED else templates
    return lines, settled(keyed.select("line", "template").join(templates, "template").select("line", "keeper"))


def drop_recurring(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = 3,
    similarity: float = 0.8,
    short: int = 8,
    recurs: tuple[int, int] = (3, 2),
) -> DataFrame:
    """The documents without lines of recurring templates, and n_lines and n_dropped (bigint).

    Lines are parsed by a tree: their number of tokens, then `depth` leading tokens (a token with a
    digit is a variable field), then, within a leaf, by the lines that equal them in `similarity` of
    all places at least: lines that these matches connect are one template. A template recurs
    if its lines occur in at least two different texts, `recurs` times in all: the first number
    for templates of fewer than `short` tokens, the second for longer ones (a text counts once for
    each different line). It stays in the text of its smallest doc_id and goes from all others.
    Lines of one or two tokens recur as others do; of lines without a token, blank ones, all stay.

    Equal texts are one document here, so exact copies stay copies. Null text stays null, with no
    lines; empty text has one line and keeps it. A document may lose all lines; it stays, with an
    empty text. A null doc_id comes after all others. Repeated rows stay; columns of the two names
    are replaced; an empty table gives an empty one. Only digests are shuffled to find the lines;
    a leaf of over LEAF different lines is compared in several tasks, with the same result.
    """
    lines, recurring = recurring_lines(
        documents, doc_id, text, depth, similarity, short, recurs
    )
    dropped = settled(
        lines.select("line", "doc", "at")
        .join(recurring, "line")
        .where("doc <> keeper")
        .groupBy("doc")
        .agg(F.flatten(F.collect_list("at")).alias("gone"))
    )
    names = ("n_lines", "n_dropped")
    # The documents' columns travel as one, so none can clash.
    packed = documents.select(
        F.struct(*others(documents, names)).alias("row"), F.xxhash64(F.col(text)).alias("doc")
    )
    whole = packed.join(dropped, "doc", "left")
    parts = F.split(F.col(f"row.`{text}`"), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    left = F.transform(places, lambda i: F.get(parts, i))
    new_text = F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.size(parts), F.lit(0))
    n_lines = F.when(F.col(f"row.`{text}`").isNull(), 0).otherwise(n_lines)

    def column(c: str) -> Column:
        return new_text.alias(c) if c == text else F.col(f"row.`{c}`").alias(c)

    return whole.select(
        *[column(c) for c in documents.columns if c.lower() not in names],
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
