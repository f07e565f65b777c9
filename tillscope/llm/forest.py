"""Embedding near-duplicates: a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, settled

#: Vectors of a leaf that are compared with each other in one task; larger leaves are compared
#: block by block.
BLOCK = 2048
#: Leaves over BLOCK are listed to every task up to this many, and joined beyond.
LISTED = 100_000


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors end in zeros."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < lengths[:, None]] = values
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


class Forest:
    """Trees of `depth` splits each.

    All nodes of a level of a tree share a random direction; a node splits at the median of its
    sample on that direction, or beside it where the median would cut a dense group, and does not
    split where such a group is most of it (half of the sample within `tight`). Vectors near the
    border, as near as the nearest `spill` of the sample, go both ways. Where a node has less than
    `support` of the sample, its nearest ancestor with enough of it gives the border.
    """

    def __init__(
        self,
        sample: np.ndarray,
        trees: int,
        depth: int,
        spill: float,
        seed: int,
        tight: float = 0.0,
        support: int = 16,
    ):
        random = np.random.default_rng(seed)
        width = sample.shape[1]
        self.trees, self.depth = trees, depth
        self.directions = random.standard_normal((trees, width, max(depth, 1)))
        self.medians: list[list[np.ndarray]] = []
        self.margins: list[list[np.ndarray]] = []
        deepest = max(0, int(np.log2(max(1, len(sample) / support))))
        self.supported = [min(level, deepest) for level in range(depth)]
        for t in range(trees):
            projected = sample @ self.directions[t]
            node = np.zeros(len(sample), np.int64)
            medians, margins = [], []
            for level in range(depth):
                own = node if level <= deepest else node >> (level - deepest)
                size = 1 << self.supported[level]
                median, margin = np.zeros(size), np.zeros(size)
                order = np.argsort(own, kind="stable")
                bounds = np.searchsorted(own[order], np.arange(size + 1))
                for k in range(size):
                    values = projected[order[bounds[k] : bounds[k + 1]], level]
                    if len(values):
                        median[k] = self.border(values, tight)
                        if np.isfinite(median[k]):
                            margin[k] = np.quantile(np.abs(values - median[k]), spill)
                medians.append(median)
                margins.append(margin)
                node = 2 * node + (projected[:, level] > median[own])
            self.medians.append(medians)
            self.margins.append(margins)

    @staticmethod
    def border(values: np.ndarray, tight: float) -> float:
        steps = np.quantile(values, np.linspace(0, 1, 101))
        if steps[75] - steps[25] < tight:
            return np.inf
        normal = 0.098  # of a normal distribution, the middle tenth's share of the middle 80 %
        if steps[55] - steps[45] >= 0.5 * normal * (steps[90] - steps[10]):
            return steps[50]
        widths = steps[18:89] - steps[12:83]  # of 6 % of the values around each of 15 to 85 %
        return steps[15 + int(widths.argmax())]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every tree that a vector falls or spills into, by row."""
        rows, codes = [], []
        for t in range(self.trees):
            projected = vectors @ self.directions[t]
            row = np.arange(len(vectors))
            node = np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                own = node >> (level - self.supported[level])
                beyond = projected[row, level] - self.medians[t][level][own]
                margin = self.margins[t][level][own]
                left, right = beyond <= margin, beyond > -margin
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            codes.append(node + (t << 56))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def compare(
    first: dict[str, np.ndarray], second: dict[str, np.ndarray], code: int, least: float, same: bool
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Copies newly linked to each vector of both blocks, and links that connect the linked ones.

    A pair counts in the first leaf that holds both; the leaves of either vector tell whether
    this is it. `same`: the blocks are one and the same.
    """
    counts = np.zeros(len(first["node"])), np.zeros(len(second["node"]))
    n = len(first["node"])
    labels = np.arange(n if same else n + len(second["node"]))
    shift = 0 if same else n
    for at in range(0, n, 256):
        own = slice(at, at + 256)
        near = first["unit"][own] @ second["unit"].T >= least
        near &= first["size"][own, None] == second["size"][None, :]
        if same:
            near &= np.arange(n)[own, None] != np.arange(n)[None, :]
        i, j = np.nonzero(near)
        i += at
        if not len(i):
            continue
        for part in np.array_split(np.arange(len(i)), -(-len(i) // 65_536)):
            a, b = first["codes"][i[part]], second["codes"][j[part]]
            met = ((a[:, :, None] == b[:, None, :]) & (a < code)[:, :, None]).any((1, 2))
            fresh = part[~met]
            np.add.at(counts[0], i[fresh], second["copies"][j[fresh]])
            if not same:
                np.add.at(counts[1], j[fresh], first["copies"][i[fresh]])
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for x, ends in zip(i[starts].tolist(), np.split(j + shift, starts[1:]), strict=True):
            found = np.unique(np.append(labels[ends], labels[x]))
            if len(found) > 1:
                labels[np.isin(labels, found)] = found[0]
    nodes = first["node"] if same else np.concatenate([first["node"], second["node"]])
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return counts[0], counts[1], list(zip(nodes[moved].tolist(), nodes[labels[moved]].tolist(), strict=True))


def near_duplicates(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.95,
    trees: int = 6,
    leaf: int = 128,
    spill: float = 0.07,
    sample: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `embeddings`.

    Vectors of the same length are linked if their cosine, in double precision, is at least
    `cosine` and some leaf of some tree holds both. n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable by links, kept whether that is the row's own.
    A vector that is null, empty or zero, or has a null or non-finite component, and one whose id
    is null, links with nothing and is its own component. Repeated rows are vectors like others,
    and link. Other columns are not looked at; an empty table gives an empty one.

    The trees are fitted on a bounded sample (`sample` rows, the first by the hash of their id) and
    hold every row. Equal vectors are folded into one before; in a leaf only counts and links that
    span its components are made, never its pairs.
    """
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = settled(rows.withColumn("sound", F.coalesce(sound, F.lit(False))))
    classes = settled(
        rows.where("sound")
        .groupBy("vector")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    )
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = facts["width"] or 1
    some = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow()
    vectors = some["vector"].combine_chunks()
    vectors = vectors if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks)
    depth = max(0, int(np.ceil(np.log2(max(1, facts["n"]) / leaf))))
    fitted = matrix(vectors, width) if len(vectors) else np.zeros((0, width))
    tight = 1.5 * float(np.sqrt((2 - 2 * cosine) / width))  # spread of a pair just linked
    forest = Forest(fitted, trees, depth, spill, seed, tight)
    # As plain arrays, of a size that the sample and the depth bound.
    sent = embeddings.sparkSession.sparkContext.broadcast(vars(forest))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest.__new__(Forest)
        vars(forest).update(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, code = forest.leaves(matrix(batch.column(0), width))
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(starts), pa.array(code))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    kind = rows.schema["vector"].dataType.simpleString()
    routed = classes.select("vector", F.col("node").cast("bigint").alias("node"), "copies").mapInArrow(
        route, f"vector {kind}, node bigint, copies bigint, codes array<bigint>"
    )
    in_leaf = routed.select("*", F.explode("codes").alias("code"))
    large = settled(
        in_leaf.groupBy("code")
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    large = F.broadcast(large) if large.count() <= LISTED else large
    blocked = in_leaf.join(large, "code", "left").withColumn(
        "block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "blocks"))
    )
    each = F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)).cast("bigint") - 1)
    tiles = blocked.withColumn("other", F.explode(each)).select(
        "vector", "node", "copies", "codes", "code", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )

    def in_tile(key, table):
        code, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        lists = table["codes"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        lengths = np.diff(offsets)
        codes = np.full((table.num_rows, lengths.max()), np.iinfo(np.int64).max)
        codes[np.arange(lengths.max()) < lengths[:, None]] = lists.flatten().to_numpy()
        whole = {
            "node": table["node"].to_numpy(),
            "copies": table["copies"].to_numpy(),
            "size": np.diff(table["vector"].combine_chunks().offsets.to_numpy()),
            "unit": matrix(table["vector"].combine_chunks(), width),
            "codes": codes,
        }
        block = table["block"].to_numpy()
        first = {k: v[block == low] for k, v in whole.items()}
        second = first if low == high else {k: v[block == high] for k, v in whole.items()}
        one, two, spanning = compare(first, second, code, cosine, low == high)
        nodes, counts = first["node"], one
        if low != high:
            nodes, counts = np.concatenate([nodes, second["node"]]), np.concatenate([one, two])
        root = dict(spanning)
        own = [i for i, x in enumerate(nodes.tolist()) if counts[i] or x in root]
        return pa.table(
            {
                "node": pa.array(nodes[own]),
                "links": pa.array(counts[own].astype(np.int64)),
                "root": pa.array([root.get(x, x) for x in nodes[own].tolist()], pa.int64()),
            }
        )

    linked = settled(
        tiles.groupBy("code", "low", "high").applyInArrow(
            in_tile, "node bigint, links bigint, root bigint"
        )
    )
    degrees = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        classes.join(degrees, "node", "left")
        .join(roots, "node", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    results = rows.where("sound").join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return results.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
