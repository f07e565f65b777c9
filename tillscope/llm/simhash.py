"""SimHash near-duplicates: an inverted index of byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, settled

BITS, BYTES = 64, 8
SEED = 42
#: Fingerprints in a posting list that are compared with each other at once; longer lists are
#: first split by further bits.
LIST = 4096
#: Shingles whose bits are counted at once.
BLOCK = 1 << 17


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 of the text's word shingles, A-Z lower-cased; of the whole if it has fewer words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII space separates
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    rows = zip(*[words[i:] for i in range(shingle)], strict=False)
    return [xxhash.xxh64_intdigest(b" ".join(row), SEED) for row in rows]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints: for each list the bits that are set in more than half of its hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter((x for own in hashes for x in own), np.uint64, int(sizes.sum()))
    places = np.arange(BYTES) * 256 + flat.astype(">u8").view(np.uint8).reshape(-1, BYTES)
    cells = places + (np.repeat(np.arange(len(hashes)), sizes) * (256 * BYTES))[:, None]
    values = np.bincount(cells.ravel(), minlength=len(hashes) * 256 * BYTES)
    bits_of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    counts = (values.reshape(-1, 256) @ bits_of).reshape(len(hashes), BITS)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(
    documents: DataFrame, shingle: int, doc_id: str, text: str, carried: Sequence[Column] = ()
) -> DataFrame:
    """(doc_id, fp, ...): the fingerprint of each row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, block, size = [], [], 0
            for t in texts:
                block.append(shingle_hashes(t.as_py() or "", shingle))
                size += len(block[-1])
                if size >= BLOCK or len(block) >= 512:
                    out.append(majority(block))
                    block, size = [], 0
            if block:
                out.append(majority(block))
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))

    fingerprint = F.arrow_udf(run, "bigint", F.ArrowUDFType.SCALAR_ITER)
    own = fingerprint(F.col(text)).alias("fp")
    more = [F.struct(*carried).alias("carried")] if carried else []
    return documents.select(F.col(doc_id).alias("doc_id"), own, *more)


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def position_masks(distance: int) -> list[int]:
    """Sets of byte positions, one of which at least is equal in every pair to be found.

    Of the 8 positions at most `distance` differ. So one half of them has at least half of the
    guaranteed matches; the sets are the choices of that many positions from either half.
    """
    matches = -(-(BYTES - distance) // 2)
    halves = range(BYTES // 2), range(BYTES // 2, BYTES)
    return [
        sum(0xFF << (8 * p) for p in chosen)
        for half in halves
        for chosen in combinations(half, matches)
    ]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks with more bits: of `distance` + 1 parts of the free bits one is equal in every pair."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    parts = np.array_split(np.array(free), distance + 1)
    return [mask | sum(1 << int(b) for b in part) for part in parts]


def link_list(values: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of a posting list the first one it is connected with in the list.

    Shared positional bytes are tallied for every pair; pairs that reach the guaranteed number of
    matches are verified by their bits. The result spans the list's components: a row for each
    fingerprint, not for each pair.
    """
    labels = np.arange(len(values))
    for at in range(0, len(values), 256):
        differ = values[at : at + 256, None] ^ values[None, :]
        tally = (differ[..., None].view(np.uint8) == 0).sum(-1, dtype=np.uint8)
        rows, columns = np.nonzero(tally >= BYTES - distance)
        near = np.bitwise_count(differ[rows, columns]) <= distance
        rows, columns = rows[near], columns[near]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for i, own in zip(rows[starts].tolist(), np.split(columns, starts[1:]), strict=True):
            found = np.unique(labels[own])
            if len(found) > 1 or found[0] != labels[at + i]:
                found = np.union1d(found, labels[at + i])
                labels[np.isin(labels, found)] = found[0]
    return values[labels]


def links(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b): links of fingerprints at most `distance` bits apart, enough to connect them all.

    `prints` has distinct fingerprints `fp`. A posting list holds the fingerprints that share some
    positional bytes. Lists of more than LIST fingerprints are split by further bits, again and
    again, such that every pair is still found; with so few free bits left that LIST
    fingerprints can't differ, this ends.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for values in batch.column(0):
                own = np.sort(values.values.to_numpy().view(np.uint64))
                root = link_list(own, distance)
                firsts.append(own[own != root].view(np.int64))
                seconds.append(root[own != root].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(firsts)), pa.array(np.concatenate(seconds))], ["a", "b"]
            )

    def literals(masks: list[int]) -> Column:
        return F.array(*[F.lit(signed(m)).cast("bigint") for m in masks])

    masks = position_masks(distance)
    postings = prints.select("fp", F.explode(literals(masks)).alias("mask"))
    found = None
    while True:
        keyed = postings.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("size")).where("size > 1")
        shared = settled(keyed.join(sizes, ["mask", "bits"]))
        lists = (
            shared.where(F.col("size") <= LIST)
            .groupBy("mask", "bits")
            .agg(F.collect_list("fp").alias("fps"))
        )
        own = lists.select("fps").mapInArrow(linked, "a bigint, b bigint")
        found = own if found is None else found.unionByName(own)
        long_lists = shared.where(F.col("size") > LIST)
        if long_lists.isEmpty():
            return found
        finer = {m: finer_masks(m, distance) for m in masks}
        masks = sorted({m for own in finer.values() for m in own})
        choice = F.create_map(
            *[x for m, own in finer.items() for x in (F.lit(signed(m)).cast("bigint"), literals(own))]
        )
        postings = long_lists.select("fp", F.explode(choice[F.col("mask")]).alias("mask")).distinct()


def near_duplicates(
    documents: DataFrame,
    shingle: int = 3,
    distance: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    carried: Sequence[Column] = (),
) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, ...) for every row of `documents`.

    Two documents are linked if their fingerprints differ in at most `distance` (0 to 7) of 64
    bits; component_id is the smallest doc_id that links reach, the document's own included, and
    component one of the group's fingerprints. `carried` are further columns to return. Null
    text counts as empty: without words the fingerprint is zero, linked like any other. A null
    doc_id stays null and is never a component_id unless all of a component's are null. Repeated
    rows give repeated results; other columns are not looked at; an empty table gives an empty one.

    Copies share a fingerprint and are folded before the index; only distinct fingerprints are
    compared, and links, components and fingerprints stay distributed.
    """
    if not 0 <= distance < BYTES:
        raise ValueError("distance is 0 to 7 bits")
    rows = settled(fingerprints(documents, shingle, doc_id, text, carried))
    prints = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")

    def digits(fingerprint: str) -> Column:
        return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))

    return rows.join(named, "fp").select(
        "doc_id",
        digits("fp").alias("fingerprint"),
        "component_id",
        digits("root").alias("component"),
        *(["carried.*"] if carried else []),
    )
