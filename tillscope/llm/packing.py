"""Packing documents into sequences: linear grouping of the long pieces, best fit of the short."""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .shared import Memo, settled

#: Characters of text tokenised at once.
BLOCK = 1 << 22


class WordEncoder:
    """Ids of whole texts from a `tokenizers` file whose pieces never span white space.

    Arrow splits the texts at ASCII white space, numbers the different words and puts their ids in
    the words' places, so that each is looked at once a block of texts. Words of plain Latin letters
    and signs, which the file's normalisation can only lower-case, are split here and go to the
    library's model piece by piece; other new words go through the whole library many at a time,
    with a mark between them that is a token of its own. Pieces and other words are remembered.
    """

    MARK = "\x00"
    LONGEST = 32  # characters of a word that is remembered for later blocks
    PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ\\n]+")
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, vocabulary: str, most: int = 300_000):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        (self.mark,) = self.ids([self.MARK])[0]
        self.known: dict[str, bytes] = {}
        self.most = most
        config = json.loads(vocabulary)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.split = None
        steps = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        split = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps == self.NORMALIZERS and split.get("invert") and "Regex" in split.get("pattern", {}):
            self.split = regex.compile(split["pattern"]["Regex"])
        self.bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.piece_ids = Memo(self.merge, most=600_000)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merge(self, piece: str) -> bytes:
        text = piece if piece.isascii() else self.bytes_as_text(piece)[0][0]
        ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def simple(self, text: str) -> bool:
        """Whether this word, or every word of these lines, can be split here."""
        return (
            self.split is not None
            and self.PLAIN.fullmatch(text) is not None
            and not any(special in text for special in self.special)
        )

    def plain_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words that are all simple."""
        pieces, split = self.piece_ids, self.split
        return [
            pieces[low] if low.isalpha() else b"".join(map(pieces.__getitem__, split.findall(low)))
            for low in "\n".join(words).lower().split("\n")
        ]

    def learn(self, words: list[str]) -> None:
        odd = [w for w in words if self.MARK in w]
        marked = [w for w in words if self.MARK not in w]
        for i in range(0, len(marked), 4096):
            part = marked[i : i + 4096]
            ids = np.array(self.ids([f" {self.MARK} ".join(part)])[0], "<u4")
            marks = (4 * np.flatnonzero(ids == self.mark)).tolist()
            raw, starts = ids.tobytes(), [0, *[m + 4 for m in marks]]
            ends = [*marks, len(raw)]
            self.known |= {w: raw[a:b] for w, a, b in zip(part, starts, ends, strict=True)}
        for w, own in zip(odd, self.ids(odd), strict=True):
            self.known[w] = np.array(own, "<u4").tobytes()

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different words."""
        if self.simple("\n".join(words)):
            return self.plain_ids(words)
        plain = [w for w in words if self.simple(w)]
        own = dict(zip(plain, self.plain_ids(plain), strict=True)) if plain else {}
        if len(self.known) > self.most:
            self.known.clear()
        others = [w for w in words if w not in own]
        new = [w for w in others if w not in self.known]
        self.learn(new)
        own |= {w: self.known[w] for w in others}
        for w in new:
            if len(w) > self.LONGEST:
                del self.known[w]
        return [own[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        own = pa.array(self.word_ids(words.dictionary.to_pylist()), pa.large_binary())
        ids = own.take(words.indices)
        ends = pc.list_value_length(split).to_numpy().cumsum()
        _, offsets, raw = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[ends].tolist() if len(ids) else [0] * len(texts)
        return [raw[a:b].to_pybytes() for a, b in pairwise([0, *ends])]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> WordEncoder:
    """One encoder a Python worker, so that its tasks share the pieces they have met."""
    return WordEncoder(vocabulary)


def pieces(
    documents: DataFrame, path: str, size: int, end: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids, cut into `size` pieces.

    A document's ids are its whole text's, then `end`; null text counts as empty. Only a document
    of more than `size` ids has more than one piece; the last may be shorter. `start` counts the
    document's ids before the piece. A null id stays null, and repeated rows give repeated pieces.
    """
    sent = documents.sparkSession.sparkContext.broadcast(Path(path).read_text())  # of fixed size
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(sent.value)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []

            def add(first: int, block: list[str], rows=rows):
                for i, ids in enumerate(words.encode(block), first):
                    ids += last
                    for at in range(0, len(ids), 4 * size):
                        own = ids[at : at + 4 * size]
                        rows.append((i, at // (4 * size), at // 4, len(own) // 4, zlib.crc32(own)))

            block: list[str] = []
            first = length = 0
            for i, t in enumerate(batch.column(1)):
                block.append(t.as_py() or "")
                length += len(block[-1])
                if length >= BLOCK:
                    add(first, block)
                    block, first, length = [], i + 1, 0
            add(first, block)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32())]
                + [pa.array(c, pa.int64()) for c in columns[2:]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def _best_filling(sizes: np.ndarray, counts: np.ndarray, space: int) -> list[int]:
    """Groups (as often as they are used) whose sizes fill as much of `space` as can be."""
    usable = [g for g in range(len(sizes)) if counts[g] and sizes[g] <= space]
    reach = np.full(space + 1, -1, np.int32)  # the group that a filling of this length ends with
    reach[0] = len(sizes)
    used = np.zeros(space + 1, np.int32)
    for g in usable:
        s = int(sizes[g])
        used[:] = 0
        fresh = np.flatnonzero(reach >= 0)
        for _ in range(min(int(counts[g]), space // s)):
            fresh = fresh[fresh + s <= space] + s
            fresh = fresh[reach[fresh] < 0]
            if not len(fresh):
                break
            reach[fresh] = g
        if reach[space] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    chosen = []
    while at:
        chosen.append(int(reach[at]))
        at -= int(sizes[chosen[-1]])
    return chosen


def configurations(
    sizes: np.ndarray, counts: np.ndarray, capacity: int
) -> Iterator[tuple[list[int], int]]:
    """(groups in a sequence, number of such sequences) that use up all `counts` of the few sizes.

    Each configuration holds the largest size left and the filling that leaves least space beside
    it; it is used as often as the counts allow.
    """
    left = counts.astype(np.int64).copy()
    while left.any():
        g = int(np.flatnonzero(left)[np.argmax(sizes[np.flatnonzero(left)])])
        rest = left.copy()
        rest[g] -= 1
        chosen = [g, *_best_filling(sizes, rest, capacity - int(sizes[g]))]
        need = np.bincount(chosen, minlength=len(sizes))
        times = int((left[need > 0] // need[need > 0]).min())
        left -= need * times
        yield chosen, times


def pack(lengths: np.ndarray, capacity: int, small: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, none over `capacity`; sequences are numbered from 0.

    Lengths over `small` are ordered and dealt into `groups` groups of equal cardinality, each
    rounded up to its largest; configurations of those few sizes are chosen and each place is given
    to an actual length of its group. The others go, longest first, where they leave least space,
    as long as any sequence has room. Equal lengths are taken in their order.
    """
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > small]
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    members = [m for m in np.array_split(large, groups) if len(m)]
    sizes = np.array([lengths[m[0]] for m in members], np.int64)
    places = [iter(m.tolist()) for m in members]
    for chosen, times in configurations(sizes, np.array([len(m) for m in members]), capacity):
        for _ in range(times):
            at = 0
            for g in chosen:
                i = next(places[g])
                sequence[i], offset[i] = len(filled), at
                at += int(lengths[i])
            filled.append(at)
    room: dict[int, list[int]] = defaultdict(list)
    for s, at in enumerate(filled):
        room[capacity - at].append(s)
    spaces = sorted(room)
    for i in order[lengths[order] <= small].tolist():
        n = int(lengths[i])
        k = bisect_left(spaces, n)
        if k == len(spaces):
            s, space = len(filled), capacity
            filled.append(0)
        else:
            space = spaces[k]
            s = room[space].pop()
            if not room[space]:
                del room[space], spaces[k]
        sequence[i], offset[i] = s, filled[s]
        filled[s] += n
        if space > n:
            if space - n not in room:
                insort(spaces, space - n)
            room[space - n].append(s)
    return sequence, offset


def best_fit(
    cut: DataFrame,
    capacity: int,
    small: int = 1536,
    groups: int = 400,
    rows_per_task: int = 32_768,
) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `capacity`.

    The rows are dealt evenly, whatever their ids, over tasks of about `rows_per_task`; each packs
    its own share, which costs at most a partly filled sequence or two a task. Offsets in a
    sequence start at 0 and have no gaps. Repeated rows are packed like others, nulls in other
    columns stay, and an empty table gives an empty one.
    """
    rows = settled(cut)
    tasks = max(1, -(-rows.count() // rows_per_task))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own:
            return
        table = pa.Table.from_batches(own).combine_chunks()
        sequence, offset = pack(table["length"].to_numpy(), capacity, small, groups)
        first = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(sequence + first))
        yield from table.append_column("offset", pa.array(offset)).to_batches()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(tasks).mapInArrow(packed, f"{kind}, sequence_id bigint, offset bigint")
