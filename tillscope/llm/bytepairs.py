"""Byte-level BPE encoding and decoding through a SentencePiece model written from the ranks."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, others

#: Bytes stand in the model as the characters from here on: none of them is a space or a mark
#: that the model treats in its own way.
FIRST = 0x100


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (a token in base64 and its rank on each line), by rank."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    ranks = {int(rank): base64.b64decode(token) for token, rank in rows}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def mapped(data: bytes) -> str:
    return "".join([chr(FIRST + b) for b in data])


def write_model(tokens: list[bytes]) -> bytes:
    """A SentencePiece BPE model (a protocol buffer) of the tokens.

    Each token is a piece of byte characters with its negative rank as score, so that the merge
    with the lowest rank comes first. Text is taken as it is: no normalisation, no added space.
    """

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(out) + bytes([n])

    def field(number: int, value: int | float | bytes) -> bytes:
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    unknown, bpe = 2, 2
    pieces = [field(1, b"<unk>") + field(2, 0.0) + field(3, unknown)]
    pieces += [field(1, mapped(t).encode()) + field(2, float(-rank)) for rank, t in enumerate(tokens)]
    trainer = field(3, bpe) + field(4, len(pieces)) + field(40, 0)
    trainer += b"".join(varint(n << 3) + varint((1 << 64) - 1) for n in (41, 42, 43))  # none: -1
    normalizer = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(field(1, p) for p in pieces) + field(2, trainer) + field(3, normalizer)


class ByteCodec:
    """Text to ids and back."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        self.tokens = tokens
        self.ranks = {t: rank for rank, t in enumerate(tokens)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.ids_of = Memo(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        data = piece.encode()
        if (rank := self.ranks.get(data)) is not None:  # a whole token needs no merges
            return rank.to_bytes(4, "little")
        ids = np.array(self.processor.encode(mapped(data)), "<u4") - 1  # id 0 is <unk>
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids_of.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(frame: DataFrame, path: str, pattern: str):
    """Makes a codec on an executor; the vocabulary, of fixed size, goes there once."""
    tokens = read_ranks(path)
    sent = frame.sparkSession.sparkContext.broadcast((tokens, write_model(tokens)))
    return lambda: ByteCodec(*sent.value, pattern)


def _arrow(function, kind: str):
    return F.arrow_udf(function, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def encode(frame: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds `ids` (binary: little-endian unsigned 32-bit token ids of the whole text).

    Null text counts as empty; empty text has no ids. Each match of the pattern is encoded
    separately, without special tokens. Other columns and repeated rows stay as they are; a column
    `ids` is replaced; an empty table gives an empty one.
    """
    codec = _codec(frame, path, pattern)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec()
        for texts in batches:
            yield pa.array([own.encode(t.as_py() or "") for t in texts], pa.binary())

    return frame.select(*others(frame, ("ids",)), _arrow(run, "binary")(F.col(text)).alias("ids"))


def decode(frame: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the bytes that the ids stand for; null ids give no bytes."""
    codec = _codec(frame, path, pattern)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec()
        for rows in batches:
            yield pa.array([own.decode(r.as_py() or b"") for r in rows], pa.binary())

    decoded = _arrow(run, "binary")(F.col(ids)).alias("decoded")
    return frame.select(*others(frame, ("decoded",)), decoded)


def round_trip(frame: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: what `encode`, then `decode` give, as digests.

    The ids and the decoded bytes of one text at a time are held, none is shuffled. Nulls, empty
    texts, repeated rows and columns of these names as in `encode`.
    """
    codec = _codec(frame, path, pattern)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec()
        for texts in batches:
            counts, ids_digests, digests = [], [], []
            for t in texts:
                ids = own.encode(t.as_py() or "")
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                digests.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(digests, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kept = frame.select(*others(frame, names))
    digests = frame.select(*others(frame, names), _arrow(run, kind)(F.col(text)).alias(names[0]))
    return digests.select(*others(kept, ()), *[F.col(f"{names[0]}.{n}").alias(n) for n in names])
