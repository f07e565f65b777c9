"""Token counts of every prefix of a text, by dynamic programming over a byte-level BPE."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .shared import Memo, others

#: How this kind of vocabulary splits text before its merges: a fixed value of the format.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class PrefixCounter:
    """Exact counts for a byte-level BPE vocabulary in the `tokenizers` format.

    The encoding of a prefix without its last token is the encoding of a shorter prefix, and
    tokens in a row are an encoding if every two neighbours are. So the last token of each prefix
    of a piece is the one token that ends there and that the last token of the prefix before it
    bears as neighbour; its count is one more than that prefix's.
    """

    def __init__(self, vocabulary: str):
        tokenizer = Tokenizer.from_str(vocabulary)
        self.model = tokenizer.model
        tokens = tokenizer.get_vocab(with_added_tokens=False)
        self.tokens = frozenset(tokens)
        self.longest = max(map(len, tokens))
        special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        special.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(SPLIT)
        self.spaces = regex.compile(r"\s+")
        order = sorted(ByteLevel.alphabet())
        plain = [c for c in order if ord(c) < 0x100]
        moved = iter(c for c in order if ord(c) >= 0x100)
        alphabet = {ord(c): c for c in plain}
        self.alphabet = {b: alphabet.get(b) or next(moved) for b in range(256)}
        self.neighbours = Memo(self.fit, most=500_000)
        self.known: dict[str, tuple[int, str]] = {}
        self.total_of = Memo(lambda piece: self.states(piece)[0][-1], most=700_000)

    def mapped(self, text: str) -> str:
        return text if text.isascii() and text.isalnum() else text.encode().decode("latin-1").translate(self.alphabet)

    def fit(self, pair: tuple[str, str]) -> bool:
        first, second = pair
        found = self.model.tokenize(first + second)
        return len(found) == 1 + bool(first) and found[-1].value == second

    def prefixes(self, piece: str) -> np.ndarray:
        """Token counts of the piece's prefixes of 0, 1, ... bytes."""
        return np.array(self.states(piece)[0])

    def states(self, piece: str) -> tuple[list[int], list[str]]:
        """For the piece's prefixes of 0, 1, ... bytes the token counts and the last tokens."""
        text, known = self.mapped(piece), self.known
        tokens, neighbours = self.tokens, self.neighbours
        if len(known) > 500_000:
            known.clear()
        counts, last = [0], [""]
        for end in range(1, len(text) + 1):
            prefix = text[:end] if end <= 24 else ""
            state = known.get(prefix)
            if state is None:
                for start in range(max(0, end - self.longest), end):
                    token = text[start:end]
                    if token in tokens and neighbours[last[start], token]:
                        state = counts[start] + 1, token
                        break
                if prefix:
                    known[prefix] = state
            counts.append(state[0])
            last.append(state[1])
        return counts, last

    def segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, whether it is a special string), in order, over the whole text."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield at, found.start(), False
            yield found.start(), found.end(), True
            at = found.end()
        yield at, len(text), False

    def plain(self, text: str) -> int:
        return sum(map(self.total_of.__getitem__, self.pattern.findall(text)))

    def total(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        return sum(1 if special else self.plain(text[a:b]) for a, b, special in self.segments(text))

    def every(self, text: str) -> np.ndarray:
        """The token count of text[:k] for k from 0 to the text's length."""
        out = np.zeros(len(text) + 1, np.int64)
        base = 0  # tokens of what ends where the segment starts
        tail, before = 0, 0  # start of the last piece that more text could change; tokens before it
        for a, b, special in self.segments(text):
            if special:
                for k in range(a + 1, b):  # cut off, the special string is ordinary text
                    out[k] = before + self.plain(text[tail:k])
                base += 1
                out[b], tail, before = base, b, base
                continue
            runs = [(m.start(), m.end()) for m in self.spaces.finditer(text, a, b)]
            tail, before = a, base
            for m in self.pattern.finditer(text[a:b]):
                s, e = a + m.start(), a + m.end()
                piece = text[s:e]
                tail, before = s, base
                if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():
                    for k in range(s + 1, e):  # a cut contraction is a mark and letters
                        out[k] = base + self.plain(text[s:k])
                    out[e] = base + self.total_of[piece]
                else:
                    ends = list(accumulate(len(c.encode()) for c in piece))
                    out[s + 1 : e + 1] = base + self.prefixes(piece)[ends]
                base = int(out[e])
            starts = {m: base_at for m, base_at in ((s, out[s]) for s, _ in runs)}
            for s, e in runs:  # a cut leaves the white space before it in one piece
                ends = list(accumulate(len(c.encode()) for c in text[s:e]))
                whole = starts[s] + self.prefixes(text[s:e])[ends]
                out[s + 1 : e + 1] = whole
                if e == b:
                    tail, before = s, int(starts[s])
        return out


def _counter(frame: DataFrame, path: str):
    sent = frame.sparkSession.sparkContext.broadcast(Path(path).read_text())  # of fixed size
    return lambda: PrefixCounter(sent.value)


def _arrow(function, kind: str):
    return F.arrow_udf(function, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def prefix_counts(frame: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `prefix_tokens`: the token counts of the text's prefixes of 0, 1, ... characters.

    The count of text[:k] stands at index k, so any cut or budget is a look-up. Null text counts
    as empty: [0]. Other columns and repeated rows stay; an empty table gives an empty one.
    """
    counter = _counter(frame, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter()
        for texts in batches:
            yield pa.array([own.every(t.as_py() or "") for t in texts], pa.list_(pa.int64()))

    counts = _arrow(run, "array<bigint>")(F.col(text)).alias("prefix_tokens")
    return frame.select(*others(frame, ("prefix_tokens",)), counts)


def fit_to_budget(
    frame: DataFrame, budget: int, text: str = "text", counts: str = "prefix_tokens"
) -> DataFrame:
    """Adds `cut` and `cut_text`: the longest prefix of at most `budget` tokens, from the counts."""
    within = F.transform(F.col(counts), lambda n, k: F.when(n <= budget, k))
    cut = F.array_max(within)
    return frame.select(
        *others(frame, ("cut", "cut_text")),
        cut.alias("cut"),
        F.substr(F.coalesce(F.col(text), F.lit("")), F.lit(1), cut).alias("cut_text"),
    )


def token_counts(
    frame: DataFrame, path: str, limit: int, text: str = "text"
) -> DataFrame:
    """Adds n_bytes, n_tokens (the count at the last prefix) and over_limit (n_tokens > limit).

    Null text counts as empty. The sums run over the last prefix of each piece; the same state is
    behind `prefix_counts`. Other columns and repeated rows stay as they are.
    """
    counter = _counter(frame, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter()
        for texts in batches:
            yield pa.array([own.total(t.as_py() or "") for t in texts], pa.int64())

    names = ("n_bytes", "n_tokens", "over_limit")
    counted = frame.select(
        *others(frame, names),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
        _arrow(run, "bigint")(F.col(text)).alias("n_tokens"),
    )
    return counted.select(*others(counted, ()), (F.col("n_tokens") > limit).alias("over_limit"))
