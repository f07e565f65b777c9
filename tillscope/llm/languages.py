"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import others

UNDETERMINED = "und"
#: Characters whose n-grams are counted at once.
BLOCK = 1 << 20
#: An n-gram that occurs more often in a block is bound once for all its occurrences.
OFTEN = 16
#: Up to so many possible n-grams of a block are numbered by a table of all of them.
FEW_CODES = 1 << 22
#: N-grams bound at once: those that are bound once, and occurrences of the others.
BOUND, SINGLE = 4096, 16384


class Profiler:
    """Texts to hypervectors.

    Every letter (lower-cased) has a random vector of +1 and -1, drawn from its code point and the
    seed; a run of other characters is one gap with a vector of its own. An n-gram is bound by
    multiplying the vectors of its letters, the i-th of them permuted (rotated) by its distance
    from the n-gram's end. A text's vector is the sum over its n-grams, each as often as it occurs.
    """

    def __init__(self, dimensions: int, n: int, seed: int):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.vectors: dict[int, np.ndarray] = {}
        self.letters = np.zeros(0x110000, np.uint32)  # of each code point its lower case, else 0
        self.seen = np.zeros(0x110000, bool)

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.vectors:
            random = np.random.default_rng((self.seed, letter))
            self.vectors[letter] = random.integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.vectors[letter]

    def lowered(self, points: np.ndarray) -> np.ndarray:
        new = points[~self.seen[points]]
        for p in np.unique(new).tolist():
            c = chr(p)
            if unicodedata.category(c)[0] == "L":
                self.letters[p] = ord(c.lower()[0])
            self.seen[p] = True
        return self.letters[points]

    def symbols(self, text: str) -> np.ndarray:
        """The letters of the text with one 0 before, after and between words; empty without any."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.lowered(points)
        if not letters.any():
            return letters[:0]
        letters = np.concatenate([[0], letters, [0]]).astype(np.uint32)
        return letters[(letters != 0) | np.concatenate([[True], letters[:-1] != 0])]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, a row each, from rows of n letters."""
        own, where = np.unique(grams, return_inverse=True)
        where = where.reshape(grams.shape)
        table = np.array([self.vector(x) for x in own.tolist()])
        out = np.roll(table, self.n - 1, 1)[where[:, 0]]
        for i in range(1, self.n):
            out *= np.roll(table, self.n - 1 - i, 1)[where[:, i]]
        return out

    def bundled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The vectors of texts given as symbols; rows of zeros without an n-gram.

        Whatever the alphabet: an n-gram that occurs often in these texts is bound once and added by
        its counts, the occurrences of others are bound and added singly. Both in pieces of bounded
        size, so memory grows with the letters of a block and not with texts times n-grams.
        """
        out = np.zeros((len(texts), self.dimensions))
        lengths = np.array([len(t) for t in texts])
        if not (lengths >= self.n).any():
            return out
        letters, coded = np.unique(np.concatenate(texts), return_inverse=True)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(coded))
        at = at[at + self.n <= ends[owner]]  # not across two texts
        owner = owner[at]
        single = np.ones(len(at), bool)
        if len(letters) ** self.n < 1 << 62:
            code = np.zeros(len(at), np.int64)
            for i in range(self.n):
                code = code * len(letters) + coded[at + i]
            if len(letters) ** self.n <= FEW_CODES:  # the same numbers without a sort
                count = np.bincount(code)
                codes = np.flatnonzero(count)
                number = np.zeros(len(count), np.int64)
                number[codes] = np.arange(len(codes))
                gram, total = number[code], count[codes]
            else:
                codes, gram, total = np.unique(code, return_inverse=True, return_counts=True)
            often = np.flatnonzero(total > OFTEN)
            place = np.full(len(total), -1)
            place[often] = np.arange(len(often))
            place = place[gram]
            single = place < 0
            powers = len(letters) ** np.arange(self.n - 1, -1, -1)
            for i in range(0, len(often), BOUND):
                own = np.flatnonzero((place >= i) & (place < i + BOUND))
                size = min(BOUND, len(often) - i)
                cells = owner[own] * size + place[own] - i
                counts = np.bincount(cells, minlength=len(texts) * size).reshape(-1, size)
                digits = codes[often[i : i + size], None] // powers % len(letters)
                out += counts.astype(np.float32) @ self.bound(letters[digits]).astype(np.float32)
        at, owner = at[single], owner[single]
        for i in range(0, len(at), SINGLE):
            where, own = at[i : i + SINGLE], owner[i : i + SINGLE]
            vectors = self.bound(letters[coded[where[:, None] + np.arange(self.n)]])
            first = np.flatnonzero(np.diff(own, prepend=-1))
            run = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
            starts = np.flatnonzero(run % 127 == 0)  # sums of so many stay within a byte
            for start, end in zip(starts, [*starts[1:], len(own)], strict=True):
                out[own[start]] += vectors[start:end].sum(0, dtype=np.int8)
        return out

    def blocks(self, texts: Iterator[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Symbols and vectors of some texts at a time, whole texts always."""
        block, size = [], 0
        for text in texts:
            block.append(self.symbols(text))
            size += len(block[-1])
            if size >= BLOCK or len(block) >= 512:
                yield block, self.bundled(block)
                block, size = [], 0
        if block:
            yield block, self.bundled(block)


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    dimensions: int = 1024,
    n: int = 3,
    seed: int = 7,
) -> dict:
    """Prototypes: of each label the sum of its texts' vectors, over all rows of `labelled`.

    Rows with a null label or text are left out. Each task sums its own rows and the sums are added
    by Spark; whole numbers, so the order doesn't matter. What comes to the driver is one vector
    for each label. Without any labelled row every text is `und`.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dimensions, n, seed)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            at = 0
            for block, vectors in profiler.blocks(t.as_py() for t in batch.column(0)):
                own = np.array(labels[at : at + len(block)])
                for value in np.unique(own).tolist():
                    total = totals.setdefault(value, np.zeros(dimensions))
                    total += vectors[own == value].sum(0)
                at += len(block)
        for value, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([value] * dimensions, pa.string()),
                    pa.array(range(dimensions), pa.int32()),
                    pa.array(np.rint(total).astype(np.int64)),
                ],
                ["label", "dimension", "value"],
            )

    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    summed = (
        rows.where("text is not null and label is not null")
        .mapInArrow(sums, "label string, dimension int, value bigint")
        .groupBy("label", "dimension")
        .agg(F.sum("value").alias("value"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("dimension", "value"))).alias("sums"))
        .select("label", F.transform("sums", lambda x: x["value"]).alias("sums"))
    )
    prototypes = {row["label"]: np.array(row["sums"], float) for row in summed.collect()}
    found = {k: v / np.linalg.norm(v) for k, v in sorted(prototypes.items()) if v.any()}
    return {"prototypes": found, "dimensions": dimensions, "n": n, "seed": seed}


def predict(frame: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred and score: the prototype nearest by cosine, and that cosine (0 if negative).

    `und` with score 0 where the text is null or has no letter, or the model has no prototype; of
    equal cosines the first label in order. Only the text is looked at. Other columns and repeated
    rows stay; columns of the two names are replaced; an empty table gives an empty one.
    """
    labels = list(model["prototypes"])
    matrix = np.array([model["prototypes"][k] for k in labels]).reshape(len(labels), model["dimensions"])
    settings = model["dimensions"], model["n"], model["seed"]

    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiler = Profiler(*settings)
        for texts in batches:
            names: list[str] = []
            scores: list[float] = []
            for block, vectors in profiler.blocks(t.as_py() or "" for t in texts):
                norms = np.linalg.norm(vectors, axis=1)
                for i, symbols in enumerate(block):
                    if not len(symbols) or not labels or not norms[i]:
                        names.append(UNDETERMINED if not len(symbols) or not labels else labels[0])
                        scores.append(0.0)
                        continue
                    cosines = matrix @ vectors[i] / norms[i]
                    best = int(cosines.argmax())
                    names.append(labels[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    kind = "lang_pred string, score double"
    judge = F.arrow_udf(nearest, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    names = ("lang_pred", "score")
    judged = frame.select(*others(frame, names), judge(F.col(text)).alias(names[0]))
    return judged.select(*others(judged, names), *[F.col(f"lang_pred.{n}").alias(n) for n in names])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast(T.StringType()).cast("binary")) % 4 == 2, F.lit(False))
