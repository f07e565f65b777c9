"""URL filters: a sorted array of digests in a memory-mapped file, probed by binary search."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import others, shared_folder

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.substr(url, F.locate("://", url) + F.lit(3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.locate("://", url) > 0, host).otherwise("")


def path_of(url):
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.substr(url, F.locate("://", url) + F.lit(3))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.locate("://", url) > 0, path).otherwise("")


def build_index(rules: Iterable[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
    """The rules (host, path, verdict) as one file: digests in order, then the full strings.

    Of rules with the same host and path but different verdicts, `block` wins. Rules without a
    host are refused.
    """
    verdicts: dict[str, str] = {}
    hosts: dict[str, int] = {}
    for host, path, verdict in rules:
        if not host or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {(host, path, verdict)}")
        text = host.translate(str.maketrans(UPPER, LOWER)) + path
        hosts[text] = len(host)
        verdicts[text] = BLOCK if BLOCK in (verdict, verdicts.get(text)) else ALLOW
    order = sorted(verdicts, key=lambda text: (digest(text.encode()), text))
    keys = np.array([digest(text.encode()) for text in order], np.uint64)
    blobs = [text.encode() for text in order]
    starts = np.cumsum([0, *map(len, blobs)]).astype(np.int64)
    runs = np.unique(keys, return_counts=True)[1]
    lengths = sorted({len(text) - hosts[text] for text in order})
    head = [len(order), int(runs.max()) if len(order) else 0, len(lengths), *lengths]
    return (
        np.array(head, np.int64).tobytes()
        + keys.tobytes()
        + starts.tobytes()
        + np.array([hosts[text] for text in order], np.int64).tobytes()
        + np.array([verdicts[text] == BLOCK for text in order], np.uint8).tobytes()
        + b"".join(blobs)
    )


class Index:
    """Views into the memory-mapped file; pages are read when a search touches them."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        self.digest = digest
        data = np.memmap(path, np.uint8, "r")
        at = 0

        def part(dtype, count):
            nonlocal at
            view = data[at : at + count * np.dtype(dtype).itemsize].view(dtype)
            at += view.nbytes
            return view

        self.size, self.run, n_lengths = (int(x) for x in part(np.int64, 3))
        self.lengths = part(np.int64, n_lengths).tolist()
        self.keys = part(np.uint64, self.size)
        self.starts = part(np.int64, self.size + 1)
        self.hosts = part(np.int64, self.size)
        self.blocks = part(np.uint8, self.size)
        self.blob = data[at:]

    def text(self, i: int) -> bytes:
        return self.blob[self.starts[i] : self.starts[i + 1]].tobytes()

    def find(self, texts: list[bytes]) -> np.ndarray:
        """For each text the rule that is equal to it, else -1."""
        found = np.full(len(texts), -1)
        wanted = np.fromiter(map(self.digest, texts), np.uint64, len(texts))
        first = np.searchsorted(self.keys, wanted)
        for step in range(self.run):  # rules of equal digests lie side by side
            at = first + step
            same = np.flatnonzero(at < self.size)
            same = same[self.keys[at[same]] == wanted[same]]
            for i in same.tolist():
                if self.text(at[i]) == texts[i]:
                    found[i] = at[i]
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[int]:
        """The longest rule that fits each url, by host and path together, then by host; else -1."""
        texts: list[bytes] = []
        owners: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if host:
                parts = host.split(".")
                for suffix in (".".join(parts[k:]) for k in range(len(parts))):
                    fits = [suffix + path[:n] for n in self.lengths if n <= len(path)] if suffix else []
                    texts += [x.encode() for x in fits]
                    owners += [i] * len(fits)
        best = [-1] * len(hosts)
        rank = [(-1, -1)] * len(hosts)
        rules = self.find(texts)
        for c in np.flatnonzero(rules >= 0).tolist():
            rule, owner = int(rules[c]), owners[c]
            own = (len(texts[c].decode()), int(self.hosts[rule]))
            if own > rank[owner]:
                best[owner], rank[owner] = rule, own
        return best


def share_index(spark: SparkSession, index: bytes) -> str:
    """Puts the index into the shared folder, from where Spark hands it to each executor once."""
    name = f"url-rules-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(index))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def filter_urls(
    urls: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    url: str = "url",
    otherwise: str = ALLOW,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of `urls`.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with
    the rule's path; the longest rule wins. `rule` is null and the verdict `otherwise` where none
    fits. A null url, or one without `://`, has an empty host and path and fits no rule. Columns
    of these four names are replaced; other columns, their nulls and repeated rows stay as they
    are; an empty table gives an empty one. The rules are a list of the driver's; their index is
    one file on each executor, of which a search reads the pages it touches.
    """
    name = share_index(urls.sparkSession, build_index(rules))

    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = Index(SparkFiles.get(name))
        for hosts, paths in batches:
            rules = index.judge(hosts.to_pylist(), paths.to_pylist())
            yield pa.StructArray.from_arrays(
                [
                    pa.array([index.text(r).decode() if r >= 0 else None for r in rules], pa.string()),
                    pa.array(
                        [(BLOCK if index.blocks[r] else ALLOW) if r >= 0 else otherwise for r in rules],
                        pa.string(),
                    ),
                ],
                ["rule", "verdict"],
            )

    judge = F.arrow_udf(judged, "rule string, verdict string", F.ArrowUDFType.SCALAR_ITER)
    kept = others(urls, ("host", "path", "rule", "verdict"))
    host = F.coalesce(host_of(F.col(url)), F.lit(""))
    path = F.coalesce(path_of(F.col(url)), F.lit(""))
    with_parts = urls.select(*kept, host.alias("host"), path.alias("path"))
    verdicts = with_parts.withColumn("rule", judge.asNondeterministic()("host", "path"))
    return verdicts.select(
        *others(verdicts, ("rule",)),
        F.col("rule.rule").alias("rule"),
        F.col("rule.verdict").alias("verdict"),
    )
