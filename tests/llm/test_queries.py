"""Every registered query on whole given tables, against SQL, the libraries or plain Python."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from tillscope.llm import queries, urls

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows(spark, query):
    frame = query(spark, SF_DIR)
    return frame.columns, frame.collect()


def test_op2_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    columns, found = rows(spark, queries.op2_url_filter)
    expected = duck.sql(queries.OP2_SQL).select(*columns).fetchall()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_urls_of_odd_tables(spark):
    """No rows, repeated rows, and a host of three thousand labels."""
    long = "http://" + "a." * 3000 + "net/es/x"
    frame = spark.createDataFrame([(1, long), (1, long), (2, None)], "page_id int, url string")
    found = urls.filter_urls(frame, queries.URL_RULES).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in found if r.rule) == [(1, "net/es/", "block")] * 2
    assert urls.filter_urls(frame.limit(0), queries.URL_RULES).count() == 0


def fingerprint(text):
    """One bit at a time, by the contract."""
    words = text.encode().lower().split()
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1_groups_by_brute_force(spark, texts):
    _, found = rows(spark, queries.op1_simhash_near_dedup)
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    least = {i: i for i in prints}
    moved = True
    while moved:  # the smallest id reachable, link by link
        moved = False
        for i, p in prints.items():
            best = min(least[j] for j, q in prints.items() if (p ^ q).bit_count() <= 3)
            moved |= best < least[i]
            least[i] = min(best, least[i])
    assert {r.doc_id: r.component_id for r in found} == least


def test_op3_links_by_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    column = next(c for c in table.columns if isinstance(table[c].iloc[0], (list, np.ndarray)))
    x = np.array(table[column].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    wanted = dict(zip(table.vec_id.tolist(), near.sum(1).tolist(), strict=True))
    _, found = rows(spark, queries.op3_embedding_near_dedup)
    assert {r.vec_id: r.n_links for r in found} == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_op5_pieces_are_the_library_s(spark, texts):
    library = Tokenizer.from_file(queries.WORDS)
    _, found = rows(spark, queries.op5_best_fit_packing)
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        cut = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        wanted = [(n, 4096 * n, len(c), zlib.crc32(c.tobytes())) for n, c in enumerate(cut)]
        assert sorted(pieces[doc]) == wanted
    ends = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_op6_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    _, found = rows(spark, queries.op6_language_id)
    assert len(found) == len(langs)
    judged = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out and langs[r.doc_id]]
    assert sum(judged) >= 0.95 * len(judged) > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_op7_counts_and_base_rules(spark, texts):
    _, found = rows(spark, queries.op7_quality_rules)
    assert len(found) == len(texts)
    for r in found:
        words = texts[r.doc_id].encode().split()
        windows = list(zip(words, words[1:], words[2:]))
        often = {w for w in windows if windows.count(w) > 1} if len(words) < 400 else None
        assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        if often is not None:
            covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_op8_counts_are_the_library_s(spark, texts):
    library = Tokenizer.from_file(queries.BYTES)
    _, found = rows(spark, queries.op8_token_counts)
    for r in found:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    assert len(found) == len(texts)


def test_op9_lines(spark, texts):
    _, found = rows(spark, queries.op9_line_dedup)
    assert {r.doc_id: r.n_lines for r in found} == {i: t.count("\n") + 1 for i, t in texts.items()}
    assert all(r.text_md5 == hashlib.md5(texts[r.doc_id].encode()).hexdigest() for r in found if not r.n_dropped)


def test_op10_ids_and_round_trip(spark, texts):
    ranks = load_tiktoken_bpe(queries.RANKS)
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, found = rows(spark, queries.op10_byte_bpe)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert len(found) == len(texts)


def test_op13_rows(spark):
    conversations = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id").distinct().count()
    columns, found = rows(spark, queries.op13_conversation_repair)
    assert len(found) == conversations and columns[-2:] == ["audit", "repaired_sha256"]
