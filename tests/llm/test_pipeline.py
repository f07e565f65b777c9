"""Stages of the corpus pipeline against what they promise."""

from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
import xxhash
from tokenizers import Tokenizer

from tillscope.llm.queries import END, SEQUENCE, WORDS

SF_DIR = "/root/testdata/sf0.001"


def test_one_document_of_each_group_stays(spark, documents, none):
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, "")
    assert kept.columns == documents.columns
    # 2 copies 1; 4 is as empty as 3; the document without id has no copy.
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7]
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0


def test_documents_that_share_an_id_but_no_text_stay(spark):
    text = "one two three four five six seven eight nine ten "
    rows = [(1, text), (1, "eins zwei drei vier acht neun zehn elf"), (None, text), (None, "x y"), (None, "x y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, text), rows[1], (0, "x y")])


def test_stages_keep_columns_called_like_their_results(spark, documents, none):
    """Extra columns named as what the operators return, nulls, repeated rows, and no rows."""
    named = documents.selectExpr(
        "*", "'in' AS score", "'in' AS lang_pred", "'in' AS kept", "'in' AS distance", "'in' AS n_lines",
        "'in' AS n_dropped", "'in' AS base_failed", "7L AS n_chars", "'in' AS `row`", "'in' AS doc",
    )
    named = named.unionByName(named)
    extra = ("score", "lang_pred", "kept", "distance", "n_lines", "n_dropped", "base_failed", "row", "doc")
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_lines, corpus_pipeline.identify_language):
        left = stage(spark, named, SF_DIR)
        assert left.columns == named.columns
        rows = left.collect()
        assert rows and all(r[c] == "in" for r in rows for c in extra)
        if stage is corpus_pipeline.drop_lines:
            assert len(rows) == 18 and {r.n_words for r in rows} == {1, 2, 3, 4, 5, 6, None}
        else:
            assert {r.n_chars for r in rows} == {7} and all(r.text for r in rows)
        assert stage(spark, named.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.pack(spark, none, SF_DIR).count() == 0


def fingerprint(text):
    """One bit at a time, by the definition."""
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of_each_group(prints):
    """The smallest id of each group of ids whose fingerprints links connect."""
    left, firsts = dict(prints), set()
    while left:
        start = min(left)
        firsts.add(start)
        reached = [left.pop(start)]
        while reached:
            own = reached.pop()
            near = [i for i, fp in left.items() if (fp ^ own).bit_count() <= 3]
            reached += [left.pop(i) for i in near]
    return firsts


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables not present")
def test_the_last_stages_by_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lines = corpus_pipeline.drop_lines(spark, documents, SF_DIR).checkpoint()
    assert lines.columns == documents.columns and lines.count() == documents.count()
    before = {r.doc_id: (r.text or "").split("\n") for r in documents.collect()}
    after = lines.collect()
    for row in after:  # what stays is what was there, in its order
        rest = iter(before[row.doc_id])
        assert all(line in rest for line in (row.text or "").split("\n")) or row.text == ""
        assert row.n_chars == (None if row.text is None else len(row.text))

    kept = corpus_pipeline.drop_near_duplicates(spark, lines, SF_DIR).checkpoint()
    wanted = first_of_each_group({r.doc_id: fingerprint(r.text) for r in after})
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(wanted)

    found = defaultdict(int)
    ends = defaultdict(int)
    for row in corpus_pipeline.pack(spark, kept, SF_DIR).collect():
        found[row.doc_id] += row.length
        ends[row.sequence_id] += row.length
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text or "" for r in after if r.doc_id in wanted}
    ids = library.encode_batch(list(texts.values()), add_special_tokens=False)
    assert found == {k: len(e.ids) + len([END]) for k, e in zip(texts, ids, strict=True)}
    assert max(ends.values()) <= SEQUENCE


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables not present")
def test_each_stage_works_on_what_its_predecessor_kept(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).checkpoint()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(packed.select(*columns).collect()) == sorted(docs.select(*columns).collect())
