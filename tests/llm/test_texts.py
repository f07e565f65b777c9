"""Operators on single texts against the libraries and brute force."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import bytepairs, languages, packing, prefixes, quality, urls
from tillscope.llm.queries import BYTES, RANKS, URL_RULES, WORDS

ODD = [
    "", " ", "don't we'll I'd 're 've", "a  b   c\n\n d\t", "日本語 é é 🎉🎉 x", "x" * 700,
    "!!<|endoftext|>?", "a\x00b \x00 c", "c\x85d\x1ce ΑΣ İI", "1234 5.6 ªº× ÿ÷", " " * 60,
]


def test_byte_pairs_are_the_library_s():
    tokens = bytepairs.read_ranks(RANKS)
    codec = bytepairs.ByteCodec(tokens, bytepairs.write_model(tokens), public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={t: i for i, t in enumerate(tokens)},
        special_tokens={},
    )
    for text in ODD:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_prefix_count_is_the_library_s():
    vocabulary = open(BYTES).read()
    counter, library = prefixes.PrefixCounter(vocabulary), Tokenizer.from_str(vocabulary)
    for text in ODD:
        wanted = [
            len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)
        ]
        assert counter.every(text).tolist() == wanted
        assert counter.total(text) == wanted[-1]


def test_a_budget_is_a_look_up(documents):
    counted = prefixes.prefix_counts(documents, BYTES)
    for row in prefixes.fit_to_budget(counted, 5).collect():
        fits = [k for k, n in enumerate(row.prefix_tokens) if n <= 5]
        assert row.cut == max(fits) and row.cut_text == (row.text or "")[: row.cut]


def test_word_ids_are_the_library_s():
    vocabulary = open(WORDS).read()
    library = Tokenizer.from_str(vocabulary)
    wanted = [
        np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(ODD, add_special_tokens=False)
    ]
    assert packing.WordEncoder(vocabulary).encode(ODD) == wanted


def test_word_ids_are_the_library_s_in_texts_of_any_mixture():
    vocabulary = open(WORDS).read()
    library = Tokenizer.from_str(vocabulary)
    signs = [chr(c) for c in range(0x180)] + list("'\u0301\u03a3\u2003日🎉 ") + [" ", "\n", "<|endoftext|>"]
    marks = np.random.default_rng(5).integers(0, len(signs), (300, 40))
    plain = [c for c in signs[0x20:0x100] if packing.WordEncoder.PLAIN.fullmatch(c)] + [" ", "\t", "\n"]
    texts = ["".join(signs[m] for m in row) for row in marks]
    texts += ["".join(plain[m % len(plain)] for m in row) for row in marks]
    for own in ([], [""], ["", ""], texts, texts[300:], [" a\n", "", "\tA b "]):
        found = packing.encoder(vocabulary).encode(own)
        wanted = library.encode_batch(own, add_special_tokens=False)
        assert found == [np.array(e.ids, "<u4").tobytes() for e in wanted]


def test_tasks_of_a_worker_tokenise_a_word_once(monkeypatch):
    vocabulary = open(WORDS).read()
    merged = []
    packing.encoder.cache_clear()
    first = packing.encoder(vocabulary)
    monkeypatch.setattr(first.piece_ids, "make", lambda p: merged.append(p) or first.merge(p))
    ids = first.encode(["Quorvexand quorvexand, QUORVEXAND!", "quorvexand"])
    assert packing.encoder(vocabulary).encode(["quorvexand", "Quorvexand"]) == [ids[1]] * 2
    assert sorted(merged) == ["!", ",", "quorvexand"]


def test_pieces_and_sequences(documents, none):
    cut = packing.pieces(documents, WORDS, 4096, 1)
    rows = packing.best_fit(cut, 4096).collect()
    assert packing.best_fit(packing.pieces(none, WORDS, 4096, 1), 4096).count() == 0
    assert len(rows) == cut.count() and max(r.length for r in rows) == 4096
    assert Counter(r.length for r in rows if r.doc_id in (3, 4)) == {1: 2}
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        ends = [a + b for a, b in own]
        assert [a for a, _ in own] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_packing_is_close_to_the_least_possible():
    lengths = np.random.default_rng(1).lognormal(6.3, 1, 6000).astype(int).clip(1, 4096)
    sequence, _ = packing.pack(lengths, 4096, 1536, 400)
    least = -(-int(lengths.sum()) // 4096)
    assert np.bincount(sequence, lengths).max() <= 4096
    assert sequence.max() + 1 <= 1.01 * least + 1


def test_languages(documents, none):
    model = languages.train(documents.where("doc_id <> 7 OR doc_id IS NULL"))
    rows = languages.predict(documents, model).collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id != 7} == {
        1: "en", 2: "en", 3: "und", 4: "und", 5: "und", 6: "fr", None: "fr",
    }
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 9
    assert languages.predict(none, model).count() == 0
    assert {r.lang_pred for r in languages.predict(documents, languages.train(none)).collect()} == {"und"}


SCRIPTS = {
    "latin": (97, 26), "han": (0x4E00, 2500), "many": (0xC0, 150), "hangul": (0xAC00, 11000),
}


@pytest.mark.parametrize("codes", [0, 1 << 62])
@pytest.mark.parametrize("often", [0, 16, 10**9])
def test_profiles_bind_every_n_gram(monkeypatch, often, codes):
    """Against each n-gram bound singly, for every alphabet, several at once, and empty texts."""
    monkeypatch.setattr(languages, "OFTEN", often)
    monkeypatch.setattr(languages, "FEW_CODES", min(codes, 1 << 22))
    monkeypatch.setattr(languages, "BOUND", 7)
    monkeypatch.setattr(languages, "SINGLE", 11)
    random = np.random.default_rng(3)
    texts = ["", "a", "12", "Ab cd é", "aaaa bbbb aaaa"]
    texts += ["".join(chr(start + i) for i in random.integers(0, n, 90)) for start, n in SCRIPTS.values()]
    texts.append(" ".join(texts))
    profiler = languages.Profiler(64, 3, 5)
    symbols = [profiler.symbols(t) for t in texts]
    for own, found in zip(symbols, profiler.bundled(symbols), strict=True):
        expected = np.zeros(64)
        for i in range(len(own) - 2):
            a, b, c = (profiler.vector(int(x)).astype(int) for x in own[i : i + 3])
            expected += np.roll(a, 2) * np.roll(b, 1) * c
        assert (found == expected).all()


def test_profiles_of_many_letters_stay_small():
    """512 texts of 2,000 letters out of 150 held 3.8 GB in counts of all texts and n-grams."""
    random = np.random.default_rng(4)
    profiler = languages.Profiler(1024, 3, 5)
    texts = list(random.integers(200, 350, (512, 2000)).astype(np.uint32))
    tracemalloc.start()
    profiler.bundled(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_languages_of_clashing_columns(documents):
    """Columns called like the result are replaced, others kept, as are repeated rows."""
    named = documents.selectExpr("*", "'mine' AS lang_pred", "9 AS score", "'kept' AS block")
    rows = languages.predict(named, languages.train(documents)).collect()
    assert len(rows) == 9 and {r.block for r in rows} == {"kept"}
    assert all(r.lang_pred != "mine" and r.score <= 1 for r in rows)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, documents, none):
    rows = quality.judge(documents).collect()
    assert len(rows) == 9 and quality.judge(none, carried=["doc_id"]).count() == 0
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == brute(r.text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # groups too small to judge by


def test_outliers_are_rejected(spark):
    random = np.random.default_rng(3)
    syllables = ["ba", "ne", "tor", "ild", "ma", "ste", "un", "re"]
    rows = []
    for i in range(400):
        words = ["".join(random.choice(syllables, 3)) for _ in range(80)]
        if i < 12:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en", "a"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    rejected = quality.judge(frame, carried=["doc_id"]).where("not kept").collect()
    assert {r.doc_id for r in rejected} == set(range(12))


def test_menus_are_rejected(spark):
    random = np.random.default_rng(4)
    syllables = ["ba", "ne", "tor", "ild", "ma", "ste", "un", "re"]
    rows = []
    for i in range(400):
        words = ["".join(random.choice(syllables, 3)) for _ in range(80)]
        if i < 12:  # a tenth of the characters are symbols
            words = [w + "|" if k % 5 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en", "a"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    rejected = quality.judge(frame, carried=["doc_id"]).where("not kept").collect()
    assert {r.doc_id for r in rejected} == set(range(12))


def test_no_spread_is_added(spark):
    random = np.random.default_rng(6)
    x = random.normal(5000, [300, 20, 200, 400, 10], (2000, 5)).round()
    frame = spark.createDataFrame(
        [("g", *row) for row in x.tolist()], "group string, " + ", ".join(f"x{i} double" for i in range(5))
    )
    row = quality._moments(frame, 5, 1.0).first()
    factor = np.array([[row[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    wanted = np.cov(x.T, bias=True)
    least = (np.array(quality.LEAST_SPREAD) * quality.SCALE) ** 2
    np.fill_diagonal(wanted, np.maximum(wanted.diagonal(), least))
    assert np.allclose(factor @ factor.T, wanted, rtol=1e-6, atol=1e-3)


def test_small_groups_are_judged_by_all_rows(spark):
    random = np.random.default_rng(3)
    syllables = ["ba", "ne", "tor", "ild", "ma", "ste", "un", "re"]
    rows = []
    for i in range(310):
        words = ["".join(random.choice(syllables, 3)) for _ in range(80)]
        if i in (5, 305):
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en" if i < 300 else "fr", "a"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    rejected = quality.judge(frame, carried=["doc_id"]).where("not kept").collect()
    assert {r.doc_id for r in rejected} == {5, 305}
    for least in (150, 300):  # the same row is judged alike in a smaller table
        few = quality.judge(frame.where(f"doc_id >= {least}"), carried=["doc_id"])
        assert [r.doc_id for r in few.where("not kept").collect()] == [305]


def rounded(values):
    """Rounded up to four digits, as quantiles count them."""
    scale = 10.0 ** (np.floor(np.log10(np.maximum(values, 1000.0))) - 3)
    return np.ceil(values / scale) * scale


def quantile(values, share):
    """The least value that `share` of all don't exceed."""
    values = np.sort(rounded(values))
    return values[int(np.ceil(share * len(values))) - 1]


def plain_estimate(x, half, steps):
    """The same estimate of one group without Spark: starts, steps, determinants."""
    p = x.shape[1]
    least = np.array(quality.LEAST_SPREAD) * quality.SCALE
    correction = half / quality._chi_square(quality._chi_square_quantile(half, p), p + 2)

    def moments(rows):
        c = np.cov(rows.T, bias=True) * correction
        np.fill_diagonal(c, np.maximum(c.diagonal(), least**2))
        factor = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                rest = c[i, j] - factor[i, :j] @ factor[j, :j]
                factor[i, j] = np.sqrt(max(rest, (least[i] / 10) ** 2)) if i == j else rest / factor[j, j]
        return rows.mean(0), factor

    def step(d2):
        d2 = d2 * quality.SCALE
        return moments(x[d2 <= quantile(d2, half)])

    def distance(mean, factor):
        return (np.linalg.solve(factor, (x - mean).T) ** 2).sum(0)

    off = np.abs(x - [quantile(c, 0.5) for c in x.T])
    z = off / np.maximum([1.4826 * quantile(c, 0.5) for c in off.T], least)
    found = []
    for start in ((z * z).sum(1), z.max(1), z.sum(1)):
        now = step(start)
        for _ in range(quality.SHORT):
            now = step(distance(*now))
        found.append(now)
    best = min(found, key=lambda f: np.log(f[1].diagonal()).sum())
    for _ in range(steps):
        before, best = best, step(distance(*best))
        if abs(np.log(best[1].diagonal()).sum() - np.log(before[1].diagonal()).sum()) <= 1e-9:
            break
    return distance(*best)


def test_distances_are_those_of_a_plain_estimate(spark):
    """Two groups with clusters of outliers, one of them nearly a third of its group."""
    random = np.random.default_rng(8)
    groups = {}
    for name, size, bad in (("a", 900, 40), ("b", 600, 170)):
        x = np.abs(random.normal(1500, [300, 120, 200, 400, 250], (size, 5)))
        x[:bad] += [2500, 900, 0, 1200, 700]
        groups[name] = x.round()
    rows = [(n, n, False, i, *r) for n, x in groups.items() for i, r in enumerate(x.tolist())]
    schema = "key string, wide string, base_failed boolean, i long, " + ", ".join(f"x{i} double" for i in range(5))
    measured = spark.createDataFrame(rows, schema)
    found = quality.estimates(measured, 0.75, 12, 200)
    frame = quality._with_distance(measured.join(found, "key"), 5).select("key", "i", "d2").collect()
    limit = quality._chi_square_quantile(1 - 1e-3, 5)
    for name, x in groups.items():
        d2 = np.array([r.d2 for r in sorted(frame, key=lambda r: r.i) if r.key == name])
        wanted = plain_estimate(x, 0.75, 12)
        assert np.allclose(d2, wanted, rtol=1e-6)
        assert ((d2 > limit) == (wanted > limit)).all()
    assert (plain_estimate(groups["a"], 0.75, 12)[:40] > limit).all()


def test_url_rules(spark):
    pages = [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    frame = spark.createDataFrame([(p[0], "own") for p in pages], "url string, rule string")
    rows = urls.filter_urls(frame, URL_RULES).collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in rows] == pages


def test_equal_digests_are_told_apart(tmp_path):
    same = lambda data: 7
    (tmp_path / "index").write_bytes(urls.build_index(URL_RULES, same))
    index = urls.Index(str(tmp_path / "index"), same)
    found = index.find([b"net/fr/", b"net/xx/", b"com/"])
    assert [index.text(i) if i >= 0 else None for i in found] == [b"net/fr/", None, b"com/"]


def test_held_out(spark):
    frame = spark.range(50).select("id", languages.held_out(F.col("id")).alias("out"))
    import zlib

    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in frame.collect())


@pytest.mark.parametrize("operator", ["encode", "count"])
def test_clashing_columns_are_replaced(documents, operator):
    if operator == "encode":
        frame = documents.withColumn("ids", F.lit("x"))
        out = bytepairs.decode(
            bytepairs.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN
        )
        assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())
    else:
        frame = documents.withColumn("n_tokens", F.lit("x"))
        assert dict(prefixes.token_counts(frame, BYTES, 512).dtypes)["n_tokens"] == "bigint"
