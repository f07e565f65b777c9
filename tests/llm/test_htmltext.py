"""HTML extraction: markup, alignment of lines, and templates that only a comparison shows."""

import random

import duckdb
import pytest

from tillscope.llm import htmltext, queries

SCHEMA = "page_id bigint, url string, html string"


def wanted(html):
    return [text for text, is_wanted, _ in htmltext.lines_of(html) if is_wanted]


@pytest.mark.parametrize(
    "html, lines",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<br>d\n\t e</p>", ["abc", "d e"]),
        ("<p>1 < 2 &lt; 3 &#233;&nbsp;&euro;<p>x", ["1 < 2 < 3 é €", "x"]),
        ("<nav>Menu</nav><article><h1>T</h1><p>x</article><footer>F", ["T", "x"]),
        ("<header>Site</header><article><header><h1>T</h1></header>x<footer>y</footer></article>", ["T", "x"]),
        ("<nav><ul><li>open<article>x</article>y", ["x"]),
        ("<form><input name=q>Search</form><p>x</p>", ["x"]),
        ('<script>var t="</p><article>no</article>";</script><p>x', ["x"]),
        ("<STYLE>p{}</STYLE><P>x</P><!-- <p>no</p> --><p>y", ["x", "y"]),
        ("<p>x</p><script>never closed <p>no", ["x"]),
        ("<p>x <!-- never closed <p>no", ["x"]),
        ("<p>x</p><a href='cut", ["x"]),
        ("<a title=it's>x</a><p title=\"a > b\">y", ["x", "y"]),
        ('<div class="ad">No<div>no</div></div><p>x</p>', ["x"]),
        ('<div id="cookie-notice"><p>No</p></div><p>x</p>', ["x"]),
        ('<div class="has-sidebar no-comments"><p>x</p></div>', ["x"]),
        ("<article><p>x</p><section id=comments><article>No</article></section></article>", ["x"]),
        ('<article class="comment">No</article><p>x</p>', ["x"]),
        ('<main><p>x</p><div class="mainSidebar">No</div></main><p>outside</p>', ["x"]),
        ('<div role="navigation">No</div><div role=main>x</div>', ["x"]),
        ("<aside><article>teaser</article></aside><article>x</article>", ["x"]),
        ("<p hidden>No</p><p style='display: none'>No</p><p>x", ["x"]),
        ("<ul><li class=ad>No<li>x</ul>", ["x"]),
        ("<p><b>x<article>y</b>z</article>", ["yz"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("</p></div><![CDATA[no]]><?no ?>x", ["x"]),
    ],
)
def test_markup(html, lines):
    assert wanted(html) == lines


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("most_bits", [1 << 28, 64, 1])
def test_alignment_is_a_longest_common_subsequence(most_bits):
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randrange(30))] for _ in "ab")
        pairs = htmltext.aligned(a, b, most_bits)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a, b)


def test_long_pages_of_equal_lines():
    """Twenty thousand repeats of two lines against the same in another order."""
    a, b = [1, 2, 3] * 7000, [2, 1, 3, 3] * 5000
    pairs = htmltext.aligned(a, b, 1 << 22)
    assert all(a[i] == b[j] for i, j in pairs)
    assert len(pairs) == int(htmltext._lengths(a, b)[-1])


def site(host, n, start=0):
    """Pages without telling markup: a menu, a slogan and legal lines around a text of their own."""
    return [
        (
            f"http://{host}/news/{start + i:05d}",
            "<body><div>Start</div><div>Sport</div><div>About us</div>"
            f"<div><p>Story {start + i} begins.</p><p>It goes on with {(start + i) * 7}.</p><p>It ends {start + i}.</p>"
            "</div><div>All rights reserved</div></body>",
            f"Story {start + i} begins. It goes on with {(start + i) * 7}. It ends {start + i}.",
        )
        for i in range(n)
    ]


def extracted(frame):
    return {row.page_id: (row.text, row.n_chars) for row in htmltext.main_text(frame).collect()}


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_shared_lines_go_wherever_partitions_end(spark, partitions):
    rows = site("a.example", 90) + site("b.example", 30, 500) + site("lone.example", 1, 9000)
    rng = random.Random(3)
    numbered = [(i, url, html) for i, (url, html, _) in enumerate(rows)]
    rng.shuffle(numbered)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = extracted(spark.createDataFrame(numbered, SCHEMA))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for i, (url, html, text) in enumerate(rows):
        if "lone" in url:  # nothing to compare it with
            text = f"Start Sport About us {text} All rights reserved"
        assert found[i] == (text, len(text))


def test_copies_and_passages_in_articles_stay(spark, monkeypatch):
    """Exact and near copies on one host are no template; neither is a passage that articles share."""
    long = [f"<p>Line {i} of a long copied story.</p>" for i in range(30)]
    copy = "".join(long)
    near = "".join(long[:-2]) + "<p>Another end.</p>"
    passage = "<article><p>Own {}.</p><p>Licensed to all.</p></article><div>Imprint</div>"
    rows = [(i, f"http://c.example/{i}", copy) for i in range(20)]
    rows += [(20, "http://c.example/190", near)]
    rows += [(30 + i, f"http://d.example/{i}", passage.format(i)) for i in range(3)]
    found = extracted(spark.createDataFrame(rows, SCHEMA))
    whole = " ".join(f"Line {i} of a long copied story." for i in range(30))
    assert {found[i][0] for i in range(20)} == {whole}
    assert found[20][0].endswith("Another end.") and found[20][0].startswith("Line 0")
    assert [found[30 + i][0] for i in range(3)] == [f"Own {i}. Licensed to all." for i in range(3)]


def test_deletions_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, url, html) for i, (url, html, _) in enumerate(site("a.example", 12))]
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = extracted(frame)
    monkeypatch.setattr(htmltext, "MOST_BROADCAST", 0)
    assert extracted(frame) == expected


def test_odd_tables(spark):
    """Nulls, empty and very long pages, ties, repeated rows, clashing columns, no rows."""
    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [
        (1, None, "<p>x</p>"),
        (2, "http://a.example/1", None),
        (3, "http://a.example/1", ""),
        (4, "no host", "<p>x</p>"),
        (4, "no host", "<p>x</p>"),
        (None, "http://a.example/2", long),
        (5, "://", "<p>x</p>"),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    pages = pages.selectExpr("*", "'mine' AS text", "'kept' AS host", "1 AS row", "2 AS content", "3 AS places")
    result = htmltext.main_text(pages)
    assert result.columns == ["page_id", "url", "html", "host", "row", "content", "places", "text", "n_chars"]
    found = {r.page_id: r for r in result.collect()}
    assert result.count() == 7 and {r.host for r in found.values()} == {"kept"}
    assert [found[i].text for i in (1, 2, 3, 4, 5)] == ["x", "", "", "x", "x"]
    assert found[2].html is None and found[None].n_chars == 300_000 * 5 - 1
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    frame = queries.op11_html_extraction(spark, sf_dir)
    expected = duck.sql(queries.OP11_SQL).select(*frame.columns).fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected, key=str)
