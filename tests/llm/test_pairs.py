"""Operators on pairs and groups of rows against brute force."""

import duckdb
import numpy as np
import pytest

from tillscope.llm import forest, queries, simhash, templates, toolcalls
from tillscope.llm.shared import components


def roots(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 18)] + [(30, 40), (40, 35), (50, 50)]
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    wanted = roots(51, pairs)
    assert {r.node: r.root for r in found} == {n: wanted[n] for p in pairs[:-1] for n in p}


@pytest.mark.parametrize("limit", [4096, 12])
def test_fingerprint_links(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST", limit)
    random = np.random.default_rng(5)
    centres = random.integers(0, 1 << 63, 12, np.uint64)
    flips = [1 << int(b) for b in random.integers(0, 64, 150)]
    prints = {int(c) for c in centres}
    prints |= {int(centres[i % 12]) ^ flips[i] ^ flips[i - 1] for i in range(150)}
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3).tolist()
    wanted = roots(len(values), near)
    found = components(simhash.links(frame, 3)).collect()
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    label = {place[r.node]: place[r.root] for r in found}
    groups = {i: label.get(i, i) for i in range(len(values))}
    assert all((groups[a] == groups[b]) == (wanted[a] == wanted[b]) for a in groups for b in groups)


def test_documents_by_fingerprint(documents, none):
    rows = simhash.near_duplicates(documents).collect()
    assert len(rows) == 9 and simhash.near_duplicates(none).count() == 0
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert found[1][1] == found[2][1] == 1 and found[1][0] == found[2][0]
    assert found[3] == found[4] == ("0" * 16, 3)
    h = simhash.shingle_hashes("A b\tc D", 3)
    assert h == simhash.shingle_hashes("a B c d", 3) and len(h) == 2


def test_forest_finds_what_brute_force_finds(spark):
    random = np.random.default_rng(2)
    base = random.standard_normal((300, 16))
    base = np.concatenate([base, base[:40] + 0.05 * random.standard_normal((40, 16)), base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = forest.near_duplicates(frame, leaf=32).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = {r.vec_id: r.n_links for r in found}
    assert len(found) == len(rows)
    assert all(links[i] <= near[i].sum() for i in range(len(base)))
    assert sum(links[i] for i in range(len(base))) >= 0.9 * near.sum()
    assert all(links[k] == 0 for k in (900, 901, 902, 903, None))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert forest.near_duplicates(frame.limit(0)).count() == 0


def test_large_leaves_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    random = np.random.default_rng(4)
    vectors = np.ones(8) + 0.01 * random.standard_normal((90, 8))
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>"
    )
    found = forest.near_duplicates(frame).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(89, 0)}


def test_recurring_lines_go(spark, documents, none):
    passage = " ".join(f"passage{chr(97 + i % 26)}" for i in range(60))
    rows = [
        (1, f"first own line of text here\n{passage}"),
        (2, f"{passage}\nsecond own line of its text"),
        (3, "Page 3 of 20 in this book\nthird line is alone here"),
        (4, "Page 4 of 20 in this book\nof"),
        (5, "Page 5 of 21 in this book\nof"),
        (6, f"first own line of text here\n{passage}"),
        (7, "A notice that by Anna Lee was posted here today"),
        (8, "A notice that by Boris Lee was posted here today"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in templates.drop_recurring(frame).collect()}
    assert left[1] == rows[0][1] and left[6] == rows[5][1]  # equal texts are one document
    assert left[2] == "second own line of its text"
    assert left[3] == rows[2][1] and left[4] == left[5] == "of"
    assert left[7] == rows[6][1] and left[8] == ""
    kept = templates.drop_recurring(documents).collect()
    assert len(kept) == 9 and all(r.n_dropped == 0 for r in kept)
    assert templates.drop_recurring(none).count() == 0


@pytest.mark.parametrize("leaf", [1, 7, 60, 2000])
def test_drops_are_the_same_at_every_leaf_size(spark, monkeypatch, leaf):
    monkeypatch.setattr(templates, "LEAF", leaf)
    random = np.random.default_rng(5)
    letters = np.array([f"w{chr(97 + i)}" for i in range(20)])

    def edited(base, most):
        line = base.copy()
        places = 3 + random.permutation(len(base) - 3)[: random.integers(0, most + 1)]
        line[places] = random.choice(letters, len(places))
        return line

    lines = [f"same three words then name{a}{b} differs in all lines".split() for a in "abcdefg" for b in "hijklmno"]
    for size in (10, 15):
        for _ in range(6):
            base = np.r_[["same", "three", "words"], random.choice(letters, size - 3)]
            lines += [edited(base, 4).tolist() for _ in range(15)]
    lines = sorted({tuple(line) for line in lines})
    pairs = [
        (i, j)
        for i, a in enumerate(lines)
        for j, b in enumerate(lines[:i])
        if len(a) == len(b) and 5 * sum(x != y for x, y in zip(a, b, strict=True)) <= len(a)
    ]
    frame = spark.createDataFrame(
        [(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id bigint, text string"
    )
    kept = {r.doc_id for r in templates.drop_recurring(frame).collect() if not r.n_dropped}
    assert kept == set(roots(len(lines), pairs)) and len(kept) < len(lines) - 54


def test_short_lines_go(spark):
    rows = [
        (1, "Les.\nAnd ornd.\n\n我们去了4个地方\nPage 1\n7\nonce"),
        (2, "Les.\nAnd ornd.\n\n我们去了4个地方\nPage 2\n8\ntwice only"),
        (3, "Les.\nAnd ornd.\n\n我们去了4个地方\nPage 3\n9\ntwice only"),
        (4, "Les.\nAnd other.\n\n他们有5本书"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in templates.drop_recurring(frame).collect()}
    assert left == {
        1: rows[0][1], 2: "\n8\ntwice only", 3: "\n9\ntwice only", 4: "And other.\n\n他们有5本书",
    }


def test_calls_and_results(spark):
    calls = spark.createDataFrame(
        [
            ("a", None, "f", '{"y": 1, "x": "s"}'),
            ("b", "a", "f", '{"x": 2}'),
            ("c", "b", "g", "{"),
            ("d", "e", "f", '{"x":"t","y":2,"z":0}'),
            ("e", "d", "f", '{"x":"","y":2}'),
            (None, None, "f", None),
            ("a", None, "f", '{"y": 1, "x": "s"}'),
            ("h", "a", "f", '{"x":"t","y":2}'),
            ("h", "b", "f", '{"x":"t","y":2}'),
        ],
        "call_id string, parent_id string, name string, arguments string",
    )
    results = [("a", "r2"), ("a", "r1"), ("a", None), ("a", "r2"), ("q", "o"), ("q", "p"), (None, "n")]
    results = spark.createDataFrame(results, "call_id string, content string")
    schemas = {"f": {"x": {"type": "string", "least": 1}, "y": {"type": "integer"}}}
    rows = toolcalls.link(calls, results, schemas).collect()
    further = {(r.call_id, r.json): r for r in rows if r.n_results and ('r2"' in r.json or 'p"' in r.json)}
    found = {r.call_id: r for r in rows if r.call_id and (r.call_id, r.json) not in further}
    assert len(rows) == 13
    assert sorted((r.call_id, r.state, r.n_results, r.depth, r.errors[0], r.json) for r in further.values()) == [
        ("a", "further_result", 2, 0, "further result", '{"arguments":null,"id":"a","name":null,"result":"r2"}'),
        ("q", "no_call", 1, None, "no call", '{"arguments":null,"id":"q","name":null,"result":"p"}'),
    ]
    assert found["h"].errors == ["several parents"] and found["h"].depth == 1
    assert found["a"].json == '{"arguments":{"x":"s","y":1},"id":"a","name":"f","result":"r1"}'
    assert (found["a"].n_results, found["a"].depth, found["a"].valid) == (4, 0, True)
    assert found["b"].errors == ["x is no string", "missing y"] and found["b"].depth == 1
    assert found["c"].errors == ["unknown tool", "not JSON"] and found["c"].depth == 2
    assert found["d"].errors == ["unexpected z"] and found["d"].depth is None  # on a cycle
    assert found["e"].errors == ["x is too small"] and found["e"].state == "no_result"
    assert found["q"].state == "no_call" and not found["q"].valid


def test_calls_against_sql_and_empty_sides(spark):
    """The query on the given conversations with repeated, long, empty and null texts added."""
    sf_dir = "/root/testdata/sf0.001"
    odd = [(1, 1, "assistant", "other"), (1, 1, "assistant", "other"), (2, 0, "assistant", "of nothing"),
           (2, 0, "assistant", "of nothing, too"), (9001, 0, "user", ""), (5, 1, "assistant", "long " * 50_000)]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.unionByName(spark.createDataFrame(odd, turns.schema)).toPandas()
    folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/odd_calls"
    spark.createDataFrame(turns).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    frame = queries.op4_tool_call_linking(spark, folder)
    duck = duckdb.connect()
    duck.register("conversations", turns)
    expected = duck.sql(queries.OP4_SQL).select(*frame.columns).fetchall()
    found = list(map(tuple, frame.collect()))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(row[1] == "further_result" for row in found) >= 1
    calls, results = toolcalls.calls_of(spark.createDataFrame(turns), "f")
    nothing = toolcalls.link(calls.limit(0), results.limit(0), {})
    assert nothing.count() == 0
    assert {r.state for r in toolcalls.link(calls, results.limit(0), {}).collect()} == {"no_result"}
    assert {r.state for r in toolcalls.link(calls.limit(0), results, {}).collect()} == {"no_call"}
