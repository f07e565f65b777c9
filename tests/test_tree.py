"""The category tree on random forests against a recursive walk."""

import random

import pytest
from hand_model import build_model

from tillscope.operators.hierarchy import c2_category_tree


def walk(rows):
    children = {}
    for row in rows:
        children.setdefault(row[2], []).append(row)
    listing = []

    def visit(row, depth, path):
        path = f"{path} > {row[1]}" if path else row[1]
        listing.append((row[0], "    " * depth + row[1], depth, path, row[3]))
        for child in sorted(children.get(row[0], [])):
            visit(child, depth + 1, path)

    for root in sorted(children.get(None, []), key=lambda row: row[0]):
        visit(root, 0, "")
    return listing


@pytest.mark.parametrize("seed", range(3))
def test_random_forest(spark, seed):
    pick = random.Random(seed)
    ids = pick.sample(range(1, 500), 80)
    rows = []
    for place, key in enumerate(ids):
        parent = None if place < 4 else pick.choice([*ids[:place], 9999])
        rows.append((key, f"c{key}", parent, pick.random() < 0.9))
    tree = c2_category_tree(build_model(spark, categories=rows))
    assert [tuple(row) for row in tree.collect()] == walk(rows)


def test_a_chain_of_500_levels(spark):
    rows = [(n, f"c{n}", n - 1 if n > 1 else None, True) for n in range(1, 501)]
    tree = c2_category_tree(build_model(spark, categories=rows)).select("category_id", "depth")
    assert [tuple(row) for row in tree.collect()] == [(n, n - 1) for n in range(1, 501)]


def test_cycles_end_and_are_not_listed(spark):
    rows = [(1, "root", None, True), (2, "leaf", 1, True), (3, "a", 4, True), (4, "b", 3, True)]
    rows += [(5, "own parent", 5, True), (6, "below a cycle", 4, True)]
    tree = c2_category_tree(build_model(spark, categories=rows))
    assert [row.category_id for row in tree.collect()] == [1, 2]
