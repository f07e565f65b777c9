"""Conversation repair against every possible edit, and on odd tables."""

import hashlib
import itertools
import random
import re

import pytest

from tillscope.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def faults_of(rows):
    seen, faults = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def by_trying_all(rows, most=1):
    """(cost, audit, repaired) of the best of all edits, with `most` insertions at every gap."""
    faults = faults_of(rows)
    inserts = [()] + [
        tuple(("I", 5, role, "") for role in roles)
        for n in range(1, most + 1)
        for roles in itertools.product(("user", "assistant"), repeat=n)
    ]
    choices = [inserts]
    for (role, text), fault in zip(rows, faults, strict=True):
        ways = [(("D", 2, None, None),)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            ways.append((("K", more, role, text),))
            ways += [(("R", 1 + more, new, text),) for new in ("user", "assistant")]
        choices += [ways, inserts]
    best = None
    for picked in itertools.product(*choices):
        edits = [e for part in picked for e in part]
        left = [(r, t) for letter, _, r, t in edits if letter != "D"]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left)):
            key = (sum(e[1] for e in edits), "".join(e[0] for e in edits))
            if best is None or key < best[0]:
                best = (key, "\n".join(f"{r}:{t}" for r, t in left))
    return (*best[0], best[1])


def by_search(rows):
    search, edits, tables = repair.Repair(), [], {}
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        initial = role[:1]
        ways = tables.setdefault((initial, fault), repair.steps(initial, fault))
        edits += search.add(ways, (fault, role, text))
    edits += search.end()
    cost, lines = 0, []
    for edit in edits:
        fault, role, text = edit.turn or ("", None, "")
        cost += repair.COST[edit.letter]
        if edit.letter != "D":
            cost += repair.TRUNCATED_COST if fault == "truncated" else 0
            lines.append(f"{edit.role or role}:{text}")
    return cost, "".join(e.letter for e in edits), "\n".join(lines)


ROLES = ("system", "user", "assistant", "tool", "")
TEXTS = ("", "Whole.", "Other!", "cut", "More? ")


@pytest.mark.parametrize("size, cases", [(0, 1), (1, 25), (2, 60), (3, 60)])
def test_search_equals_trying_all(size, cases):
    rng = random.Random(size)
    for _ in range(cases):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(size)]
        assert by_search(rows) == by_trying_all(rows, 2 if size < 3 else 1), rows


def by_whole_strings(rows):
    """The same minimum over complete audits, without a tree or pruning."""
    paths = {repair.EMPTY: (0, "")}

    def inserted(paths):
        found = dict(paths)
        for _ in range(2):
            for state, (cost, audit) in list(found.items()):
                to, way = repair.NEXT[state], (cost + 5, audit + "I")
                if to not in found or way < found[to]:
                    found[to] = way
        return found

    # Insertions may follow every path, not only the best one into a state.
    for (role, _), fault in zip(rows, faults_of(rows), strict=True):
        new = {}

        def offer(state, way, new=new):
            if state not in new or way < new[state]:
                new[state] = way

        for state, (cost, audit) in paths.items():
            at, paid, letters = state, cost, audit
            for _ in range(3):
                offer(at, (paid + 2, letters + "D"))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    to = repair.after(at, role[:1])
                    if to is not None:
                        offer(to, (paid + more, letters + "K"))
                    offer(repair.NEXT[at], (paid + more + 1, letters + "R"))
                at, paid, letters = repair.NEXT[at], paid + 5, letters + "I"
        paths = new
    return min(inserted(paths)[s] for s in repair.ENDS if s in inserted(paths))


def test_long_conversations_and_ties():
    rng = random.Random(7)
    for size in (20, 60, 200):
        for roles in (ROLES[:3], ("user",), ("assistant",), ("user", "assistant"), ROLES):
            rows = [(rng.choice(roles), rng.choice(TEXTS) + rng.choice(("", " a.", " b"))) for _ in range(size)]
            assert by_search(rows)[:2] == by_whole_strings(rows)


def test_alternating_turns_are_emitted_at_once():
    search = repair.Repair()
    out = []
    for n in range(5000):
        role = "ua"[n % 2]
        out += search.add(repair.steps(role, ""), n)
        assert n - len(out) < 10
    assert len(out + search.end()) == 5000


def rows_of(frame):
    return {row.conv_id: row for row in repair.audits(frame).collect()}


def test_odd_tables(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, an empty table."""
    long = "word " * 200_000 + "end."
    rows = [
        (1, 0, "user", "Hi."),
        (1, 1, "assistant", long),
        (2, None, None, None),
        (2, None, "user", "Hi."),
        (3, 5, "user", "Hi."),
        (3, 5, "user", "Hi."),
        (3, 9, "assistant", "Yes."),
        (None, 1, "user", "Hi."),
        (None, 2, "assistant", "Yes."),
        (4, None, "user", "a."),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS edit", "2 AS conv")
    found = rows_of(repair.repair(turns))
    assert set(found) == {1, 2, 3, 4, None}
    assert found[1].audit == "KK"
    assert found[1].repaired_sha256 == hashlib.sha256(f"user:Hi.\nassistant:{long}".encode()).hexdigest()
    assert (found[2].audit, found[2].blank, found[2].gaps, found[2].illegal) == ("DD", 1, 0, 1)
    assert (found[3].audit, found[3].duplicate, found[3].gaps, found[3].cost) == ("KDK", 1, 3, 2)
    assert found[4].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[None].audit == "KK"
    assert repair.audits(repair.repair(turns.limit(0))).count() == 0
    absent = rows_of(repair.repair(turns, present=turns["conv_id"] == 1))
    assert (absent[3].audit, absent[3].cost, absent[3].gaps) == ("", 0, 0)


def test_damaged_conversations(spark):
    """The query's rows over a whole table, by plain Python."""
    import zlib

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    odd = [(1_000_000, None, None, None), (1_000_001, 0, "", "x"), (1_000_001, 0, "", "x")]
    turns = turns.unionByName(spark.createDataFrame(odd, SCHEMA))
    found = rows_of(repair.repair(repair.damage(turns), present=repair.F.col("present")))
    conversations = {}
    for row in turns.collect():
        conv, turn, role, text = (" " if v is None else v for v in row)
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        kept = conversations.setdefault(row.conv_id, [])
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            role = "user" if kind == 4 else role
            kept += [(row.turn, role, text)] * (2 if kind == 3 else 1)
    assert found.keys() == conversations.keys()
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        rows = [r[1:] for r in kept]
        numbers = {r[0] for r in kept} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        faults = faults_of(rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
        cost, audit, repaired = by_search(rows)
        if len(rows) < 4:
            assert (cost, audit, repaired) == by_trying_all(rows, 1)
        assert found[conv][1:] == (
            gaps,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256(repaired.encode()).hexdigest(),
        )
