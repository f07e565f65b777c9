"""Conversation structure repair: cheapest edits by a Viterbi search whose survivors coalesce."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import SPACES

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
#: Added for a truncated turn that is not deleted.
TRUNCATED_COST = 5
NONE, BLANK, DUPLICATE, TRUNCATED = "", "blank", "duplicate", "truncated"

# What may come next: the role initials of a repaired conversation are `(s?(ua)+)?`.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
ENDS = (EMPTY, ASSISTANT)
#: The only turn that an insertion or a new role can put after a state.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: More than two insertions in a row lead back to a state that fewer reach.
MOST_INSERTED = 2
LEGAL_PAIRS = ("su", "ua", "au")

EDITS = pa.schema(
    [
        ("conv", pa.int64()),
        ("place", pa.int64()),
        ("turn", pa.int64()),
        ("edit", pa.string()),
        ("fault", pa.string()),
        ("illegal", pa.bool_()),
        ("cost", pa.int64()),
        ("role", pa.string()),
        ("text", pa.string()),
    ]
)
AUDITS = pa.schema(
    [
        ("conv_id", pa.int64()),
        *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
    ]
)


def after(state: int, initial: str) -> int | None:
    """The state after a kept turn; None where such a turn may not follow."""
    if initial == "":
        return state
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial in "ua" and NEXT[state] == (USER if initial == "u" else ASSISTANT):
        return NEXT[state]
    return None


def steps(initial: str, fault: str) -> list[list[tuple]]:
    """For every state the ways into it over one turn: (from, cost, letters, new roles).

    Of the ways between the same two states only the cheapest, and of those the first in ASCII,
    can be part of the answer.
    """
    best: dict[tuple[int, int], tuple] = {}

    def offer(source, target, cost, letters, roles):
        way = (cost, letters, roles)
        if (source, target) not in best or way[:2] < best[source, target][:2]:
            best[source, target] = way

    kept = TRUNCATED_COST if fault == TRUNCATED else 0
    for source in STATES:
        at, roles = source, ()
        for n in range(MOST_INSERTED + 1):
            inserted, paid = INSERT * n, COST[INSERT] * n
            offer(source, at, paid + COST[DELETE], inserted + DELETE, (*roles, None))
            if fault not in (BLANK, DUPLICATE):
                to = after(at, initial)
                if to is not None:
                    offer(source, to, paid + kept, inserted + KEEP, (*roles, None))
                to = NEXT[at]
                cost = paid + kept + COST[REROLE]
                offer(source, to, cost, inserted + REROLE, (*roles, NAMES[to]))
            at = NEXT[at]
            roles = (*roles, NAMES[at])
    ways: list[list[tuple]] = [[] for _ in STATES]
    for (source, target), way in best.items():
        ways[target].append((source, *way))
    return ways


def _advantages() -> list[list[int]]:
    """[q][p]: by how much the rest of a repair from q can cost more than from p, at most.

    q can become p by insertions. A state after an assistant's turn can do all that the empty
    start can, but for a system turn, which it deletes; and all that one after a system turn can.
    """
    far = 1 << 30
    more = [[0 if q == p else far for p in STATES] for q in STATES]
    for q in STATES:
        more[q][NEXT[q]] = COST[INSERT]
    more[ASSISTANT][EMPTY] = COST[DELETE]
    more[ASSISTANT][SYSTEM] = 0
    for via in STATES:
        for q in STATES:
            for p in STATES:
                more[q][p] = min(more[q][p], more[q][via] + more[via][p])
    return more


MORE = _advantages()


class Node:
    """An edit in the backpointer tree; it lives while an edit after it or a survivor refers to it."""

    __slots__ = ("before", "letter", "role", "turn", "after", "held")

    def __init__(self, before, letter, role, turn):
        self.before, self.letter, self.role, self.turn = before, letter, role, turn
        self.after: list[Node] = []
        self.held = 0  # survivors that end here
        if before is not None:
            before.after.append(self)


class Repair:
    """The cheapest edits of one conversation, the first in ASCII among those of equal cost.

    `add` takes the turns in order and gives the edits that are certain by then: those all
    survivors share. Memory holds the turns since the survivors' last common ancestor, nothing
    else. Survivors are kept in the order of their complete letters since that ancestor. All have
    an equal number of turns behind them and end with a turn's letter, so none is the beginning
    of another, and this order decides ties without reading them again. A state that another can
    make up for at less cost is dropped, so that it doesn't hold the ancestor back.
    """

    def __init__(self):
        self.root = Node(None, "", None, None)
        self.root.held = 1
        # per state: (cost, rank among the survivors, node)
        self.survivors: dict[int, tuple[int, int, Node]] = {EMPTY: (0, 0, self.root)}

    def _release(self, node: Node) -> None:
        node.held -= 1
        while not node.held and not node.after and node is not self.root:
            before = node.before
            before.after.remove(node)
            node = before

    def _certain(self) -> Iterator[Node]:
        root = self.root
        while not root.held and len(root.after) == 1:
            root = root.after[0]
            root.before = None
            yield root
        self.root = root

    def _move(self, chosen: list[tuple]) -> None:
        """chosen: (cost, rank, letters, state, node before, roles, turn) of every new survivor."""
        made = {}
        ranked = sorted(chosen, key=lambda c: c[1:3])
        for rank, (cost, _, letters, state, node, roles, turn) in enumerate(ranked):
            for i, letter in enumerate(letters):
                node = Node(node, letter, roles[i], turn if letter != INSERT else None)
            node.held += 1
            made[state] = (cost, rank, node)
        old, self.survivors = self.survivors, made
        for _, _, node in old.values():
            self._release(node)

    def add(self, ways: list[list[tuple]], turn) -> list[Node]:
        chosen = []
        for state in STATES:
            best = None
            for source, more, letters, roles in ways[state]:
                survivor = self.survivors.get(source)
                if survivor is not None:
                    key = (survivor[0] + more, survivor[1], letters)
                    if best is None or key < best[:3]:
                        best = (*key, state, survivor[2], roles, turn)
            if best is not None:
                chosen.append(best)
        chosen = [
            p for p in chosen if all(p[0] <= q[0] + MORE[q[3]][p[3]] for q in chosen if q is not p)
        ]
        self._move(chosen)
        return list(self._certain())

    def end(self) -> list[Node]:
        """The remaining edits, with insertions after the last turn where they are needed."""
        ends = []
        for state, (cost, rank, node) in self.survivors.items():
            at, roles = state, ()
            for n in range(MOST_INSERTED + 1):
                if at in ENDS:
                    ends.append((cost + COST[INSERT] * n, rank, INSERT * n, at, node, roles, None))
                at = NEXT[at]
                roles = (*roles, NAMES[at])
        self._move([min(ends, key=lambda e: e[:3])])
        ((_, _, node),) = self.survivors.values()
        return list(self._certain()) if node is not self.root else []


class _Rows:
    """Collects output rows and hands them on as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 8192, most_chars: int = 4_000_000):
        self.schema, self.most, self.most_chars = schema, most, most_chars
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= self.most or self.chars >= self.most_chars:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
            self.rows, self.chars = [], 0


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of conversation and place to edits in the same order."""
    out = _Rows(EDITS)
    tables: dict[tuple[str, str], list] = {}
    current, repair, place, last = object(), None, 0, None

    def written(nodes):
        nonlocal place
        for node in nodes:
            turn, fault, illegal, role, text = node.turn or (None, None, False, None, "")
            cost = COST[node.letter]
            if node.letter == DELETE:
                role = text = None
            else:
                role = node.role or role
                cost += TRUNCATED_COST if fault == TRUNCATED else 0
            row = (current, place, turn, node.letter, fault or None, illegal, cost, role, text)
            place += 1
            yield from out.add(row, len(text or ""))

    def closed():
        if repair is not None:
            yield from written(repair.end())
            if not place:  # no turn is present: a row without edit names the conversation
                yield from out.add((current, None, None, None, None, False, 0, None, None))

    for batch in batches:
        for conv, turn, role, text, fault, present in zip(
            *[column.to_pylist() for column in batch.columns], strict=True
        ):
            if conv != current:
                yield from closed()
                current, repair, place, last = conv, Repair(), 0, None
            if not present:
                continue
            initial = role[:1]
            illegal = last is not None and last + initial not in LEGAL_PAIRS
            last = initial
            kind = (initial if initial in ("", "s", "u", "a") else "other", fault)
            if kind not in tables:
                tables[kind] = steps(initial, fault)
            yield from written(repair.add(tables[kind], (turn, fault, illegal, role, text)))
    yield from closed()
    yield from out.flush()


def repair(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """The cheapest edits that bring every conversation's role initials to `(s?(ua)+)?`.

    One row per edit, in the partitions and the order of `turns` sorted by conversation and turn
    (nulls first; turns of one number by role and text): conv, place (of the edit, from 0), turn,
    edit (D delete, I insert, K keep, R new role user or assistant), fault (blank, duplicate or
    truncated, the first that holds, else null), illegal (the turn's initial may not follow that
    of the turn before it), cost, and the role and text that stand in the repaired conversation
    (null where deleted). Blank and duplicate turns have to be deleted; a truncated one costs more
    if it stays. Of repairs of equal cost the one whose letters come first in ASCII is taken.

    Nulls: a null role or text counts as one space, a null conversation is a conversation of its
    own. A row for which `present` is false or null only names its conversation, and a conversation
    without a present row has one row without edit. Repeated rows are turns of their own, so the
    second is a duplicate. An empty table gives an empty one; other columns are not looked at. A
    role that is the empty string has no initial and may stand anywhere.

    The turns move once. A conversation is read in one task as a stream, its faults come from
    sorts that can spill, and memory holds what survivors don't yet share: a few turns as a rule,
    all of them where the first edit depends on the last turn (as in one user's monologue).
    """
    kept = turns.select(
        F.col(conversation).cast("bigint").alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
        F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("present"),
    ).repartition("conv")
    body = F.rtrim("text", F.lit(SPACES))
    same = W.partitionBy("conv", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(body == "", BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    # Equal rows differ in their fault only: the first of them must come first.
    first = F.col("fault") == DUPLICATE
    ordered = kept.select("conv", "turn", "role", "text", fault.alias("fault"), "present")
    ordered = ordered.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", first)
    schema = "conv bigint, place bigint, turn bigint, edit string, fault string, illegal boolean, "
    return ordered.mapInArrow(_edits, schema + "cost bigint, role string, text string")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to one row per conversation."""
    out = _Rows(AUDITS)
    current, seen = object(), False
    least = most = None
    numbers = illegal = cost = 0
    faults: dict[str, int] = {}
    audit: list[str] = []
    digest, joined = hashlib.sha256(), False

    def closed():
        gaps = 0 if least is None else most - least + 1 - numbers
        row = (current, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost)
        yield from out.add((*row, "".join(audit), digest.hexdigest()), len(audit))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8)]
        for conv, turn, edit, fault, wrong, price, role, text in zip(*columns, strict=True):
            if not seen or conv != current:
                if seen:
                    yield from closed()
                current, seen = conv, True
                least = most = None
                numbers = illegal = cost = 0
                faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
                audit = []
                digest, joined = hashlib.sha256(), False
            if edit is None:
                continue
            audit.append(edit)
            illegal += wrong
            cost += price
            if fault is not None:
                faults[fault] += 1
            if turn is not None and turn != most:
                numbers += 1
                least, most = turn if least is None else least, turn
            if edit != DELETE:
                digest.update(f"\n{role}:{text}".encode() if joined else f"{role}:{text}".encode())
                joined = True
    if seen:
        yield from closed()
    yield from out.flush()


def audits(edits: DataFrame) -> DataFrame:
    """One row per conversation of what `repair` returned, which must be passed on as it is.

    conv_id; gaps, the turn numbers missing between the least and the greatest (0 if all are
    null); blank, duplicate, truncated, the turns with that fault; illegal, the adjacent turns
    whose initials may not follow each other; cost; audit, the edits' letters in order;
    repaired_sha256 of the repaired `role:text` lines, joined by newlines.
    """
    numbers = ", ".join(f"{n} bigint" for n in AUDITS.names[:-2])
    return edits.mapInArrow(_audits, f"{numbers}, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of conversation and turn, and `present`.

    crc32(`conv_id:turn`) % 20, nulls read as one space: 0 makes the row not present, 1 empties its
    text, 2 removes `.`, `!` and `?`, 3 repeats the row, 4 makes it a user's.
    """
    names = ("conv_id", "turn", "role", "text")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in names}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20
    marked = turns.select(
        "conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind")
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(copies).alias("copy"),
    )
