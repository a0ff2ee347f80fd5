"""Repair of conversations by the cheapest edits, with the least audit among equals.

A dynamic program runs over the rows of a conversation. After each row it keeps, for each
state (nothing kept, ends with system, user, assistant), the cheapest edits so far. Edits are
a linked list of letters that shares its prefixes with the other states; each node has its
ancestors at distances 1, 2, 4, ... and a rolling hash of all letters up to it. Two lists of
equal cost are compared by the longest common prefix, which the ancestors and hashes find in
logarithmically many steps; the prefixes found equal by hash are then verified letter by
letter, up to the node they share.

Rows come sorted, and what all states agree on is settled: its letters, texts and nodes leave
the program. So a task holds the letters of one conversation and the rows still in dispute,
not its texts (unless two repairs stay equally good from the first row to the last). Whether role and text were seen earlier is decided before, spread over
(conversation, text), and not in that task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from censusloom.llm.common import map_batches

# Fixed values of the contract: costs, and the characters that are white space or end a text.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_BLANK = " \t\n\x0b\x0c\r"
_STOPS = ".!?"

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_SETTLE_EVERY = 512  # nodes
# A state, and the states from which its role may follow ("" is: nothing kept so far).
_BEFORE = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
# A state is hopeless when another one is cheaper by more than the edits that imitate it:
# what follows "" works after "a" with one row more deleted, and so on.
_IMITATE = (("", "a", 2), ("s", "a", 0), ("u", "a", 5), ("a", "u", 5), ("", "u", 7), ("s", "u", 5))


class Node:
    """A letter, the role it leaves (empty for a deletion), and the list before it."""

    __slots__ = ("depth", "hash", "letter", "role", "up")

    def __init__(self, parent: Node | None, letter: str, role: str):
        self.letter, self.role = letter, role
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % _PRIME
        up, k = [parent], 0
        while len(up[k].up) > k:  # the ancestor at 2 ** k has one at 2 ** k itself
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)


def lifted(node: Node, depth: int) -> Node:
    """The ancestor of ``node`` at ``depth``."""
    while node.depth > depth:
        step = min((node.depth - depth).bit_length(), len(node.up)) - 1
        node = node.up[step]
    return node


def same_letters(x: Node, y: Node) -> bool:
    """Whether two lists of equal depth are equal, letter by letter, up to a node they share."""
    while x is not y:
        if x.letter != y.letter:
            return False
        x, y = x.up[0], y.up[0]
    return True


def _letters(node: Node) -> str:
    out = []
    while node.up:
        out.append(node.letter)
        node = node.up[0]
    return "".join(reversed(out))


def precedes(a: Node, b: Node) -> bool:
    """Whether the letters of ``a`` come before those of ``b``, by their longest common prefix."""
    depth = min(a.depth, b.depth)
    x, y = lifted(a, depth), lifted(b, depth)
    if x.hash == y.hash:
        if same_letters(x, y):
            return a.depth < b.depth
        return _letters(a) < _letters(b)  # a collision
    top = min(len(x.up), len(y.up))
    for k in reversed(range(top)):
        if k < len(x.up) and k < len(y.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if x.letter != y.letter and same_letters(x.up[0], y.up[0]):
        return x.letter < y.letter
    return _letters(a) < _letters(b)  # a collision


class Repair:
    """The program for one conversation; rows are given in order."""

    def __init__(self) -> None:
        root = Node(None, "", "")
        self.best: dict[str, tuple[int, Node]] = {"": (0, root)}
        self.root = root
        self.made = 0
        self.waiting: list[tuple[str, str]] = []  # rows that are not settled
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = 0

    def _offer(self, best: dict, state: str, cost: int, parent: Node, letter: str, role: str) -> None:
        held = best.get(state)
        if held is None or cost < held[0]:
            best[state] = (cost, Node(parent, letter, role))
        elif cost == held[0]:
            node = Node(parent, letter, role)
            if precedes(node, held[1]):
                best[state] = (cost, node)
        else:
            return
        self.made += 1

    def _insert(self, best: dict) -> None:
        for state in ("u", "a"):  # a user may be inserted, then an assistant
            for before in _BEFORE[state]:
                if before in best:
                    cost, node = best[before]
                    self._offer(best, state, cost + INSERT, node, "I", state)

    def row(self, role: str, text: str, fault: str) -> None:
        best = dict(self.best)
        self._insert(best)
        made: dict[str, tuple[int, Node]] = {}
        kept = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in best.items():
            self._offer(made, state, cost + DELETE, node, "D", "")
            if fault in ("blank", "duplicate"):
                continue
            for after in ("s", "u", "a"):
                if state not in _BEFORE[after]:
                    continue
                if role[:1] == after:
                    self._offer(made, after, cost + kept, node, "K", after)
                elif after != "s":
                    self._offer(made, after, cost + REROLE + kept, node, "R", after)
        for state, other, more in _IMITATE:
            if state in made and other in made and made[state][0] > made[other][0] + more:
                del made[state]
        self.best = made
        self.waiting.append((role, text))
        if self.made > _SETTLE_EVERY:
            self._settle()

    def _settle(self) -> None:
        """Write down what all states share, and begin anew from there."""
        nodes = [node for _, node in self.best.values()]
        depth = min(n.depth for n in nodes)
        nodes = [lifted(n, depth) for n in nodes]
        while any(n is not nodes[0] for n in nodes):
            nodes = [n.up[0] for n in nodes]
        shared = nodes[0]
        self.made = 0
        if shared is self.root:
            return
        self._write(shared)
        # Nodes after the shared one, anew: their ancestors must not keep the settled ones alive.
        self.root = Node(None, "", "")
        again: dict[int, Node] = {id(shared): self.root}
        for state, (cost, node) in self.best.items():
            path = []
            while id(node) not in again:
                path.append(node)
                node = node.up[0]
            new = again[id(node)]
            for old in reversed(path):
                new = again[id(old)] = Node(new, old.letter, old.role)
            self.best[state] = (cost, new)

    def _write(self, node: Node) -> None:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.up[0]
        used = 0
        names = {"s": "system", "u": "user", "a": "assistant"}
        for step in reversed(path):
            self.audit.append(step.letter)
            if step.letter == "I":
                role, text = names[step.role], ""
            else:
                role, text = self.waiting[used]
                used += 1
                if step.letter == "D":
                    continue
                if step.letter == "R":
                    role = names[step.role]
            self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1
        del self.waiting[:used]

    def close(self) -> tuple[int, str, str]:
        """(cost, audit, sha256 of the repaired rows)."""
        best = dict(self.best)
        self._insert(best)
        ends = [best[s] for s in ("", "a") if s in best]
        cost, node = ends[0]
        for other_cost, other in ends[1:]:
            if other_cost < cost or (other_cost == cost and precedes(other, node)):
                cost, node = other_cost, other
        self._write(node)
        return cost, "".join(self.audit), self.digest.hexdigest()


_OUT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


class _Conversation:
    def __init__(self, ident):
        self.ident = ident
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last_role = 0, None
        self.low = self.high = None
        self.turns, self.last_turn = 0, None
        self.repair = Repair()

    def row(self, turn, role: str, text: str, again: bool) -> None:
        full = text.rstrip(_BLANK)
        fault = "blank" if not full else "duplicate" if again else "truncated" if full[-1] not in _STOPS else ""
        if fault:
            self.faults[fault] += 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        faults = (self.faults["blank"], self.faults["duplicate"], self.faults["truncated"])
        return (self.ident, gaps, *faults, self.illegal, *self.repair.close())


def _repair_sorted(batches: Iterator[dict]) -> Iterator[dict]:
    names = [f.split()[0] for f in _OUT.split(", ")]
    done: list[tuple] = []
    current: _Conversation | None = None
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "again", "present"))
        for ident, turn, role, text, again, present in zip(*columns, strict=True):
            if current is None or current.ident != ident:
                if current is not None:
                    done.append(current.result())
                current = _Conversation(ident)
            if present:
                current.row(turn, role, text, again)
        if done:
            yield dict(zip(names, map(list, zip(*done, strict=True)), strict=True))
            done = []
    if current is not None:
        yield dict(zip(names, ([v] for v in current.result()), strict=True))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the contract's damage: dropped rows stay with ``present`` false.

    Null roles and texts become one space. The damage of a row follows from its ids, a null
    counted as one space, so rows with equal ids are damaged alike.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and its cheapest repair.

    ``rows`` has conv_id, turn, role, text (no nulls in the last two) and ``present``; a row
    that is not present only names its conversation. Rows of a conversation are taken by turn,
    nulls first, rows of one turn by role and text, so repeated rows stay next to each other.
    Null ids are one conversation. A conversation without rows has zeros, an empty audit and
    the hash of the empty text; an empty table gives no rows. Other columns are not read.
    """
    same = Window.partitionBy("conv_id", "present", "role", "text")
    order = [F.col("turn").asc_nulls_first()]
    again = rows.select(
        "conv_id", "turn", "role", "text", "present", (F.row_number().over(same.orderBy(*order)) > 1).alias("again")
    )
    sorted_rows = again.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order, "role", "text", "again")
    return map_batches(sorted_rows, _repair_sorted, _OUT)
