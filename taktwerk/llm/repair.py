"""Repair of damaged conversations at least cost, with the edits that it took.

Rows that are repeated, blank or out of turn are kept, given another role, deleted, or joined by inserted ones, so that the
roles become ``(s?(ua)+)?`` (an optional system turn, then user and assistant by turns).  A dynamic programme goes over a
conversation's rows with four states, and of two ways of equal cost the one holds whose edits are first in the order of
their letters.  Ways share their beginnings: each is a chain of nodes with binary-lifting ancestors and a rolling hash of
all letters up to it.  Two ways are compared by searching for the length of their common beginning by these hashes; equal
hashes of different nodes are checked letter by letter.

Spark deals the rows by conversation and sorts them, and a task reads them as a stream.  A conversation may be long: what
all ways that are still alive have in common is settled and leaves the task's memory together with its texts.  What stays for
each row of the conversation in hand is its letter and a digest (later rows may repeat it).  A conversation is a sequence,
so its rows go through one task.

Defined results: a null role or text is one blank; rows go by turn (null first), rows of one turn by role and text; rows with
a null conversation id are a conversation of their own; repeated rows are repeats; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taktwerk.llm.common import sliced, with_text

#: What an edit costs; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: After so many rows what is settled leaves the memory.
SETTLE_ROWS = 4096
#: Last characters of a whole text.
ENDS = ".!?"

_SPACE = " \t\n\x0b\x0c\r"
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1

#: States: nothing yet, after system, after user, after assistant; and where a role's initial leads from each.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT: tuple[dict[str, int], ...] = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
#: The role that an inserted or changed row has in each state.
_TURN = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}


class Node:
    """The last of a chain of edits: its letter, the state it leads to, the rolling hash of all letters, and ancestors 1, 2, 4 ... back."""

    __slots__ = ("up", "letter", "state", "depth", "hash")

    def __init__(self, parent: Node | None, letter: str = "", state: int = _START):
        self.letter, self.state = letter, state
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % _MODULUS
        up, at = [parent], parent
        while len(at.up) >= len(up):
            at = at.up[len(up) - 1]
            up.append(at)
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Node:
        at, back = self, self.depth - depth
        while back:
            k = back.bit_length() - 1
            at = at.up[k]
            back -= 1 << k
        return at

    def chain(self) -> list[Node]:
        """The nodes behind the root up to this one."""
        out, at = [], self
        while at.up:
            out.append(at)
            at = at.up[0]
        return out[::-1]


def _letters_equal(a: Node, b: Node) -> bool:
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def comes_first(a: Node, b: Node) -> bool:
    """Whether the letters up to ``a`` are before those up to ``b``; both chains begin at one root."""
    x, y = a.ancestor(min(a.depth, b.depth)), b.ancestor(min(a.depth, b.depth))
    if x is y or (x.hash == y.hash and _letters_equal(x, y)):
        return a.depth < b.depth
    # The longest common beginning, by steps that halve; an equal hash of two nodes counts once the letters are checked.
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and (p := x.up[k]) is not (q := y.up[k]) and not (p.hash == q.hash and _letters_equal(p, q)):
            x, y = p, q
    return x.letter < y.letter


class Edit(NamedTuple):
    """A row of the repaired conversation, or one that was deleted (no role, no text)."""

    letter: str
    role: str | None
    text: str | None


class Repair:
    """One conversation: rows go in by :meth:`row`, edits come out as soon as they are settled."""

    def __init__(self):
        self.best: dict[int, tuple[int, Node]] = {_START: (0, Node(None))}
        self.held: list[tuple[str, str]] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen: set[bytes] = set()
        self.before: str | None = None
        self.turns = 0
        self.least_turn = self.most_turn = self.last_turn = None

    def _inserts(self) -> None:
        """Let inserted rows lead from each state to others, as long as that makes a way cheaper or earlier."""
        work = list(self.best)
        while work:
            state = work.pop()
            cost, node = self.best[state]
            to = _TURN[state]
            if self._offer(self.best, to, cost + INSERT, node, "I"):
                work.append(to)

    def _prune(self) -> None:
        """Drop ways at the conversation's begin that cannot win any more, so that the others come to share theirs.

        What can follow on nothing or on a system turn can follow on an assistant's, but for a system row, which has to be deleted.
        """
        if after := self.best.get(_ASSISTANT):
            for state, more in ((_START, DELETE), (_SYSTEM, 0)):
                if state in self.best and self.best[state][0] > after[0] + more:
                    del self.best[state]

    @staticmethod
    def _offer(best: dict[int, tuple[int, Node]], state: int, cost: int, parent: Node, letter: str) -> bool:
        held = best.get(state)
        if held and held[0] < cost:
            return False
        node = Node(parent, letter, state)
        if held and held[0] == cost and not comes_first(node, held[1]):
            return False
        best[state] = (cost, node)
        return True

    def row(self, turn: int | None, role: str, text: str) -> list[Edit]:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.last_turn = self.most_turn = turn
            self.least_turn = turn if self.least_turn is None else self.least_turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        body = text.rstrip(_SPACE)
        size = str(len(role)).encode()
        digest = hashlib.blake2b(b"%b:%b%b" % (size, role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")), digest_size=16).digest()
        cut = must_go = False
        if not body:
            self.blank += 1
            must_go = True
        elif digest in self.seen:
            self.duplicate += 1
            must_go = True
        elif body[-1] not in ENDS:
            self.truncated += 1
            cut = True
        self.seen.add(digest)
        self._inserts()
        self._prune()
        new: dict[int, tuple[int, Node]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(new, state, cost + DELETE, node, "D")
            if not must_go:
                more = cost + TRUNCATED * cut
                to = _NEXT[state].get(role[:1])
                if to is not None:
                    self._offer(new, to, more, node, "K")
                self._offer(new, _TURN[state], more + REROLE, node, "R")
        self.best = new
        self.held.append((role, text))
        self.rows += 1
        return self._settle() if len(self.held) >= SETTLE_ROWS and self.rows % SETTLE_ROWS == 0 else []

    def _edits(self, chain: list[Node]) -> list[Edit]:
        out, at = [], 0
        for node in chain:
            if node.letter == "I":
                out.append(Edit("I", _ROLES[node.state], ""))
                continue
            role, text = self.held[at]
            at += 1
            out.append(Edit("D", None, None) if node.letter == "D" else Edit(node.letter, role if node.letter == "K" else _ROLES[node.state], text))
        del self.held[:at]
        return out

    def _settle(self) -> list[Edit]:
        """The edits that all ways have in common; the ways begin anew behind them."""
        chains = {state: node.chain() for state, (_, node) in self.best.items()}
        first, *others = chains.values()
        same = min(map(len, chains.values()))
        for other in others:
            low, high = 0, same
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if first[middle - 1] is other[middle - 1] else (low, middle - 1)
            same = low
        if not same:
            return []
        root = Node(None, "", first[same - 1].state)
        made: dict[int, Node] = {id(first[same - 1]): root}
        for state, chain in chains.items():
            at = root
            for node in chain[same:]:
                at = made.setdefault(id(node), None) or Node(at, node.letter, node.state)
                made[id(node)] = at
            self.best[state] = (self.best[state][0], at)
        return self._edits(first[:same])

    def end(self) -> tuple[int, list[Edit]]:
        """What the cheapest way costs, and the edits that are left."""
        self._inserts()
        cost, node = self.best.get(_START, (None, None))
        other = self.best.get(_ASSISTANT)
        if other and (node is None or other[0] < cost or other[0] == cost and comes_first(other[1], node)):
            cost, node = other
        return cost, self._edits(node.chain())

    @property
    def gaps(self) -> int:
        return 0 if self.least_turn is None else self.most_turn - self.least_turn + 1 - self.turns


#: How rows come to a task: ``times`` is how often a row stands there (0: the conversation had it once, but it is lost).
_ROWS = ("conv", "turn", "role", "text", "times")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Settled edits as ``(conv, its Repair, edits, cost, last)``; the cost is known with the last ones, which every conversation has."""
    now, repair = None, None
    for batch in sliced(batches):
        for conv, turn, role, text, times in zip(*[batch.column(c).to_pylist() for c in _ROWS], strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    yield now, repair, *reversed(repair.end()), True
                now, repair = conv, Repair()
            for _ in range(times):
                if edits := repair.row(turn, role, text):
                    yield now, repair, edits, None, False
    if repair is not None:
        yield now, repair, *reversed(repair.end()), True


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.select(*_ROWS).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    own = with_text(rows, {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return own.select("conv", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.lit(1).alias("times"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of :func:`_prepared` with faults put in by the CRC-32 of ``conv:turn`` (a null is one blank) modulo 20.

    0: the row is lost (``times`` is 0); 1: its text is empty; 2: ``[.!?]`` are taken out of it; 3: it stands twice; 4: its role is user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(name("conv"), F.lit(":"), name("turn")).cast("binary")) % 20
    text: Column = F.when(lot <= 1, F.lit("")).when(lot == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(lot == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


_EDITS = "place long, edit string, role string, text string"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _schema(conv: pa.DataType, columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([("conv", conv), *[(c, kinds[k]) for c, k in (x.split(" ") for x in columns.split(", "))]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _edit_rows(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema, place = _schema(conv_type, _EDITS), 0
    for conv, _, edits, _, last in _streamed(batches):
        for at in range(0, len(edits), 1000):
            yield _batch([(conv, place + i, *edit) for i, edit in enumerate(edits[at : at + 1000], at)], schema)
        place = 0 if last else place + len(edits)


def _reports(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = _schema(conv_type, _REPORT)
    out: list[tuple] = []
    audit: list[str] = []
    digest, some = hashlib.sha256(), False
    for conv, repair, edits, cost, last in _streamed(batches):
        audit.append("".join(e.letter for e in edits))
        for _, role, text in edits:
            if role is not None:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                some = True
        if last:
            out.append((conv, repair.gaps, repair.blank, repair.duplicate, repair.truncated, repair.illegal, cost, "".join(audit), digest.hexdigest()))
            audit, digest, some = [], hashlib.sha256(), False
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
    if out:
        yield _batch(out, schema)


def _mapped(rows: DataFrame, function, columns: str) -> DataFrame:
    kind = rows.schema["conv"].dataType
    return _dealt(rows).mapInArrow(partial(function, conv_type=to_arrow_type(kind)), f"conv {kind.simpleString()}, {columns}")


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per edit of each conversation, in order: the conversation, ``place`` (from 0), ``edit`` (K, R, D or I), ``role`` and ``text``.

    The rows whose edit is not D are the repaired conversation; a deleted row has a null role and text.
    """
    out = _mapped(_prepared(rows, conv_col, turn_col, role_col, text_col), _edit_rows, _EDITS)
    return out.select(F.col("conv").alias(conv_col), "place", "edit", "role", "text")


def repair_report(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False
) -> DataFrame:
    """One row per conversation: faults, the cost of its repair, the edits' letters and the SHA-256 of its repaired lines.

    With ``damage`` the rows get faults first, see :func:`damaged`; a conversation that loses all its rows still has a row here.
    """
    own = _prepared(rows, conv_col, turn_col, role_col, text_col)
    out = _mapped(damaged(own) if damage else own, _reports, _REPORT)
    return out.select(F.col("conv").alias(conv_col), *out.columns[1:])
