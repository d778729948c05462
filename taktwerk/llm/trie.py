"""The prefix tree of conversations, from adaptive radix trees over turn ids.

A turn's id is the first 16 bytes of a SHA-256 of its role and text, so texts leave the first stage as ids and word counts.
A conversation's key is its ids in a row, which puts equal beginnings side by side in the order of the bytes.  Conversations
with the same key are one sequence before any tree is built.  The sequences are cut into ranges of keys; each task builds an
adaptive radix tree of its range (nodes of 4, 16, 48 or 256 children that grow, compressed paths between branches) and walks it
from the leaves up.  Only byte depths that are multiples of 16 are turns and give rows; a compressed path may hold many of them.

Nodes along a range's first and last key may go on in its neighbours.  They are not given out but leave as two paths with what
the range knows of them: members, least id, finished children, leaves and savings below.  Such paths, two a range, are the
keys of the next round, with fewer ranges, until there is one.  No range depends on how many conversations share a beginning.

Defined results: a null role or text is empty; turns go by number (null first), turns of one number by their ids; rows without
a conversation id are in no conversation; a table without conversations has no node.  A conversation is one key in a task's
memory: 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import WORD, materialize, merged, scratch, sliced, with_text

#: Bytes of a turn's id.
WIDTH = 16
#: Sequences and bytes of keys that one task builds a tree of, and how many ranges one range of the next round takes up.
PART_KEYS, PART_BYTES, PART_RANGES = 10_000, 4_000_000, 64
#: Ids of copies are put together by this number of bits of the id first, so that no group of copies meets in one row.
CHUNK_BITS = 16

NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- the tree --------------------------------------------------------------------------------------------------


class Sorted:
    """Up to ``room`` children beside their sorted bytes: the layouts of 4 and 16."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4):
        self.keys, self.nodes, self.room = bytearray(), [], room

    def find(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        """The layout with a child more or another child: this one, or a larger one where it was full."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            if self.room == 16:
                return Indexed(self).put(byte, node)
            self.room = 16
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def children(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children, found by an index of 256 places."""

    __slots__ = ("index", "nodes")

    def __init__(self, smaller: Sorted):
        self.index, self.nodes = bytearray(256), list(smaller.nodes)
        for place, byte in enumerate(smaller.keys, 1):
            self.index[byte] = place

    def find(self, byte: int) -> Node | None:
        place = self.index[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            return Full(self).put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def children(self) -> list[Node]:
        return [self.nodes[place - 1] for place in self.index if place]


class Full:
    """A place for each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self, smaller: Indexed):
        self.nodes = [smaller.find(byte) for byte in range(256)]

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def children(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Node:
    """The bytes behind the one that led here up to the next branch, what is known of the key that ends there, and the children."""

    __slots__ = ("path", "value", "kids", "edge")

    def __init__(self, path: bytes, value: Value | None = None):
        self.path, self.value, self.kids, self.edge = path, value, None, 0

    def put(self, byte: int, node: Node) -> None:
        self.kids = (self.kids or Sorted()).put(byte, node)


class Value:
    """What a key adds to its node: members that end or are finished there, their least id, finished children, leaves and
    savings below, the hash of those that end there, the words of each turn on the way, and in later rounds the key's digest."""

    __slots__ = ("n", "least", "kids", "leaves", "saved", "ends", "words", "digest")

    def __init__(self, n=0, least=None, kids=0, leaves=0, saved=0, ends=None, words=None, digest=None):
        self.n, self.least, self.kids, self.leaves, self.saved, self.ends, self.words, self.digest = n, least, kids, leaves, saved, ends, words, digest

    def add(self, other: Value) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` the key has from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if key.startswith(path[:middle], at) else (low, middle - 1)
    return low


class Tree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value: Value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at, above, byte = self.root, 0, None, 0
        while True:
            same = _common(node.path, key, at)
            if same < len(node.path):
                upper = Node(node.path[:same])
                upper.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node = upper
            at += same
            if at == len(key):
                if node.value is None:
                    node.value = value
                else:
                    node.value.add(value)
                return
            child = node.kids.find(key[at]) if node.kids else None
            if child is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, byte, node, at = node, key[at], child, at + 1

    def mark(self, key: bytes, edge: int) -> None:
        """Note on all nodes of a key's way that they lie at an edge of the range."""
        node, at = self.root, 0
        while True:
            node.edge = node.edge or edge
            at += len(node.path)
            if at == len(key):
                return
            node, at = node.kids.find(key[at]), at + 1


def walk(tree: Tree, give: Callable[[tuple], int], settle: Callable[[list[int], int | None, int, int], None], edge: Callable[[int, int, Value], None]) -> None:
    """All turn nodes from the leaves up.

    ``give(row)`` takes a finished node and returns its number; ``settle(numbers, least, edge, depth)`` names the parent of such nodes, by
    its least id or by the edge it lies on; ``edge(which, depth, value)`` takes a node at an edge.
    """
    # A frame: node, byte depth where it begins (its parent's end) and ends, children left, what is gathered, nodes without a parent yet.
    def frame(node: Node, begin: int) -> list:
        return [node, begin, begin + 1 + len(node.path), iter(node.kids.children()) if node.kids else iter(()), node.value or Value(), []]

    if tree.root is None:
        return
    stack = [frame(tree.root, -1)]
    while stack:
        node, begin, end, left, sum_, orphans = stack[-1]
        child = next(left, None)
        if child is not None:
            stack.append(frame(child, end))
            continue
        stack.pop()
        for depth in range(end // WIDTH, begin // WIDTH, -1):
            if node.edge:
                settle(orphans, None, node.edge, depth)
                edge(node.edge, depth, sum_)
                sum_, orphans = Value(words=sum_.words), []
                continue
            words = sum_.words[depth - 1] if depth else 0
            saved = sum_.saved + (sum_.n - 1) * words
            leaves = sum_.leaves if sum_.kids else 1
            settle(orphans, sum_.least, 0, depth)
            number = give((sum_.least, depth, sum_.n, sum_.kids, leaves, saved, sum_.ends or NO_ENDS, sum_.digest))
            sum_, orphans = Value(sum_.n, sum_.least, 1, leaves, saved, None, sum_.words), [number]
        if stack:
            above = stack[-1]
            above[4].add(sum_)
            above[4].words = above[4].words or sum_.words
            # The longer list takes up the shorter one.
            if len(above[5]) < len(orphans):
                above[5], orphans = orphans, above[5]
            above[5] += orphans
        else:
            settle(orphans, None, 0, -1)


# ---- ranges of keys --------------------------------------------------------------------------------------------

#: A key with what is known of its nodes from depth ``first`` to its end.
_PATH = (
    "key binary, words array<int>, first int, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
)
_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long"
#: Rows of a round: nodes (with the digests that tie them to a parent that is not known yet) and paths (with the digests of their nodes).
_ROUND = f"{_NODE}, part int, digest binary, parent binary, {_PATH}, digests array<binary>"
_LONGS = ("n", "least", "kids", "leaves", "saved")
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (column.split(" ") for column in schema.split(", "))])


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _range_nodes(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The tree of one range (its rows come in the order of their keys); ``whole``: it is the only one, so nothing is left open."""
    schema = _arrow(_ROUND)
    tree, first, last = Tree(), None, None
    for batch in sliced(batches):
        columns = batch.to_pydict()
        for i, key in enumerate(columns["key"]):
            words, begin, digests = columns["words"][i], columns["first"][i], columns["digests"][i]
            for j, known in enumerate(zip(*[columns[c][i] for c in (*_LONGS, "ends")], strict=True)):
                tree.insert(key[: (begin + j) * WIDTH], Value(*known, words, digests and digests[j]))
            last = (key, words)
            first = first or last
    if first is None:
        return
    part = TaskContext.get().partitionId()
    if not whole:
        tree.mark(first[0], 1)
        tree.mark(last[0], 2)
    made = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest")
    rows: dict[str, list] = {c: [] for c in (*made, "parent_conv_id", "parent")}
    known: dict[int, dict[int, Value]] = {1: {}, 2: {}}

    def give(row: tuple) -> int:
        for name, value in zip(made, row, strict=True):
            rows[name].append(value)
        rows["parent_conv_id"].append(None)
        rows["parent"].append(None)
        return len(rows["depth"]) - 1

    def settle(numbers: list[int], least: int | None, edge: int, depth: int) -> None:
        parent = _digest((first if edge == 1 else last)[0][: depth * WIDTH]) if edge and numbers else None
        for number in numbers:
            rows["parent_conv_id"][number], rows["parent"][number] = least, parent

    walk(tree, give, settle, lambda edge, depth, value: known[edge].__setitem__(depth, value))
    n = len(rows["depth"])
    for at in range(0, n, 1000):
        size = min(1000, n - at)
        held = {c: v[at : at + size] for c, v in rows.items()} | {"part": [part] * size}
        yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) if f.name in held else pa.nulls(size, f.type) for f in schema], schema=schema)
    # What lies on both ways counts for the first.
    for edge, (key, words), begin in () if whole else ((1, first, 0), (2, last, _common(first[0], last[0], 0) // WIDTH + 1)):
        depths = range(begin, len(key) // WIDTH + 1)
        values = [known[edge][d] for d in depths]
        if values:
            path = {"part": part, "key": key, "words": words, "first": begin, "ends": [v.ends for v in values], "digests": [_digest(key[: d * WIDTH]) for d in depths]}
            path |= {c: [getattr(v, c) for v in values] for c in _LONGS}
            yield pa.RecordBatch.from_arrays([pa.array([path.get(f.name)], f.type) for f in schema], schema=schema)


# ---- conversations ---------------------------------------------------------------------------------------------


def turn_sequences(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turns``: the turns of each conversation in order, each ``id`` (32 hexadecimal digits) and ``words``."""
    own = with_text(rows.where(rows[conv_col].isNotNull()), {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = F.struct("turn", name.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    each = own.select(F.col("conv").cast("long").alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return each.select("conv", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def branched(sequences: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``group`` (those it has) in the place of its own first h.

    h is the CRC-32 of c in decimal digits, modulo ``most``.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    mine = sequences.select("conv", "turns", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(group))).alias("base"))
    heads = sequences.where(F.pmod("conv", F.lit(group)) == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return merged(mine, heads, "base", "left").select("conv", F.concat(head, own).alias("turns"))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the chunks of each key (they come in order) together, its ids joined by commas and hashed as they pass."""
    schema = _arrow(f"{_PATH}, digests array<binary>")
    now, hashed = None, None

    def done() -> dict:
        key, words, n, least = now
        row = {"key": key, "words": words, "first": len(key) // WIDTH, "n": [n], "least": [least], "kids": [0], "leaves": [0], "saved": [0], "ends": [hashed.hexdigest()]}
        return {f.name: row.get(f.name) for f in schema}

    out: list[dict] = []
    for batch in sliced(batches):
        for row in batch.to_pylist():
            if now is not None and now[0] == row["key"]:
                hashed.update(b",")
                now[2] += row["n"]
            else:
                if now is not None:
                    out.append(done())
                now, hashed = [row["key"], row["words"], row["n"], row["least"]], hashlib.sha256()
            hashed.update(row["ids"].encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([*out, done()], schema=schema)


def prefix_tree(sequences: DataFrame, part_keys: int = PART_KEYS, part_ranges: int = PART_RANGES) -> DataFrame:
    """One row per distinct beginning of the sequences ``conv, turns`` (see :func:`turn_sequences`), the empty one included.

    ``conv_id`` is the least conversation that begins so, ``parent_conv_id`` that of the beginning one turn shorter;
    ``n_convs, n_children, n_leaves``; ``saved_tokens``: the words that this node and those below share, each once less than it
    has members; ``ends_sha256``: of the ids that end here, ascending, joined by commas.
    """
    with scratch(sequences.sparkSession) as keep:
        keyed = sequences.select(
            F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"),
            "conv", F.shiftright("conv", CHUNK_BITS).alias("chunk"),
        )
        # Ids are unique, so a chunk has at most 2 ** CHUNK_BITS of them.
        ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
        chunks = keyed.groupBy("key", "chunk").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), ids.alias("ids"))
        rows = chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_sequences, f"{_PATH}, digests array<binary>")
        rows = materialize(rows, "sequences")
        n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
        parts = max(1, -(-n // part_keys), -(-size // PART_BYTES))
        rounds = []
        while True:
            whole = parts == 1
            dealt = (rows.repartition(1) if whole else rows.repartitionByRange(parts, "key")).sortWithinPartitions("key")
            rounds.append(materialize(dealt.mapInArrow(partial(_range_nodes, whole=whole), _ROUND), "trie-round"))
            if whole:
                break
            rows, parts = rounds[-1].where("key IS NOT NULL").drop("part"), -(-parts // part_ranges)
        nodes = rounds.pop().select(*_COLUMNS, "digest")
        while rounds:
            # Parents of this round's nodes that were at an edge came out in a later one; each range has its own rows of them.
            own = rounds.pop()
            edges = own.where("key IS NOT NULL").select("part", F.explode("digests").alias("digest")).distinct()
            edges = merged(edges, nodes.select("digest", F.col("conv_id").alias("found")), "digest").select("part", F.col("digest").alias("parent"), "found")
            own = own.where("key IS NULL")
            late = merged(own.where("parent IS NOT NULL").drop("parent_conv_id"), edges, ["part", "parent"])
            late = late.withColumnRenamed("found", "parent_conv_id").select(*_COLUMNS, "digest")
            nodes = nodes.unionByName(own.where("parent IS NULL").select(*_COLUMNS, "digest")).unionByName(late)
        return keep(nodes.select(*_COLUMNS), "trie")


_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
