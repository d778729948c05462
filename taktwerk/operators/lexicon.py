"""Names of a lexicon in texts: behind attached prefixes, of several words, one letter off.

A text is its words with a blank between them.  A name stands in it if whole words in a row are the name; up to
``MOST_PREFIXES`` prefix letters may stand before it in the first word.  With ``near`` the words may also be one letter more,
less or other than a name of ``NEAR_FROM`` letters or more.  Of the names of a slot that holds with the fewest letters off, then
with the fewest prefix letters, then the longest, then the greatest.

A lexicon of a size that was checked goes to every task as a tree of its letters, for which each text is walked once; a larger one
meets the texts' pieces in a join (:func:`taktwerk.operators.messages.lexicon_slots`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.functions.text import squeezed

#: Letters that Hebrew puts before a word, and how many of them may stand in a row.
PREFIXES, MOST_PREFIXES = "והבלמשכ", 3
#: Names of fewer letters are not looked for with a letter off.
NEAR_FROM = 4
#: The lexicon that is sent to tasks has so many names and letters at most.
MOST_NAMES, MOST_LETTERS = 200_000, 4_000_000


def plain_words(text: Column) -> Column:
    """The words of a text in lower case with one blank between them."""
    return F.array_join(F.filter(F.split(squeezed(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")


class Names:
    """A tree of the letters of all names; a node is a dictionary of its letters, its name stands under the empty key."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for name in names:
            at = self.root
            for letter in name:
                at = at.setdefault(letter, {})
            at[""] = name

    def starting(self, text: str, start: int, near: bool) -> Iterator[tuple[str, int]]:
        """Names that begin at a place and end with a word, and how many letters they are off."""
        seen, n = set(), len(text)
        walk = [(self.root, start, 0)]
        while walk:
            node, at, off = walk.pop()
            name = node.get("")
            if name is not None and (at == n or text[at] == " ") and at > start and (off == 0 or len(name) >= NEAR_FROM) and (name, off) not in seen:
                seen.add((name, off))
                yield name, off
            letter = text[at] if at < n else None
            if letter in node:
                walk.append((node[letter], at + 1, off))
            if near and off == 0:
                if letter is not None:
                    walk.append((node, at + 1, 1))
                for other, child in node.items():
                    if other and letter is not None and other != letter:
                        walk.append((child, at + 1, 1))
                    if other:
                        walk.append((child, at, 1))


def found_in(text: str, names: Names, prefixes: str, near: bool) -> dict[str, tuple[int, int]]:
    """Each name of a text with the least letters it is off and prefix letters before it."""
    out: dict[str, tuple[int, int]] = {}
    at = 0
    for word in text.split(" ") if text else ():
        cut = 0
        while True:
            for name, off in names.starting(text, at + cut, near):
                out[name] = min(out.get(name, (off, cut)), (off, cut))
            if cut == MOST_PREFIXES or cut + 1 >= len(word) or word[cut] not in prefixes:
                break
            cut += 1
        at += len(word) + 1
    return out


def _rows(batches: Iterator[pa.RecordBatch], lexicon, prefixes: str, near: bool, key: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = lexicon.value
    names = Names(list(held))
    schema = pa.schema([*key, ("slot", pa.string()), ("canonical", pa.string()), ("variant", pa.string()), ("off", pa.int32()), ("cut", pa.int32())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own, best = tuple(row[f.name] for f in key), {}
            for name, (off, cut) in found_in(row["_words"], names, prefixes, near).items():
                for slot, canonical in held[name]:
                    rank = (off, cut, -len(name))
                    mine = best.get(slot)
                    if mine is None or rank < mine[0] or rank == mine[0] and (name, canonical) > mine[1]:
                        best[slot] = (rank, (name, canonical))
            out += [(*own, slot, canonical, name, off, cut) for slot, ((off, cut, _), (name, canonical)) in best.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def fits_a_task(lexicon: DataFrame) -> bool:
    """Whether a lexicon is small enough to be sent to every task; a text's letters are counted, not gathered."""
    n, letters = lexicon.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("variant") + F.length("canonical")), F.lit(0))).first()
    return n <= MOST_NAMES and letters <= MOST_LETTERS


def mentions(messages: DataFrame, key: list[str], lexicon: DataFrame, near: bool = False, prefixes: str = PREFIXES) -> DataFrame:
    """Per message and slot the name that holds: ``slot, canonical, variant, off`` (letters) and ``cut`` (prefix letters).

    ``lexicon`` has ``slot, variant, canonical``, and has to fit a task (:func:`fits_a_task`).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if not fits_a_task(lexicon):
        raise ValueError(f"a lexicon of more than {MOST_NAMES} names or {MOST_LETTERS} letters meets messages by a join: use lexicon_slots")
    held: dict[str, list[tuple[str, str]]] = {}
    for r in lexicon.select("slot", "canonical", plain_words(F.col("variant")).alias("variant")).where("variant <> '' AND slot IS NOT NULL").distinct().collect():
        held.setdefault(r.variant, []).append((r.slot, r.canonical))
    own = messages.select(*key, plain_words(F.col("text")).alias("_words"))
    kinds = own.select(*key).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "slot string, canonical string, variant string, off int, cut int"])
    lexicon_sent = messages.sparkSession.sparkContext.broadcast(held)
    return own.mapInArrow(partial(_rows, lexicon=lexicon_sent, prefixes=prefixes, near=near, key=to_arrow_schema(kinds)), schema)
