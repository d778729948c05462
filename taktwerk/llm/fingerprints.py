"""Order-independent document fingerprints: a homomorphic hash of the multiset of paragraphs.

A text falls into paragraphs (see :func:`paragraphs`).  Each is hashed to a wide vector of
plus and minus ones, and a document's fingerprint is the sum of these vectors modulo 2**32.
Addition does not depend on order, and a paragraph can be added to or taken from a
fingerprint without the rest of the text (:func:`insert`, :func:`delete`, :func:`combine`).
As the sums of any text stay small against the modulus (a text has fewer than 2**31 paragraphs), the scalar product of two fingerprints
estimates how many paragraphs they share, which gives :func:`likeness`.

Defined results: a null text counts as empty; the empty text has no paragraphs and the zero
fingerprint; two empty texts have the likeness 1, an empty and another text 0; documents
whose id is null stand outside the order, and their next document is the document itself;
documents with the same id follow each other by text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import sliced, with_text

#: Entries of a vector: the bits of one digest.
WIDTH = 256
MODULUS = 2**32
#: A paragraph longer than this many code points is cut, counted from its start.
MOST_CHARS = 100
#: Documents that are in one group of neighbours, and the most groups that are told apart.
GROUP_DOCS = 500
MOST_GROUPS = 100_000
#: Groups that one task goes through.
TASK_GROUPS = 16

#: Rows that a group holds, takes as the start of the next one, and holds outside the order.
OWN, GUEST, ALONE = 0, 1, 2
ALONE_GROUPS = 997

_PARAGRAPH = re.compile(r"[^.!?\n]{0,%d}[.!?\n]+|[^.!?\n]{1,%d}" % (MOST_CHARS, MOST_CHARS))


def paragraphs(text: str | None) -> list[str]:
    """The pieces of a text, which together are the text: each ends after a newline or the end of
    a sentence, or after ``MOST_CHARS`` code points without either."""
    return _PARAGRAPH.findall(text or "")


def digest_sum(pieces: list[str]) -> np.ndarray:
    """The sum of the pieces' vectors, as integers."""
    if not pieces:
        return np.zeros(WIDTH, dtype=np.int64)
    digests = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=WIDTH // 8).digest() for p in pieces])
    total = np.zeros(WIDTH, dtype=np.int64)
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(-1, WIDTH // 8)
    for at in range(0, len(raw), 4096):
        part = raw[at : at + 4096]
        total += 2 * np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64) - len(part)
    return total


def insert(vector: np.ndarray, pieces: list[str]) -> np.ndarray:
    """The fingerprint vector with paragraphs added."""
    return (vector + digest_sum(pieces)) % MODULUS


def delete(vector: np.ndarray, pieces: list[str]) -> np.ndarray:
    """The fingerprint vector with paragraphs taken away."""
    return (vector - digest_sum(pieces)) % MODULUS


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint vector of two documents together."""
    return (a + b) % MODULUS


def to_hex(vector: np.ndarray) -> str:
    return (vector % MODULUS).astype("<u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype="<u4").astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """An estimate of twice the shared paragraphs over all paragraphs of both, from 0 to 1."""
    a, b = (((v + MODULUS // 2) % MODULUS - MODULUS // 2).astype(np.float64) for v in (a, b))
    if np.array_equal(a, b):
        return 1.0
    whole = float(a @ a + b @ b)
    return min(1.0, max(0.0, 2.0 * float(a @ b) / whole)) if whole else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, mine: np.ndarray, other: str, theirs: np.ndarray) -> tuple:
    new = edited(text, other)
    changed = digest_sum(paragraphs(new))
    return (
        doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        to_hex(mine), to_hex(changed), likeness(mine, changed), likeness(mine, theirs),
    )


_OUT = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_DDL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each document with the one after it; a group's guests, which come last, follow its last document."""
    group, waiting = None, None
    for batch in batches:
        columns = [batch.column(c) for c in ("grp", "kind", "id", "text")]
        for g, kind, doc_id, text in (tuple(c[i].as_py() for c in columns) for i in range(batch.num_rows)):
            text = text or ""
            if g != group:
                group, waiting = g, None
            if kind == GUEST and waiting is None:
                continue
            mine = digest_sum(paragraphs(text))
            if kind == ALONE:
                yield _row(doc_id, text, mine, text, mine)
                continue
            if waiting is not None:
                yield _row(waiting[0], waiting[1], waiting[2], text, mine)
            waiting = None if kind == GUEST else (doc_id, text, mine)


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in _rows(sliced(batches)):
        held.append(row)
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _OUT.types, strict=True)], schema=_OUT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _OUT.types, strict=True)], schema=_OUT)


def _grouped(limits: np.ndarray):
    """The smallest id of each group, for every batch of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            groups = np.searchsorted(limits, ids)
            order = np.lexsort((ids, groups))
            at = np.flatnonzero(np.diff(groups[order], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(groups[order][at], pa.int64()), pa.array(ids[order][at], pa.int64())], names=["grp", "first"])

    return run


def _dealt(limits: np.ndarray, hosts: dict[int, int]):
    """Every document in its group, and the first one of each group also as a guest of the group before."""
    heads = np.array(sorted(hosts), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            ids, text = batch.column("id"), batch.column("text")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            alone = -1 - (np.arange(n, n + len(values)) % ALONE_GROUPS)
            n += len(values)
            groups = np.where(known, np.searchsorted(limits, values), alone)
            kinds = np.where(known, OWN, ALONE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(kinds, pa.int32()), ids, text], names=["grp", "kind", "id", "text"])
            again = np.flatnonzero(known & np.isin(values, heads))
            if len(again):
                to = [hosts[int(v)] for v in values[again]]
                take = pa.array(again)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([GUEST] * len(to), pa.int32()), ids.take(take), text.take(take)], names=["grp", "kind", "id", "text"])

    return run


def with_neighbours(own: DataFrame) -> DataFrame:
    """``id, text`` dealt into ranges of ids: ``grp, kind, id, text``.

    Only ids are read to find the ranges; their limits and first ids, at most ``MOST_GROUPS`` of
    each, are all that comes to the driver.  The texts move once.
    """
    ids = own.select("id").where(F.col("id").isNotNull())
    n = ids.count()
    groups = min(MOST_GROUPS, max(1, n // GROUP_DOCS))
    cuts = [k / groups for k in range(1, groups)]
    found = ids.agg(F.percentile_approx("id", cuts, max(10_000, 20 * groups)).alias("c")).first()["c"] if cuts and n else []
    limits = np.array(sorted(set(found)), dtype=np.int64)
    first = {r["grp"]: r["first"] for r in ids.mapInArrow(_grouped(limits), "grp long, first long").groupBy("grp").agg(F.min("first").alias("first")).collect()}
    order = sorted(first)
    hosts = {first[g]: order[k - 1] for k, g in enumerate(order)}
    return own.mapInArrow(_dealt(limits, hosts), "grp long, kind int, id long, text string")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, the fingerprints of the text and of its edited form,
    the edited form's SHA-256, and the likeness to the edited form and to the next document."""
    own = with_text(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    # By the number of documents, so that tasks stay as small on more of them.
    tasks = max(1, own.count() // (GROUP_DOCS * TASK_GROUPS))
    dealt = with_neighbours(own).repartition(tasks, "grp").sortWithinPartitions("grp", "kind", "id", "text")
    return dealt.mapInArrow(_mapped, _DDL).withColumnRenamed("id", id_col)
