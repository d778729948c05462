"""Packing documents into sequences of bounded length by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths).  Pieces come in order of falling length; each goes to an open sequence in which
it fits in every capacity, chosen by the smallest weighted norm of what would be left
(``rule="norm"``) or the largest weighted scalar product of what is left and what is needed
(``rule="dot"``); if there is none, a new sequence is opened.

Pieces are dealt into groups of about ``GROUP_PIECES`` by a lot that is drawn when they are
written, and each group is packed by itself: a group wastes less than one sequence more than
the whole would.  Only lengths move, never texts.

Defined results: a null text counts as empty and gives one piece with the end id; repeated rows
and null ids are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize, sliced, with_text
from taktwerk.llm.elias_fano import with_end
from taktwerk.llm.tokens import CACHE_PIECES, CHUNK_CHARS, BatchEncoder, default_tokenizer_path, shared_encoder

LENGTH = 2048
GROUP_PIECES = 8192
#: Weights of the three capacities in the choice of a sequence, each as a part of its whole.
WEIGHTS = (1.0, 0.05, 0.05)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all of full length but for the first."""
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def vector_best_fit(
    lengths: np.ndarray,
    tokens: int = LENGTH,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> np.ndarray:
    """The number of the sequence of each piece; ``None`` for a capacity that the tokens already bound.

    A piece that is above a capacity by itself gets a sequence of its own.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.zeros(len(lengths), dtype=np.int64)
    caps = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    needs = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1) / caps
    order = np.argsort(-lengths, kind="stable")
    least = np.minimum.accumulate(needs[order][::-1], axis=0)[::-1] if len(order) else needs
    left = np.zeros((len(lengths), 3))
    opened = np.zeros(len(lengths), dtype=np.int64)
    n_open = bins = 0
    tiny = 1e-12
    for turn, i in enumerate(order.tolist()):
        need = needs[i]
        if n_open and turn % 64 == 0:
            # Sequences that no later piece fits into are closed.
            keep = np.all(left[:n_open] >= least[turn] - tiny, axis=1)
            n_keep = int(keep.sum())
            left[:n_keep], opened[:n_keep] = left[:n_open][keep], opened[:n_open][keep]
            n_open = n_keep
        rest = left[:n_open] - need
        fits = np.flatnonzero(rest.min(axis=1) >= -tiny) if n_open else ()
        if len(fits):
            score = -(rest[fits] ** 2 @ w) if rule == "norm" else left[fits] @ (w * need)
            k = int(fits[int(np.argmax(score))])
            left[k] = rest[k]
            out[i] = opened[k]
        else:
            out[i] = bins
            after = 1.0 - need
            if after.min() >= 0 and np.all(after >= least[-1] - tiny):
                left[n_open], opened[n_open] = after, bins
                n_open += 1
            bins += 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 63 bits, each to another."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(1)).astype(np.int64)


def _pieces(path: str, length: int, cache_pieces: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = cache_pieces >= CACHE_PIECES and chunk_chars >= CHUNK_CHARS
        encoder = shared_encoder(path) if usual else BatchEncoder(path, cache_pieces, chunk_chars)
        made = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, 3000):
            flat, n = with_end(*encoder.encode(batch.column("text").to_pylist()))
            raw = memoryview(np.ascontiguousarray(flat, dtype="<u4").tobytes())
            rows = []
            at = 0
            for doc_id, size in zip(batch.column("id").to_pylist(), n.tolist(), strict=True):
                for k, (start, m) in enumerate(cut(size, length)):
                    rows.append((doc_id, k, start, m, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + m)])))
                at += size
            lots = _mixed(np.arange(made, made + len(rows)))
            made += len(rows)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lots)], names=["doc_id", "piece", "start", "length", "ids_crc32", "lot"])

    return run


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, cache_pieces: int = CACHE_PIECES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per piece of each document, written once; ``cache_pieces`` bounds what a task
    remembers of the tokenizer's work and ``chunk_chars`` the characters it handles at once, and
    less than the usual number is forgotten at its end."""
    own = with_text(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    pieces = own.mapInArrow(_pieces(tokenizer or default_tokenizer_path(), length, cache_pieces, chunk_chars), "doc_id long, piece int, start long, length long, ids_crc32 long, lot long")
    return materialize(pieces, "pieces")


def pack_pieces(pieces: DataFrame, length: int = LENGTH, documents: int | None = None, attention: int | None = None, weights: tuple = WEIGHTS, rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with ``length`` and ``lot``."""
    groups = max(1, round(pieces.count() / group_pieces))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lot"]).reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        which = np.zeros(len(rows), dtype=np.int64)
        part = sizes < length
        which[part] = vector_best_fit(sizes[part], length, documents, attention, weights, rule)
        which[~part] = (which[part].max() + 1 if part.any() else 0) + np.arange(int((~part).sum()))
        rows["sequence_id"] = (rows["grp"].to_numpy() << 24) + which
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("grp", F.pmod(F.col("lot"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, cache_pieces: int = CACHE_PIECES, chunk_chars: int = CHUNK_CHARS, **limits) -> DataFrame:
    """Cut documents into pieces and pack them."""
    return pack_pieces(document_pieces(docs, id_col, text_col, tokenizer, length, cache_pieces, chunk_chars), length, **limits)
