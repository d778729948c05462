"""Hashes of words and of any stretch of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from taktwerk.llm.common import sliced

#: Bytes of text that are hashed together.
CHUNK_BYTES = 4_000_000

_U = np.uint64
_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_Q_INVERSE = _U(pow(int(_Q), -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The word hashes of several texts in a row, and hashes of any stretch of words."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        visible = ~_SPACE[raw]
        edge = np.diff(np.concatenate(([0], visible.astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = ends - starts
        self.raw, self.starts, self.ends = raw, starts, ends
        if len(starts):
            # How far each byte stands behind the word start before it.
            from_start = np.repeat(starts, np.diff(np.append(starts, len(raw))))
            inside = np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - from_start))
            terms = _BYTE[raw] * _powers(_P, int(inside.max()) + 1)[inside]
            terms[~visible] = 0
            words = mix(np.add.reduceat(terms, starts) + n.astype(np.uint64))
        else:
            words = np.zeros(0, dtype=np.uint64)
        # Where each text's words begin: texts lie one blank apart.
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.begin = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        self.end = np.concatenate((self.begin[1:], [len(words)])) if len(texts) else self.begin
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_Q, len(words)), dtype=np.uint64)))
        self._inverse = _powers(_Q_INVERSE, len(words) + 1)

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the words a to b - 1, the same wherever they stand."""
        return mix((self._sums[b] - self._sums[a]) * self._inverse[a] + (b - a).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The text and the hash of every shingle of ``size`` words; a text of fewer words has one shingle, one of none has none."""
        n = self.end - self.begin
        times = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        owner = np.repeat(np.arange(len(n)), times)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        a = self.begin[owner] + within
        return owner, self.stretch(a, np.minimum(a + size, self.end[owner]))


def chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], lower: bool = False) -> Iterator[tuple[list[list], list[bytes]]]:
    """The columns (as lists) and the encoded texts of rows, a bounded number of bytes at once; a null text is empty.

    ``lower`` makes A to Z small and leaves other letters as they are.
    """
    rows: list[list] = [[] for _ in columns]
    texts: list[bytes] = []
    size = 0
    for batch in sliced(batches):
        held = [batch.column(c).to_pylist() for c in columns]
        for i, text in enumerate(batch.column("text")):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if texts and size + len(raw) > CHUNK_BYTES:
                yield rows, texts
                rows, texts, size = [[] for _ in columns], [], 0
            for column, values in zip(rows, held, strict=True):
                column.append(values[i])
            texts.append(raw.lower() if lower else raw)
            size += len(raw)
    if texts:
        yield rows, texts
