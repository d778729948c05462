"""Token ids as concatenated arrays with Elias-Fano coded document boundaries.

A file set is a Parquet table with one row per block of documents in ascending id order:

=============  =======================================================================
part, block    the block's place: range of ids, then number within it
before         ids of the earlier blocks of the part
n_docs, n_ids  documents and token ids in the block
doc_ids        the documents' ids, in order
width          bytes per token id, 2 or 4, little-endian in ``ids``
low_bits       low bits of each boundary kept as they are
low            these, packed
high           the other bits in unary: one set bit per boundary
ranks          32-bit counts of set bits before every 512 bits of ``high``
ids            the concatenated token ids
=============  =======================================================================

The boundaries are the ``n_docs + 1`` offsets 0 to ``n_ids``; they take about two bits and the
low bits each.  :meth:`EliasFano.select` finds any one from ``ranks`` and one 512-bit stretch.

Defined results: a null text counts as empty and gets the end id alone; null ids come first and
keep their rows; rows with one id stand next to each other; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import shared_folder, sliced, with_text
from taktwerk.llm.tokens import default_tokenizer_path, shared_encoder

END_ID = 0
#: A block ends with the document that brings it to so many token ids.
BLOCK_IDS = 1_000_000
_STRETCH = 512

SCHEMA = "part int, block int, before long, n_docs int, n_ids long, doc_ids array<long>, width int, low_bits int, low binary, high binary, ranks binary, ids binary"


class EliasFano:
    """A rising sequence of whole numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, ranks: bytes):
        self.n, self.low_bits = n, low_bits
        self._low = np.frombuffer(low, dtype=np.uint8)
        self._high = np.frombuffer(high, dtype=np.uint8)
        self._ranks = np.frombuffer(ranks, dtype="<u4")
        self.parts = (low, high, ranks)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        size = -(-((top >> low_bits) + n + 1) // _STRETCH) * _STRETCH
        unary = np.zeros(size, dtype=np.uint8)
        unary[(values >> low_bits) + np.arange(n)] = 1
        per = unary.reshape(-1, _STRETCH).sum(axis=1)
        ranks = (np.cumsum(per) - per).astype("<u4").tobytes()
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little").tobytes(), ranks)

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.int64)
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        raw = np.unpackbits(self._low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return raw.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The ``i``-th number, from one stretch of the unary bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = int(np.searchsorted(self._ranks, i, side="right")) - 1
        bits = np.unpackbits(self._high[k * _STRETCH // 8 : (k + 1) * _STRETCH // 8], bitorder="little")
        at = k * _STRETCH + int(np.flatnonzero(bits)[i - int(self._ranks[k])])
        return ((at - i) << self.low_bits) | int(self._lows(i, 1)[0])

    def all(self) -> np.ndarray:
        """Every number, in order."""
        at = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)) << self.low_bits) | self._lows(0, self.n)


def _block(part: int, block: int, before: int, doc_ids: list, sizes: list[np.ndarray], ids: list[np.ndarray]) -> tuple:
    n = np.concatenate(sizes)
    flat = np.concatenate(ids)
    ef = EliasFano.encode(np.concatenate(([0], np.cumsum(n))))
    width = 2 if not len(flat) or int(flat.max()) < 65536 else 4
    low, high, ranks = ef.parts
    return part, block, before, len(n), len(flat), doc_ids, width, ef.low_bits, low, high, ranks, flat.astype(f"<u{width}").tobytes()


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.binary()] * 4]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _encoded(path: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        part, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            row = _block(part, block, before, doc_ids, sizes, ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in sliced(batches, 3000):
            flat, n = with_end(*encoder.encode(batch.column("text").to_pylist()))
            names = batch.column("id").to_pylist()
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                # Up to the document that fills the block.
                done = int(ends[at - 1]) if at else 0
                to = min(len(n), int(np.searchsorted(ends, done + block_ids - held)) + 1)
                doc_ids += names[at:to]
                sizes.append(n[at:to])
                ids.append(flat[done : int(ends[to - 1])])
                held += int(ends[to - 1]) - done
                at = to
                if held >= block_ids:
                    yield flush()
                    before, block, held = before + held, block + 1, 0
                    doc_ids, sizes, ids = [], [], []
        if doc_ids:
            yield flush()

    return run


def with_end(flat: np.ndarray, n: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes with the end id after every document."""
    ends = np.cumsum(n)
    return np.insert(flat, ends, np.uint32(end_id)), n + 1


def write_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every document and write the file set."""
    own = with_text(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    # The hash parts rows that share an id, or have none, without changing the order of ids.
    own = own.withColumn("tie", F.xxhash64("text"))
    placed = own.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    blocks = placed.select("id", "text").mapInArrow(_encoded(tokenizer or default_tokenizer_path(), block_ids), SCHEMA)
    blocks.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)


def _decoded(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ef = EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["ranks"])
                at = ef.all()
                raw = memoryview(np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = at[:-1] + bases[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def part_bases(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids before each part: one number per part, of which there are as many as shuffle partitions."""
    sums = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    total, out = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in sums):
        out[part] = total
        total += n
    return out


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """From the files: every document with its place in the whole, its size and its ids' checksum."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    return blocks.mapInArrow(_decoded(part_bases(spark, path)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_spans(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the file set to the shared folder and read it back."""
    path = shared_folder(docs.sparkSession, "token-blocks")
    write_blocks(docs, path, tokenizer=tokenizer)
    return read_spans(docs.sparkSession, path)
