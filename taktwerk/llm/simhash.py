"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

The 64 bits of the fingerprints are grouped into partitions, correlated bits together.  If two
fingerprints differ in at most ``d`` bits and the thresholds of ``m`` partitions sum to
``d - m + 1``, they differ in at most its threshold in one partition.  The thresholds are
allocated by dynamic programming on candidate counts that are estimated from the number of
equal pairs per partition over all fingerprints; a partition may be left out (threshold -1).
Every fingerprint stands under its own value of a partition, and, for a threshold above zero, also
under the values that differ in so many bits.  Fingerprints under one value are compared in
full; where more than ``MOST_TOGETHER`` stand under one value, they are dealt again by their other
bits with the same principle, so that the search stays exact and a task's work bounded.  Of
each value only a spanning forest of links comes out, and the components follow from those.

Equal fingerprints are one node throughout, so copies cost nothing.

Defined results: a null text counts as empty; texts without words have the fingerprint zero and
link like any other; texts with fewer words than a shingle have one shingle; a row whose id is
null takes part in links, and its component is the smallest id of the others, null if there are
none; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize, merged, packed, scratch, sliced, unpacked, with_text
from taktwerk.llm.components import connected_components
from taktwerk.llm.wordhash import Words, chunks

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Fingerprints that are compared with each other in one go.
MOST_TOGETHER = 4096
#: Cost of placing a fingerprint once more, against comparing one candidate.
PLACE_COST = 500.0


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included, as unsigned 64-bit numbers."""
    plain = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not plain:
        return np.zeros(0, dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(plain)]
    if len(starts) <= size:
        return np.array([xxhash.xxh64_intdigest(plain, SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(plain[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 16384):
        ones += np.unpackbits(raw[at : at + 16384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed number) of every document, written once."""
    own = with_text(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    return materialize(own.mapInArrow(_fingerprints(size), "id long, fp long"), "fingerprints")


# ---------------------------------------------------------------- plan


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set together, summed over the task."""
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        bits = _bits(batch.column("fp").to_numpy())
        total += (bits.T.astype(np.float64) @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "n"])


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def correlations(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the absolute correlation of each pair of bits, over all of them."""
    both = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    n = fps.count()
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return n, np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int, bits: list[int] | None = None) -> list[list[int]]:
    """Bits in ``parts`` groups of like size: each group grows by the bit that correlates most with it."""
    left = list(range(len(corr))) if bits is None else list(bits)
    out = []
    for k in range(parts, 0, -1):
        size = -(-len(left) // k)
        if not size:
            break
        group = [max(left, key=lambda b: (corr[b][left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b][group].mean(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """A group of bits as a signed 64-bit number."""
    return int.from_bytes(sum(1 << b for b in bits).to_bytes(8, "little"), "little", signed=True)


def equal_pairs(fps: DataFrame, groups: list[list[int]]) -> list[int]:
    """For each group, how many ordered pairs of fingerprints have equal bits there, themselves included."""
    masks = F.array(*[F.lit(mask_of(g)) for g in groups])
    each = fps.select(F.posexplode(masks).alias("k", "mask"), "fp").select("k", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    sums = each.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("n")).collect()
    found = {r["k"]: r["n"] for r in sums}
    return [found.get(k, 0) for k in range(len(groups))]


def allocate(n: int, widths: list[int], pairs: list[float], distance: int) -> tuple[float, list[int]]:
    """The least cost, and the thresholds that sum to ``distance - m + 1`` and have it, by dynamic programming.

    A threshold ``e`` puts each fingerprint under all values within ``e`` bits; each of these is
    taken to find as many candidates as its own value does.
    """
    m, target = len(widths), distance - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, equal in zip(widths, pairs, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for e in range(-1, min(width, distance) + 1):
                probes = sum(comb(width, j) for j in range(e + 1))
                at = cost + (PLACE_COST * n * probes + probes * equal if e >= 0 else 0.0)
                if done + e not in step or at < step[done + e][0]:
                    step[done + e] = (at, [*chosen, e])
        best = step
    assert m and target in best
    return best[target]


def plan(fps: DataFrame, distance: int = DISTANCE) -> tuple[np.ndarray, list[tuple[list[int], int]]]:
    """The bits' correlations, and the partitions with their thresholds: of a few numbers of partitions, the one that costs least."""
    n, corr = correlations(fps)
    numbers = sorted({-(-(distance + 1) // 2), -(-2 * (distance + 1) // 3), distance + 1})
    grouped = [group_bits(corr, m) for m in numbers]
    pairs = equal_pairs(fps, [g for groups in grouped for g in groups])
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for groups in grouped:
        own, pairs = pairs[: len(groups)], pairs[len(groups) :]
        cost, thresholds = allocate(n, [len(g) for g in groups], own, distance)
        if best is None or cost < best[0]:
            best = cost, list(zip(groups, thresholds, strict=True))
    assert best
    return corr, best[1]


# ---------------------------------------------------------------- probe and verify


def _probe_masks(group: list[int], threshold: int) -> list[int]:
    """What a value is changed by to reach every value within the threshold."""
    return [mask_of(list(c)) for j in range(threshold + 1) for c in combinations(group, j)]


def placements(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """``mask, value, fp, own``: every fingerprint under its own value of each partition, and under those it looks for."""
    out = None
    for group, threshold in partitions:
        if threshold < 0:
            continue
        flips = F.explode(F.array(*[F.lit(x) for x in _probe_masks(group, threshold)]))
        mask = mask_of(group)
        part = fps.select("fp", flips.alias("flip"))
        part = part.select(F.lit(mask).alias("mask"), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(mask)).alias("value"), "fp", (F.col("flip") == 0).alias("own"))
        out = part if out is None else out.unionByName(part)
    return out


def _near(own: np.ndarray, every: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Fingerprints of the first kind with near ones of any, and how far they are, in blocks."""
    step = max(1, 1_000_000 // max(1, len(every)))
    for at in range(0, len(own), step):
        far = np.bitwise_count((own[at : at + step, None] ^ every[None, :]).view(np.uint64))
        i, j = np.nonzero(far <= distance)
        differ = own[at + i] != every[j]
        yield own[at + i[differ]], every[j[differ]], far[i[differ], j[differ]]


def _nearest_forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of shortest links (Prim's): each step ties the nearest fingerprint that is left."""
    left = fps.copy()
    links = []
    while len(left):
        x, left = left[0], left[1:]
        best = np.full(len(left), 255, dtype=np.uint8)
        tied = np.full(len(left), x, dtype=np.int64)
        while len(left):
            far = np.bitwise_count((left ^ x).view(np.uint64))
            closer = far < best
            best[closer], tied[closer] = far[closer], x
            k = int(best.argmin())
            if best[k] > distance:
                break
            x = left[k]
            links.append((int(tied[k]), int(x)))
            left, best, tied = (np.delete(v, k) for v in (left, best, tied))
    return links


#: Of fingerprints with at most so many near ones each, every link comes out; of denser ones a forest.
FEW_NEAR = 3


def _links(distance: int):
    def of(mask: np.ndarray, value: np.ndarray, fps: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
        new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
        starts = np.concatenate(([0], new))
        ends = np.concatenate((new, [len(fps)]))
        sizes = ends - starts
        links: list[tuple[int, int]] = []
        # Values with two or three fingerprints, the most, are compared all at once.
        for gap in (1, 2):
            at = np.flatnonzero((sizes > gap) & (sizes <= 3))
            for shift in range(3 - gap):
                i = starts[at[sizes[at] > shift + gap]] + shift
                ok = i[np.bitwise_count((fps[i] ^ fps[i + gap]).view(np.uint64)) <= distance]
                links += zip(fps[ok].tolist(), fps[ok + gap].tolist(), strict=True)
        for a, b in zip(starts[sizes > 3].tolist(), ends[sizes > 3].tolist(), strict=True):
            every, mine = fps[a:b], fps[a:b][own[a:b]]
            found, dense = [], False
            for x, y, _ in _near(mine, every, distance):
                found += zip(x.tolist(), y.tolist(), strict=True)
                dense = dense or len(found) > 2 * FEW_NEAR * len(every)
                if dense:
                    break
            links += _nearest_forest(np.unique(every), distance) if dense else found
        return [(x, y) if x < y else (y, x) for x, y in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=bool)]
        for batch in batches:
            rows = [np.concatenate((k, batch.column(c).to_numpy(zero_copy_only=False))) for k, c in zip(kept, ("mask", "value", "fp", "own"), strict=True)]
            # The last value may go on in the next batch.
            open_at = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])) if len(rows[0]) else []
            cut = int(open_at[-1]) + 1 if len(open_at) else 0
            kept = [r[cut:] for r in rows]
            if cut:
                yield _batch(of(*[r[:cut] for r in rows]))
        if len(kept[0]):
            yield _batch(of(*kept))

    return run


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    links = [x for x in dict.fromkeys(links) if x[0] != x[1]]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_links(fps: DataFrame, distance: int = DISTANCE, most_together: int = MOST_TOGETHER) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (column ``fp``, distinct) which differ in at most ``distance`` bits."""
    corr, partitions = plan(fps, distance)
    placed = placements(fps, partitions)
    out = None
    while True:
        placed = materialize(placed, "placements")
        full = materialize(placed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_together).drop("n"), "full-values")
        few = merged(placed, full, ["mask", "value"], "left_anti")
        found = few.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_links(distance), "a long, b long")
        out = found if out is None else out.unionByName(found)
        masks = [r["mask"] for r in full.select("mask").distinct().collect()]
        if not masks:
            return out
        # Equal under the mask, so all differences lie in the other bits: deal by groups of those.
        subs = [(mask, mask_of(g)) for mask in masks for g in group_bits(corr, distance + 1, [b for b in range(BITS) if not mask >> b & 1])]
        if not subs:
            return out
        # As many rows as masks times groups, of which there are few.
        by_mask = F.broadcast(fps.sparkSession.createDataFrame(subs, "mask long, sub long"))
        part = merged(placed, full, ["mask", "value"], "left_semi").join(by_mask, "mask")
        placed = part.select(F.col("mask").bitwiseOR(F.col("sub")).alias("mask"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("sub"))).alias("value"), "fp", "own").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    fps = fingerprints(docs, id_col, text_col, size)
    with scratch(docs.sparkSession) as keep:
        classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
        tree = connected_components(near_links(classes.select("fp"), distance))
        labels = keep(component_ids(classes, tree), "labels")
    shown = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0")).alias("fingerprint")
    return merged(fps, labels, "fp").select(F.col("id").alias(id_col), shown, "component_id")


def component_ids(classes: DataFrame, tree: DataFrame) -> DataFrame:
    """``fp, component_id``: the smallest id (column ``least``) in the component of each node."""
    rooted = materialize(merged(classes, tree, classes["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return merged(rooted, least, "root").select("fp", "component_id")


# ---------------------------------------------------------------- similar texts

WORDS, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of two texts' words may differ to be tried at once: about what edits here and there change.
NEAR_BITS = 4
#: Shingles are ranked by how often those of their bucket stand in all texts, rare ones first; so many buckets
#: are counted, in blocks, whatever the input.  A shingle that stands out is one that is more frequent than the noise in a bucket.
BUCKETS = 1 << 22
BLOCK_BUCKETS = 1 << 16
#: Streams in which the counts of a block are added up before those of all streams are.
COUNT_STREAMS = 64
_U = np.uint64
#: A shingle's number takes 52 bits; its rank, of up to 11 bits, stands above these in the order.
_GRAM = 52
_GRAM_BITS = _U((1 << _GRAM) - 1)


def _grams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the number of every shingle; repeats included."""
    owner, hashes = Words(texts).shingles(size)
    return owner, hashes & _GRAM_BITS


def _once(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each text in order, each once."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    return owner[new], keys[new]


_COUNTS = "block int, stream int, counts binary"


def _count_rows(blocks: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for block, stream, counts in blocks:
        packed_counts = zlib.compress(counts.astype("<u8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([stream], pa.int32()), pa.array([packed_counts], pa.binary())], names=["block", "stream", "counts"])


def _bucket_counts(size: int):
    """How many shingles of the task fall into each bucket, by blocks of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, texts in chunks(batches, (), lower=True):
            total += np.bincount((_grams(texts, size)[1] & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        stream = TaskContext.get().partitionId() % COUNT_STREAMS
        yield from _count_rows((k, stream, part) for k, part in enumerate(total.reshape(-1, BLOCK_BUCKETS)) if part.any())

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows in order of block and stream."""

    def sums() -> Iterator[tuple[int, int, np.ndarray]]:
        at, total = None, None
        for batch in batches:
            for block, stream, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "stream", "counts")), strict=True):
                counts = np.frombuffer(zlib.decompress(raw), dtype="<u8").astype(np.int64)
                if at == (block, stream):
                    total += counts
                    continue
                if at:
                    yield *at, total
                at, total = (block, stream), counts
        if at:
            yield *at, total

    return _count_rows(sums())


def shingle_levels(texts: DataFrame, size: int = WORDS) -> np.ndarray:
    """For each bucket of shingles how frequent they are, in parts of 32 of a power of two: ``BUCKETS`` numbers, whatever the input."""
    counts = texts.select("text").mapInArrow(_bucket_counts(size), _COUNTS)
    for keys in (["block", "stream"], ["block"]):
        counts = counts.withColumn("stream", F.col("stream") if len(keys) == 2 else F.lit(0)).repartition(*keys).sortWithinPartitions("block", "stream").mapInArrow(_added, _COUNTS)
    out = np.zeros(BUCKETS, dtype=np.uint16)
    for r in counts.toLocalIterator():
        n = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype="<u8")
        out[r["block"] * BLOCK_BUCKETS : (r["block"] + 1) * BLOCK_BUCKETS] = np.minimum(2047, np.round(32 * np.log2(n + 1.0)))
    return out


def prefix_size(n: np.ndarray | Column, similarity: float = SIMILARITY):
    """Of ``n`` shingles, so many are the prefix: two texts of at least the similarity share one of these."""
    return n - (F.ceil if isinstance(n, Column) else np.ceil)(similarity * n - 1e-9) + 1


def prefixes(texts: list[bytes], levels: np.ndarray, size: int = WORDS, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and shingle of the first shingles of each text in the order of all (rare ones first), and of each text
    the number of its shingles and the place of the last of the first ones in that order.  Texts without shingles share a zero."""
    owner, grams = _grams(texts, size)
    owner, keys = _once(owner, (levels[(grams & _U(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << _U(_GRAM)) | grams)
    n = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = place < prefix_size(n, similarity)[owner]
    bare = np.flatnonzero(n == 0)
    owner, keys = np.concatenate((owner[first], bare)), np.concatenate((keys[first], np.zeros(len(bare), np.uint64)))
    last = np.zeros(len(texts), dtype=np.uint64)
    np.maximum.at(last, owner, keys)
    return owner, (keys & _GRAM_BITS).view(np.int64), n, last.view(np.int64)


def _prefixes(size: int, similarity: float, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hashes,), texts in chunks(batches, ("hash",), lower=True):
            owner, keys, _, _ = prefixes(texts, levels, size, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(hashes, dtype=np.int64)[owner])], names=["key", "hash"])

    return run


def _described(size: int, similarity: float, levels: np.ndarray):
    """The fingerprint of the set of words of each text, the number of its shingles and where its prefix ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hashes,), texts in chunks(batches, ("hash",), lower=True):
            owner, words = _once(*Words(texts).shingles(1))
            times = np.bincount(owner, minlength=len(texts))
            some = np.flatnonzero(times)
            fps = np.zeros(len(texts), dtype=np.int64)
            if len(some):
                bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, (np.cumsum(times) - times)[some], axis=0, dtype=np.int32)
                fps[some] = np.packbits(2 * ones > times[some, None], axis=1, bitorder="little").view("<i8").ravel()
            _, _, n, last = prefixes(texts, levels, size, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(fps), pa.array(n, pa.int64()), pa.array(last)], names=["hash", "fp", "n", "last"])

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hashes,), texts in chunks(batches, ("hash",), lower=True):
            owner, grams = _once(*_grams(texts, size))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.view(np.int64)))], names=["hash", "grams"])

    return run


def _enough(shared: Column, similarity: float) -> Column:
    """Whether texts (``x_n, x_last, y_n, y_last``) can have the similarity if they share at most ``shared`` shingles in
    the prefixes of both: what else they share lies behind the prefix that ends first."""
    behind = F.when(F.col("x_last") <= F.col("y_last"), F.col("x_n") - prefix_size(F.col("x_n"), similarity)).otherwise(F.col("y_n") - prefix_size(F.col("y_n"), similarity))
    return (shared + behind) * (1 + similarity) >= similarity * (F.col("x_n") + F.col("y_n")) - 1e-6


def _possible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs ``x, y, shared`` those whose texts can have the similarity if ``shared`` is the number of
    shingles in the prefixes of both."""
    for side in ("x", "y"):
        pairs = merged(pairs, texts.select(F.col("hash").alias(side), F.col("n").alias(f"{side}_n"), F.col("last").alias(f"{side}_last")), side)
    least, most = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    return pairs.where((least >= similarity * most - 1e-6) & _enough(F.col("shared"), similarity)).select("x", "y")


def _most(held: str, similarity: float) -> Column:
    """The most shingles that a similar text has, if only ``held`` of the first shingles of a text stand in another one."""
    others = F.col("n") - prefix_size(F.col("n"), similarity) + F.col(held)
    return F.floor(others * (1 + similarity) / similarity + 1e-6) - F.col("n")


def _shared_keys(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``shared`` of pairs ``x, y``: how many of the first shingles (rows ``key, hash``) both texts have."""
    ends = pairs.select(F.col("x").alias("hash")).unionByName(pairs.select(F.col("y").alias("hash"))).distinct()
    # A text's keys are fewer than its words.
    keys = materialize(merged(rows.select("key", "hash"), ends, "hash").groupBy("hash").agg(F.collect_list("key").alias("keys")), "prefix-keys")
    one = merged(pairs, keys.select(F.col("hash").alias("x"), F.col("keys").alias("p")), "x")
    both = merged(one, keys.select(F.col("hash").alias("y"), F.col("keys").alias("q")), "y")
    return both.select("x", "y", F.size(F.array_intersect("p", "q")).alias("shared"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("shared"))


def fingerprint_links(texts: DataFrame, distance: int = NEAR_BITS) -> DataFrame:
    """Links ``x, y`` of texts (columns ``hash, fp``) whose fingerprints are near, or the same."""
    classes = materialize(texts.groupBy("fp").agg(F.min("hash").alias("rep")), "text-classes")
    near = materialize(near_links(classes.select("fp"), distance).distinct(), "near-links")
    one = merged(near, classes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a")
    one = merged(one, classes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
    same = merged(texts, classes, "fp").where("hash <> rep").select(F.col("rep").alias("x"), F.col("hash").alias("y"))
    return one.unionByName(same)


def _verified(links: DataFrame, own: DataFrame, first: DataFrame, size: int, similarity: float) -> DataFrame:
    """The links ``x, y`` whose texts have the similarity by the shingles of both, as ``a, b``."""
    links = materialize(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "candidate-links")
    ends = links.select(F.col("x").alias("hash")).unionByName(links.select(F.col("y").alias("hash"))).distinct()
    wanted = materialize(merged(first, ends, "hash"), "candidate-texts")
    # By hash and id, so that many copies of one text are dealt to many tasks.
    once = merged(own, wanted, ["hash", "rid"]).groupBy("hash", "rid").agg(F.first("text").alias("text"))
    sets = materialize(once.select("hash", "text").mapInArrow(_shingle_sets(size), "hash long, grams array<long>"), "shingle-sets")
    one = merged(links, sets.select(F.col("hash").alias("x"), F.col("grams").alias("p")), "x")
    both = merged(one, sets.select(F.col("hash").alias("y"), F.col("grams").alias("q")), "y")
    shared = F.size(F.array_intersect("p", "q"))
    return both.where(shared >= similarity * (F.size("p") + F.size("q") - shared)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def similar_links(own: DataFrame, first: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, distance: int = NEAR_BITS) -> DataFrame:
    """Links ``a, b`` of texts (columns ``hash, rid, text``) that connect all pairs of at least ``similarity``, and no others.

    ``first`` has one ``hash, rid`` of each distinct text.  Texts whose fingerprints are near are
    tried first, and with them the texts under each shingle and the one of these that shares most, which ties copies
    of one base that are not alike to each other.  What these leave apart is found by shared shingles: two texts that are
    not yet in one component are tried if they share enough of the first shingles of both, so no pair is missed.
    """
    spark = own.sparkSession
    with scratch(spark) as keep:
        levels = shingle_levels(own, size)
        described = own.select("hash", "text").mapInArrow(_described(size, similarity, levels), "hash long, fp long, n long, last long")
        texts = keep(described.distinct(), "described-texts")
        # Made twice, as written out they would take as much room as the texts.
        every = own.select("hash", "text").mapInArrow(_prefixes(size, similarity, levels), "key long, hash long")
        shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most")
        shared = materialize(shared.select("key", "many"), "shared-keys")
        # Written before copies of a text are made one, so that Spark can split the rows of a frequent shingle.
        met = materialize(merged(every, shared, "key"), "shared-prefixes")
        rows = materialize(met.groupBy("key", "hash").agg(F.first("many").alias("many")), "text-prefixes")
        score = merged(rows.groupBy("hash").agg(F.sum("many").alias("sum"), F.count(F.lit(1)).alias("held")), texts, "hash")
        score = score.select("hash", (F.col("sum") / F.greatest("n", F.lit(1))).alias("score"), "n", "held").where(_most("held", similarity) >= similarity * F.col("n") - 1e-6)
        rows = keep(merged(rows.select("key", "hash"), score, "hash"), "scored-prefixes")
    with scratch(spark) as keep:
        pivots = materialize(rows.groupBy("key").agg(F.max(F.struct("score", "hash"))["hash"].alias("y")), "pivots")
        pairs = merged(rows.select("key", F.col("hash").alias("x")), pivots, "key").where("x <> y").select("x", "y")
        links = _possible(_counted(pairs), texts, similarity)
        # Texts that share none of their first shingles with another have no links.
        sharing = materialize(rows.select("hash").distinct(), "sharing-texts")
        near = merged(merged(fingerprint_links(texts, distance), sharing.select(F.col("hash").alias("x")), "x"), sharing.select(F.col("hash").alias("y")), "y")
        found = keep(_verified(links.unionByName(near), own, first, size, similarity), "verified-links")
        tree = connected_components(found)
        rows = keep(merged(rows, tree, rows["hash"] == tree["node"], "left").select("key", "hash", "n", F.coalesce("root", "hash").alias("comp")), "prefix-components")
    with scratch(spark) as keep:
        # Texts under a shingle that are all in one component need no further link; of two in different ones, one is not in the first.
        live = rows.groupBy("key").agg(F.min("comp").alias("main"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("many")).where("main <> most")
        rows = materialize(merged(rows, materialize(live.select("key", "main", "many"), "open-keys"), "key"), "open-prefixes")
        held = merged(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("held")), texts.select("hash", "last"), "hash")
        rows = merged(rows, held, "hash").withColumn("most", _most("held", similarity)).where(F.col("most") >= similarity * F.col("n") - 1e-6)
        # The shingles of a text from this one on, those that fewest texts hold first: the first one that two texts
        # share has all others that they share behind it in both, so they meet only where enough are left.
        rest = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("many"), F.desc("key")))
        rows = materialize(rows.withColumn("rest", rest), "possible-prefixes")
        side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("comp", "n", "last", "most", "rest")]
        left = rows.where("comp <> main").select("key", F.col("hash").alias("x"), *side("x"))
        right = rows.select("key", F.col("hash").alias("y"), *side("y"), "main")
        pairs = merged(left, right, "key").where("x_comp <> y_comp and (y_comp = main or x < y)")
        pairs = pairs.where((F.col("x_n") <= F.col("y_most")) & (F.col("y_n") <= F.col("x_most")) & _enough(F.least("x_rest", "y_rest"), similarity))
        pairs = materialize(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "meeting-pairs")
        links = _possible(_shared_keys(pairs, rows), texts, similarity)
        return found.unionByName(keep(_verified(links, own, first, size, similarity), "verified-links"))


def _texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``hash`` of the text, ``bare`` (no id), ``id``, ``rid`` (the id as a string that is never null) and ``text``."""
    own = with_text(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    return own.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.col("id").isNull().alias("bare"), "id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("rid"), "text")


def _groups(own: DataFrame, size: int, similarity: float, distance: int) -> DataFrame:
    """``hash, rank, component`` of every distinct text; the rank is that of its first document."""
    first = materialize(own.groupBy("hash").agg(F.min(F.struct("bare", "id", "rid")).alias("rank")), "texts")
    tree = connected_components(similar_links(own, first.select("hash", "rank.rid"), size, similarity, distance))
    return merged(first, tree, first["hash"] == tree["node"], "left").select("hash", "rank", F.coalesce("root", "hash").alias("component"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, distance: int = NEAR_BITS) -> DataFrame:
    """``hash, component`` of every distinct text: its hash, and the smallest hash of the texts that
    are tied to it by links of at least ``similarity`` (shared shingles by all shingles of both)."""
    with scratch(docs.sparkSession) as keep:
        return keep(_groups(_texts_of(docs, id_col, text_col), size, similarity, distance).select("hash", "component"), "groups")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, distance: int = NEAR_BITS) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, all columns; null ids come last.

    Of several rows with that id and text, the one with the smallest hash of all its columns stays.
    """
    with scratch(docs.sparkSession) as keep:
        groups = _groups(_texts_of(docs, id_col, text_col), size, similarity, distance)
        best = F.min(F.struct("rank", "hash")).alias("best")
        kept = keep(groups.groupBy("component").agg(best).select("best.hash", "best.rank.rid"), "kept-documents")
    # By text and id, so that many copies of one text are dealt to many tasks.
    rid = F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("")).alias("rid")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    held = docs.select(packed(docs).alias("held"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"), rid, F.xxhash64(*[docs[c] for c in plain]).alias("order"))
    first = merged(held, kept, ["hash", "rid"]).groupBy("hash", "rid").agg(F.min_by("held", "order").alias("held"))
    return first.select(*unpacked("held", docs.columns))
