"""Repeated passages across documents by sparse suffixes at minimiser positions.

A passage counts as repeated if it is at least ``LENGTH`` words long and stands, word for word,
in a document with a smaller id.  Of all suffixes of a text only those are retained that begin at
a minimiser: the leftmost smallest hash of ``GRAM`` words among the ``LENGTH - GRAM + 1`` that lie in a
window of ``LENGTH`` words.  Equal windows have the same minimiser, so no repeat is missed, and only
about one suffix in sixteen remains.

Suffixes are dealt by the hash of their leading words, so that equal beginnings meet.  Those
whose beginning stands in one document only end there.  Of suffixes that agree in all words around as well (as far as a window
with this minimiser can reach to the left and right, by 128 bits of hash) the one of the smallest
id stands for all.  The others are put in order by their words, once to the right and once to the
left, and neighbours are compared: how many words they share tells where in the order blocks of suffixes end that
agree in so many words.  A window that begins ``l`` words left of the minimiser is repeated if a
document of a smaller id lies in the same block of ``l`` words to the left and in the same block of
``LENGTH - l`` words to the right.

Where more than ``MOST_TOGETHER`` suffixes have one beginning, they are dealt again by all words of each of their windows
(128 bits of hash), which Spark combines before it shuffles.

Defined results: documents whose text or id is null have no repeats and are none; words are
compared exactly, white space between them is not; repeats within one document do not count;
repeated rows, and other texts under the same id, are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize, merged, n_words_of, packed, scratch, unpacked, with_text
from taktwerk.llm.wordhash import Words, chunks, mix

LENGTH = 50
GRAM = 20
#: Suffixes with one beginning that one task puts in order.
MOST_TOGETHER = 20_000
#: Words in a stretch of text in which places are told apart by the low bits of a number.
STRETCH = 1 << 20

_U = np.uint64


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def minimisers(hashes: np.ndarray, width: int, stretch: int = STRETCH) -> np.ndarray:
    """Of each ``width`` neighbours the place of the smallest hash, the leftmost of equal ones."""
    mixed = mix(hashes ^ _U(0x9E3779B97F4A7C15))
    low = _U((1 << (stretch + width).bit_length()) - 1)
    out = []
    for at in range(0, len(hashes) - width + 1, stretch):
        part = mixed[at : at + stretch + width - 1]
        # The place in the low bits makes the leftmost of equal hashes the least.
        keyed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding_least(keyed, width) & low).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def retained(words: Words, length: int = LENGTH, gram: int = GRAM, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """Of each retained suffix: text, hash of its leading words, hash of its surroundings, its place, and the
    first and last start of a window that has its minimiser (all places from the text's first word)."""
    width = length - gram + 1
    total = int(words.end[-1]) if len(words.end) else 0
    if total < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    grams = np.arange(total - gram + 1)
    hashes = words.stretch(grams, grams + gram)
    least = minimisers(hashes, width, stretch)
    owner = np.repeat(np.arange(len(words.begin)), words.end - words.begin)
    starts = np.arange(total - length + 1)
    starts = starts[owner[starts] == owner[starts + length - 1]]
    at = least[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(owner[starts]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    at, low, high = at[first], starts[first], starts[last]
    text = owner[low]
    begin, end = words.begin[text], words.end[text]
    a, b = np.maximum(at - width + 1, begin), np.minimum(at + length, end)
    around = mix(words.stretch(a, b) + (at - a).astype(np.uint64))
    return text, hashes[at].view(np.int64), around.view(np.int64), at - begin, low - begin, high - begin


def _suffixes(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, ("id", "row")):
            text, lead, around, at, low, high = retained(Words(texts), length, gram)
            ids, keys = (np.array(r, dtype=np.int64)[text] for r in rows)
            columns = [pa.array(x) for x in (ids, keys, lead, around)] + [pa.array(x, pa.int32()) for x in (at, low, high)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "lead", "around", "at", "low", "high"])

    return run


_CONTEXT = "lead long, id long, row long, at int, low int, high int, words string"


def _contexts(length: int):
    """The words around each wanted suffix, as far as its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, keys, wanted), texts in chunks(batches, ("id", "row", "wanted")):
            words = Words(texts)
            raw = words.raw.tobytes()
            out: list[tuple] = []
            for doc_id, row, suffixes, begin in zip(ids, keys, wanted, words.begin.tolist(), strict=True):
                for s in suffixes:
                    a, b = words.starts[begin + s["low"]], words.ends[begin + s["high"] + length - 1]
                    out.append((s["lead"], doc_id, row, s["at"], s["low"], s["high"], b" ".join(raw[a:b].split()).decode("utf-8", "surrogatepass")))
            types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CONTEXT.split(", ")])

    return run


def _blocks(words: np.ndarray, depth: int) -> np.ndarray:
    """For 0 to ``depth`` words, the number of the block of rows that agree in so many of their first words.

    The rows are put in order, and each is compared with its neighbour; the first column is
    always to agree.
    """
    order = np.argsort(np.ascontiguousarray(words + 1, dtype=">u4").view(f"S{4 * words.shape[1]}").ravel(), kind="stable")
    differ = words[order[1:]] != words[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1]) - 1
    out = np.zeros((depth + 1, len(words)), dtype=np.int64)
    for n in range(depth + 1):
        out[n, order[1:]] = np.cumsum(shared < n)
    return out


def compare(lead: np.ndarray, ids: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, words: pa.Array, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last start, and kept id of the repeated windows of suffixes; ``words`` go from
    ``low`` to the end of the window that begins at ``high``."""
    reach = length - gram
    parts = pc.split_pattern(words, " ")
    codes = np.asarray(parts.flatten().dictionary_encode().indices)
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    middle = ends - (high + length - at)
    first = np.unique(lead, return_inverse=True)[1]

    def side(start: np.ndarray, step: int, most: int, have: np.ndarray) -> np.ndarray:
        k = np.arange(most)
        inside = k < have[:, None]
        where = np.where(inside, start[:, None] + step * k, 0)
        return np.concatenate((first[:, None], np.where(inside, codes[where], -1)), axis=1)

    right = _blocks(side(middle, 1, length, high + length - at), length)
    left = _blocks(side(middle - 1, -1, reach, at - low), reach)
    found = []
    for l in range(reach + 1):
        own = np.flatnonzero((at - l >= low) & (at - l <= high))
        key = right[length - l, own] * (len(ids) + 1) + left[l, own]
        order = np.lexsort((ids[own], key))
        own, key = own[order], key[order]
        if len(own):
            new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            kept = np.repeat(ids[own[new]], np.diff(np.append(new, len(own))))
            hit = kept < ids[own]
            found.append((own[hit], at[own[hit]] - l, kept[hit]))
    row, start, kept = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((start, row))
    row, start, kept = row[order], start[order], kept[order]
    # Starts in a row that have the same kept id are one stretch.
    new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(start) != 1) | (np.diff(kept) != 0)))) if len(row) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(row))[: len(new)] - 1
    return row[new], start[new], start[last], kept[new]


_FOUND = "id long, row long, low int, high int, kept long"


def _compared(length: int, gram: int):
    """Suffixes in order of ``lead``: those of whole beginnings are compared, a bounded number at once."""

    def of(table: pa.Table) -> pa.RecordBatch:
        lead, ids, keys, at, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("lead", "id", "row", "at", "low", "high"))
        row, first, last, kept = compare(lead, ids, at, low, high, table.column("words").combine_chunks(), length, gram)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row]), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(kept)], names=["id", "row", "low", "high", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= MOST_TOGETHER:
                lead = held.column("lead").to_numpy()
                # The last beginning may go on in the next batch.
                whole = int(np.searchsorted(lead, lead[-1]))
                if whole:
                    yield of(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield of(held)

    return run


def _windows(length: int):
    """The hash of all words of every window of the suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("id", "row", "low", "high", "words")}
            out = []
            for doc_id, row, low, high, text in zip(*columns.values(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split(b" ")
                out += [(doc_id, row, low + k, xxhash.xxh3_128_digest(b" ".join(words[k : k + length]))) for k in range(high - low + 1)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["id", "row", "start", "window"])

    return run


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = with_text(docs, {"id": id_col, "text": text_col})
    own = own.select(F.col("id").cast("long").alias("id"), "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return own.select("id", F.xxhash64("text").alias("row"), "text")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_together: int = MOST_TOGETHER) -> DataFrame:
    """Stretches of window starts that are repeats: ``id, row`` (hash of the text), ``low, high``
    and ``kept``, the id of an earlier document that has them: the smallest with the same context,
    or the smallest of those that stand for a context."""
    own = _own(docs, id_col, text_col)
    suffixes = materialize(own.mapInArrow(_suffixes(length, gram), "id long, row long, lead long, around long, at int, low int, high int"), "suffixes")
    shared = materialize(suffixes.groupBy("lead").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("lead"), "shared-leads")
    met = materialize(merged(suffixes, shared, "lead"), "met-suffixes")
    contexts = materialize(met.groupBy("lead", "around").agg(F.min("id").alias("kept")), "contexts")
    several = materialize(contexts.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several-contexts")
    placed = materialize(merged(met, contexts, ["lead", "around"]), "placed-suffixes")
    whole = placed.where("id > kept").select("id", "row", "low", "high", "kept")
    # One document of each context is compared by its words.
    edges = merged(placed.where("id = kept"), several, "lead").select("id", "row", F.struct("lead", "at", "low", "high").alias("suffix"))
    wanted = materialize(edges.groupBy("id", "row").agg(F.collect_set("suffix").alias("wanted")), "wanted-contexts")
    texts = merged(own, wanted, ["id", "row"]).mapInArrow(_contexts(length), _CONTEXT)
    texts = materialize(texts, "context-words")
    many = materialize(several.where(F.col("n") > most_together).select("lead"), "many-contexts")
    few = merged(texts, many, "lead", "left_anti")
    part = few.repartition("lead").sortWithinPartitions("lead").mapInArrow(_compared(length, gram), _FOUND)
    windows = materialize(merged(texts, many, "lead").mapInArrow(_windows(length), "id long, row long, start int, window binary"), "windows")
    least = materialize(windows.groupBy("window").agg(F.min("id").alias("kept"), F.max("id").alias("b")).where("kept < b").drop("b"), "window-firsts")
    more = merged(windows, least, "window").where("id > kept").select("id", "row", F.col("start").alias("low"), F.col("start").alias("high"), "kept")
    return whole.unionByName(part).unionByName(more)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_row: bool = False, most_together: int = MOST_TOGETHER) -> DataFrame:
    """One row per longest repeated passage: the document's id, ``first_word``, ``n_words``,
    ``kept_doc_ids``, earlier documents that have parts of it, and ``kept_doc_id``, the smallest of these."""
    with scratch(docs.sparkSession) as keep:
        found = repeated_windows(docs, id_col, text_col, length, gram, most_together)
        found = keep(found.groupBy("id", "row", "low", "high").agg(F.min("kept").alias("kept")), "repeats")
    before = Window.partitionBy("id", "row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("id", "row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.col("high") + length).withColumn("reach", F.max("end").over(before))
    found = found.withColumn("passage", F.sum(F.when(F.col("low") > F.col("reach"), 1).otherwise(0)).over(so_far))
    out = found.groupBy("id", "row", "passage").agg(
        F.min("low").alias("first_word"), (F.max("end") - F.min("low")).alias("n_words"), F.min("kept").alias("kept_doc_id"), F.sort_array(F.collect_set("kept")).alias("kept_doc_ids")
    )
    keys = [F.col("id").alias(id_col), "row"] if keep_row else [F.col("id").alias(id_col)]
    return out.select(*keys, F.col("first_word").cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"), "kept_doc_id", "kept_doc_ids")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, with repeated passages cut out; one of which no word is left goes.

    ``chars_col``, if the table has it, becomes the length of the text that is left.
    """
    with scratch(docs.sparkSession) as keep:
        passages = repeated_passages(docs, id_col, text_col, length, gram, keep_row=True)
        spans = passages.groupBy(F.col(id_col).alias("id"), F.col("row").alias("key")).agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"), F.sum("n_words").alias("covered"))
        spans = keep(spans, "passages")
    text = F.col(f"held.c{docs.columns.index(text_col)}")
    held = docs.select(packed(docs).alias("held"), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("key"))
    out = merged(held, spans, ["id", "key"], "left").withColumn("text", text)
    out = out.where(F.col("covered").isNull() | (n_words_of(F.col("text")) > F.col("covered")))
    out = out.withColumn("words", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))))
    # What lies between the passages: from the end of one to the start of the next.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["first_word"] + s["n_words"]))
    begins = F.concat(F.transform("spans", lambda s: s["first_word"]), F.array(F.size("words").cast("long")))
    rest = F.zip_with(ends, begins, lambda a, b: F.array_join(F.slice("words", (a + 1).cast("int"), (b - a).cast("int")), ""))
    out = out.withColumn("new", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(rest, "")))
    return out.select(*unpacked("held", docs.columns, {text_col: F.col("new"), chars_col: F.length("new").cast("long")}))
