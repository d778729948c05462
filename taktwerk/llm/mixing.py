"""Mixing sources to target weights over fixed-length blocks, in DataFrame functions only.

The words of each source, document after document in the order of a hash, are cut into
blocks of ``BLOCK`` words.  The mix has as many slots of a source as its target asks for.  Each
output shard has ``SHARD_SLOTS`` slots, and how many of them a source gets is a multinomial draw: every
slot draws its source with the sources' shares.  Running sums of these counts over the shards give a
source's slot numbers.  What a source was drawn beyond its slots is left out, and what it was drawn
short of comes in shards after the drawn ones, so that every source comes to its target.  Slots are
mapped to blocks by a pseudorandom permutation of the block numbers of the source, gone through once
or, if the target exceeds the source, twice; then slots and blocks are joined by number.

Defined results: a null text has no words, and nothing is taken from it; null is a source
like any other, last in order; repeated rows each stand for themselves; an empty table gives an
empty result; a source without words has the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize, merged, n_words_of, packed, scratch, unpacked, with_text

#: Words in a block, and slots in an output shard.
BLOCK = 128
SHARD_SLOTS = 512
#: Shards whose slots one task makes.
TASK_SHARDS = 128
#: Cells into which the sources' shares are cut to find the source of a draw.
CELLS = 4096
#: Weights of the sources by code point, in turn; the mix as a part of all words; the most a source is repeated.
WEIGHTS = (5, 2, 1)
MIX = 1.5
MOST = 2
#: Documents of one source whose places are counted up in one task; the order's first hex digits split larger sources.
GROUP_DOCS = 250
#: Sums of groups or shards that are added up in one task, before the sums of these are.
GROUP_SUMS = 4_096
#: Multipliers of the permutation: the first that does not divide the number of blocks. Fixed primes.
PRIMES = (1_000_003, 999_983, 999_979, 999_961)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size`` and the order ``key`` of every document, written once."""
    own = with_text(docs, {"id": id_col, "text": text_col, "source": source_col})
    return materialize(own.select("id", F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"), _key(F.col("id"), F.col("text")).alias("key")), "sizes")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, mix: float = MIX, most: float = MOST) -> DataFrame:
    """``source, source_size, target, blocks, slots``: one row per source.

    A target is ``min(most * source_size, level * weight)``.  With the sources in order of
    ``most * source_size / weight``, the level is what the capped ones before leave to the others;
    the first source at which that does not exceed its own ratio gives it.  The table has one row
    per source, so that the windows over all of it are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", rank.alias("rank"), weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.lit(float(mix)) * F.sum("source_size").over(everything) - before) / left)
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), "rank", "level"))).over(everything)["level"])
    per = per.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("level")), F.col("cap")))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * blocks + 0.5)).otherwise(F.lit(0)).cast("long")
    return materialize(per.select("source", "source_size", "target", blocks.alias("blocks"), slots.alias("slots"), "rank"), "targets")


def permute(df: DataFrame, x: str, n: str, seed: str) -> DataFrame:
    """Replace ``x`` in 0..n-1 by its image under a pseudorandom permutation of those numbers.

    Three times multiply and add modulo n, and between these an exclusive or of the number with its
    upper half, among the numbers below a power of two.  Each step is one to one.
    """
    factor = " ".join(f"WHEN {n} % {p} <> 0 THEN {p}L" for p in PRIMES)
    for turn in range(3):
        df = df.withColumn(x, F.expr(f"({x} * CASE {factor} END + ({seed} + {turn}) * 7919L + 104729L) % {n}"))
        if turn < 2:
            df = df.withColumn("_bits", F.expr(f"length(bin({n})) - 1"))
            df = df.withColumn(x, F.expr(f"CASE WHEN {x} < shiftleft(1L, _bits) THEN {x} ^ shiftright({x}, (_bits + 1) div 2) ELSE {x} END")).drop("_bits")
    return df


def summed_before(sums: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that come before by ``order``, a whole number.

    Stretches of ``GROUP_SUMS`` numbers are summed up by themselves, and then their sums.
    """
    sums = sums.withColumn("_stretch", F.expr(f"{order} div {GROUP_SUMS}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_all"))
    stretches = stretches.withColumn("_base", F.coalesce(F.sum("_all").over(before.partitionBy(*keys).orderBy("_stretch")), F.lit(0))).drop("_all")
    within = F.coalesce(F.sum(value).over(before.partitionBy(*keys, "_stretch").orderBy(order)), F.lit(0))
    joined = merged(sums.withColumn("_within", within), stretches, [*keys, "_stretch"])
    return joined.withColumn(out, F.col("_within") + F.col("_base")).drop("_within", "_base", "_stretch")


def placed(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Documents with their place in the source: ``start`` words stand before it.

    The order is that of ``key``.  Its leading digits split a source into groups of about
    ``GROUP_DOCS``; sums of the groups before come from a window over the groups alone.
    """
    groups = max(1, -(-sizes.count() // GROUP_DOCS))
    part = F.expr(f"cast(floor(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * {groups}L / 4294967296L) as bigint)")
    one = goal.select("source", "source_size", "target", "rank")
    # One row per source: few, so that Spark may broadcast them.
    rows = sizes.join(one, sizes["source"].eqNullSafe(one["source"])).select(sizes["*"], "source_size", "target", "rank", part.alias("part"))
    sums = rows.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    sums = materialize(summed_before(sums, ["rank"], "part", "words", "base").drop("words"), "group-words")
    within = Window.partitionBy("rank", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return merged(rows, sums, ["rank", "part"]).withColumn("start", F.col("_within") + F.col("base")).drop("_within", "base", "part")


def drawn_counts(goal: DataFrame, seed: int = 0) -> DataFrame:
    """``shard, rank, n``: how many slots of a shard each source is drawn for.

    Slot ``j`` of a shard draws a whole number below the number of all slots; the sources own as many of
    these numbers as they have slots, one after the other.
    """
    own = goal.where(F.col("slots") > 0).select("rank", "slots")
    total = own.agg(F.sum("slots")).first()[0] or 0
    shards = total // SHARD_SLOTS
    cell = max(1, total // CELLS)
    # One row per source, and one more for each cell that a share reaches into.
    shares = own.withColumn("end", F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    shares = shares.select("rank", (F.col("end") - F.col("slots")).alias("begin"), "end")
    shares = shares.select("*", F.explode(F.expr(f"sequence(begin div {cell}L, (end - 1) div {cell}L)")).alias("cell"))
    tasks = max(1, shards // TASK_SHARDS)
    slots = goal.sparkSession.range(0, shards, 1, tasks).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(SHARD_SLOTS - 1))).alias("slot"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("shard").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("long") % max(1, total)
    slots = slots.select("shard", draw.alias("draw")).withColumn("cell", F.expr(f"draw div {cell}L"))
    hit = slots.join(shares, "cell").where((F.col("draw") >= F.col("begin")) & (F.col("draw") < F.col("end")))
    return hit.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def source_counts(goal: DataFrame, seed: int = 0) -> DataFrame:
    """``shard, rank, base, n``: the slots ``base`` to ``base + n - 1`` of a source stand in a shard.

    These are the drawn counts up to the slots that a source has; the rest of its slots follows in
    shards after the drawn ones, each source with its own.
    """
    counts = materialize(summed_before(drawn_counts(goal, seed), ["rank"], "shard", "n", "base"), "drawn-counts")
    own = goal.where(F.col("slots") > 0).select("rank", "slots")
    drawn = counts.join(own, "rank").select("shard", "rank", "base", F.least("n", F.col("slots") - F.col("base")).alias("n")).where(F.col("n") > 0)
    have = counts.groupBy("rank").agg(F.sum("n").alias("have"))
    after = (own.agg(F.sum("slots")).first()[0] or 0) // SHARD_SLOTS
    left = own.join(have, "rank", "left").select("rank", "slots", F.coalesce("have", F.lit(0)).alias("have")).where("have < slots")
    # The places of all that is left, in order of the sources, tell its shards.
    left = left.withColumn("at", F.coalesce(F.sum(F.col("slots") - F.col("have")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = left.select("*", F.explode(F.expr(f"sequence(at div {SHARD_SLOTS}L, (at + slots - have - 1) div {SHARD_SLOTS}L)")).alias("k"))
    first = F.greatest(F.col("at"), F.col("k") * SHARD_SLOTS)
    end = F.least(F.col("at") + F.col("slots") - F.col("have"), (F.col("k") + 1) * SHARD_SLOTS)
    rest = left.select((F.col("k") + after).alias("shard"), "rank", (F.col("have") + first - F.col("at")).alias("base"), (end - first).alias("n"))
    return materialize(drawn.unionByName(rest), "source-counts")


def slots(goal: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: one row per slot, ``rank`` (of the source), ``turn``, ``block`` and ``shard``."""
    counts = source_counts(goal, seed)
    shards = counts.agg(F.max("shard")).first()[0] or 0
    counts = counts.join(goal.select("rank", "blocks"), "rank")
    # The number keeps Spark from putting the few rows, which grow five hundredfold, into one task.
    each = counts.repartition(max(1, shards // TASK_SHARDS), "rank", "shard")
    each = each.select("rank", "blocks", "shard", F.explode(F.expr("sequence(base, base + n - 1)")).alias("slot"))
    each = each.select("rank", "blocks", "shard", F.expr("slot div blocks").alias("turn"), F.expr("slot % blocks").alias("block"))
    return permute(each, "block", "blocks", f"(rank * 31L + {seed}L)").select("rank", "turn", "block", "shard")


def block_parts(rows: DataFrame) -> DataFrame:
    """What each block holds: the rows of :func:`placed` with ``block``, ``first`` (word in the document) and ``n``."""
    spans = rows.where(F.col("size") > 0).select("*", F.explode(F.expr(f"sequence(start div {BLOCK}L, (start + size - 1) div {BLOCK}L)")).alias("block"))
    first = F.greatest(F.lit(0).cast("long"), F.col("block") * BLOCK - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * BLOCK - F.col("start"))
    return spans.select("*", first.alias("first"), (end - first).alias("n"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target`` of its source, ``taken`` words,
    ``n_blocks`` (slots that hold some of its words) and the first and the last of their shards (null if nothing is taken)."""
    with scratch(docs.sparkSession) as keep:
        sizes = sized(docs, id_col, text_col, source_col)
        goal = targets(sizes)
        rows = keep(placed(sizes, goal), "placed")
        times = slots(goal, seed).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("first"), F.max("shard").alias("last"))
        got = merged(block_parts(rows).drop("first"), times, ["rank", "block"], "left")
        keys = ["id", "size", "source_size", "target"]
        # A document with words is told apart from its copies by where it starts.
        got = got.groupBy(*keys, "rank", "start").agg(
            F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"), F.sum(F.coalesce("times", F.lit(0))).alias("n_blocks"),
            F.min("first").alias("first_shard"), F.max("last").alias("last_shard"),
        )
        got = keep(got.drop("rank", "start"), "mixed")
    none = F.lit(0).cast("long")
    bare = rows.where(F.col("size") == 0).select(*keys, none.alias("taken"), none.alias("n_blocks"), F.lit(None).cast("long").alias("first_shard"), F.lit(None).cast("long").alias("last_shard"))
    return got.unionByName(bare).withColumnRenamed("id", id_col)


def _key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mix as documents, all columns: each with the words taken of it, in its order.

    A document of which words are taken a second time comes a second time; one of which no word
    is taken does not come.  White space after a taken word stays as it was.
    """
    with scratch(docs.sparkSession) as keep:
        sizes = sized(docs, id_col, text_col, source_col)
        goal = targets(sizes)
        rows = materialize(placed(sizes, goal), "placed")
        parts = merged(block_parts(rows), slots(goal, seed), ["rank", "block"])
        # Copies of one row are alike: what is taken of the n-th of them goes to the n-th.
        order = Window.partitionBy("key").orderBy("start")
        numbered = rows.where(F.col("size") > 0).select("key", "start", "rank", "size", F.row_number().over(order).alias("nth"))
        taken = parts.groupBy("rank", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("spans"), F.sum("n").alias("n"))
        taken = merged(taken, numbered, ["rank", "start"]).select("key", "nth", "turn", "spans", (F.col("n") == F.col("size")).alias("whole"))
        taken = keep(taken, "taken")
    names = docs.columns
    held = docs.select(packed(docs).alias("row"), _key(docs[id_col], docs[text_col]).alias("key"))
    held = held.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    text = F.col(f"row.c{names.index(text_col)}")
    each = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    # Joined by the key alone, by which the numbering has dealt the texts already: they move once.
    taken = taken.select(F.col("key").alias("_key"), F.col("nth").alias("_nth"), "turn", "spans", "whole")
    out = merged(held, taken, (F.col("key") == F.col("_key")) & (F.col("nth") - F.col("_nth") == 0)).withColumn("words", F.when(~F.col("whole"), each))
    cut = F.array_join(F.transform("spans", lambda s: F.array_join(F.slice("words", (s["first"] + 1).cast("int"), s["n"].cast("int")), "")), "")
    out = out.withColumn("new", F.when(F.col("whole"), text).otherwise(cut))
    return out.select(*unpacked("row", names, {text_col: F.col("new"), chars_col: F.length("new").cast("long")}))
