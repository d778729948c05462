"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every text gets counts from its own words and lines.  Besides, lines are normalised and
hashed, the distinct documents of a host that hold a line are counted, lines held by more
than a share of that host's documents (or, on large hosts, by more than a number of them)
are removed, and a document of which too little remains is rejected.

Defined results: a null text has no words and fails; a null host is a host of its own;
exact copies of a text on one host count as one document, so that copies never make a line
look like boilerplate; repeated rows each keep their own row; a null id is carried along;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import GAP, WORD, materialize, merged, packed, scratch, unpacked, with_text, words_of

#: Words in a row that count as a repeat when they stand twice in a text.
WINDOW = 8
#: A document needs so many words.
MIN_WORDS = 20
#: Of 100 words, so many may lie in repeated windows.
MAX_REPEAT_PERCENT = 30
#: A line is removed if more documents of its host hold it than either of these.
LINE_MIN_DOCS = 20
LINE_MAX_PERCENT = 20
#: The share stops growing at so many documents, however large the host is.
LINE_MANY_DOCS = 50
#: A document is depleted if less than this part of its words remains.
MIN_KEPT_PERCENT = 50

SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    """A line in lower case, white space as single blanks, trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, GAP, " ")))


def _pairs(values: Column, step: int) -> Column:
    """Hash each value together with the one ``step`` places later."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def text_counts(docs: DataFrame) -> DataFrame:
    """Add the counts of the text's own words and lines to a table with a column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.select(
        "*",
        words_of(F.col("text")).alias("_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    out = out.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w1"),
    ).drop("_words", "_lines")
    # Hashes of 2, 4 and then 8 words in a row, each from two of the step before.
    for step in (1, 2, 4):
        out = out.withColumn(f"_w{2 * step}", _pairs(F.col(f"_w{step}"), step)).drop(f"_w{step}")
    out = out.withColumn("_twice", F.size(F.array_distinct("_w8")) < F.size("_w8"))
    n = F.size("_w8")
    tagged = F.array_sort(F.zip_with("_w8", F.sequence(F.lit(0), n - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.col("_twice"), tagged)).drop("_w8", "_twice")
    both = F.zip_with(
        F.slice("_sorted", F.lit(1), F.size("_sorted") - 1),
        F.slice("_sorted", F.lit(2), F.size("_sorted") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    out = out.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.array_distinct(F.flatten(both))))).drop("_sorted")
    gaps = F.zip_with(
        F.slice("_at", F.lit(1), F.size("_at") - 1),
        F.slice("_at", F.lit(2), F.size("_at") - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_at").isNotNull(), covered), F.lit(0)).cast("long")).drop("_at")


def _host_key(host: Column) -> Column:
    """A string that is never null and keeps null apart from every host."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-"))


def _lines(text: Column) -> Column:
    """Per line that has a word, in order: the hash of its normal form and its number of words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return F.transform(
        lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_host_key(F.col("host")).alias("_host"), F.xxhash64("text").alias("_text"), "text")


def frequent_lines(docs: DataFrame, min_docs: int = LINE_MIN_DOCS, max_percent: int = LINE_MAX_PERCENT) -> DataFrame:
    """Lines above the limits: ``_host, line`` (hash), one row each.

    ``docs`` has ``text`` and ``host``.  A document is counted by the hash of its text.  A line is above the limits if
    more than ``min_docs`` documents of its host hold it, and these are more than ``max_percent`` of the host's documents
    or more than ``LINE_MANY_DOCS``.
    """
    keyed = _keyed(docs)
    held = keyed.select("_host", "_text", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: x["line"]))).alias("line")).distinct()
    sizes = materialize(keyed.select("_host", "_text").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs")), "host-docs")
    counts = held.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("_holders")).where(F.col("_holders") > min_docs)
    above = counts.join(sizes, "_host").where((F.col("_holders") * 100 > F.col("_docs") * max_percent) | (F.col("_holders") > LINE_MANY_DOCS))
    return above.select("_host", "line")


def removals(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Per text of a host that has lines above the limits: ``_host, _text, lines`` (their hashes), ``removed`` (words)."""
    each = _keyed(docs).select("_host", "_text", F.posexplode(_lines(F.col("text"))).alias("_pos", "_x"))
    hit = merged(each.select("_host", "_text", "_pos", "_x.line", "_x.n"), limits, ["_host", "line"])
    # Copies of a text on the same host give the same rows.
    hit = hit.groupBy("_host", "_text", "_pos").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    return hit.groupBy("_host", "_text").agg(F.collect_set("line").alias("lines"), F.sum("n").alias("removed"))


def _lost(own: DataFrame, min_docs: int, max_percent: int) -> DataFrame:
    with scratch(own.sparkSession) as keep:
        return keep(removals(own, materialize(frequent_lines(own, min_docs, max_percent), "frequent-lines")), "removals")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = LINE_MIN_DOCS,
    max_percent: int = LINE_MAX_PERCENT,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``n_words_kept`` and ``kept``."""
    own = with_text(docs, {"_id": id_col, "text": text_col, "host": host_col})
    lost = _lost(own, min_docs, max_percent)
    counts = text_counts(own.withColumn("_host", _host_key(F.col("host"))).withColumn("_text", F.xxhash64("text")))
    out = merged(counts.drop("text", "host"), lost.drop("lines"), ["_host", "_text"], "left")
    out = out.withColumn("n_words_kept", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fit = 100 * F.col("n_words_kept") >= min_kept_percent * F.col("n_words")
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & fit).alias("kept"), "n_words_kept",
    )


def filter_documents(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    chars_col: str = "n_chars",
    min_docs: int = LINE_MIN_DOCS,
    max_percent: int = LINE_MAX_PERCENT,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """The documents that pass, all columns, without the lines above the limits.

    ``chars_col``, if the table has it, becomes the length of the text that is left.
    """
    lost = _lost(with_text(docs, {"text": text_col, "host": host_col}), min_docs, max_percent)
    rows = docs.select(packed(docs).alias("_row"), docs[text_col].alias("text"), _host_key(docs[host_col]).alias("_host"))
    # The text goes along in its row alone.
    counts = text_counts(rows.withColumn("_text", F.xxhash64("text"))).select("_row", "_host", "_text", "n_words", "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = merged(counts, lost, ["_host", "_text"], "left")
    # One test over columns of both sides: tests of the counts alone would be moved below the
    # projections and compute these, each step twice, all over again.
    kept = F.col("n_words") - F.coalesce("removed", F.lit(0))
    least = F.lit(min_kept_percent) * F.col("n_words") + F.when(failed, 100 * F.col("n_words") + 1).otherwise(F.lit(0))
    text = F.col(f"_row.c{docs.columns.index(text_col)}")
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("lines", F.xxhash64(normal_line(x))))
    out = out.where(100 * kept >= least).withColumn("_new", F.when(F.col("lines").isNull(), text).otherwise(F.array_join(rest, "\n")))
    return out.select(*unpacked("_row", docs.columns, {text_col: F.col("_new"), chars_col: F.length("_new").cast("long")}))
