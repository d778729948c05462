"""An index of short pieces that tells which texts stand inside which others, by joins of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.sources.tables import merged

#: Characters of a piece; shorter texts are one piece.
PIECE = 3


def _pieces(text: Column, size: Column) -> Column:
    """All stretches of ``size`` characters, each once."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``kind, needle, hay`` for all texts ``needle`` that stand inside a text ``hay`` of the same kind.

    Both tables have ``kind`` and ``text``, unique and not null.  A text is looked up under the one of its pieces that fewest
    others hold, and every find is compared in full; texts of fewer characters than a piece are looked up among pieces of their
    own length.  An empty text stands inside all of its kind.
    """
    few = F.least(F.length("text"), F.lit(PIECE))
    sizes = [F.when(F.length("text") >= n, _pieces(F.col("text"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, PIECE + 1)]
    held = hays.select("kind", F.col("text").alias("hay"), F.explode(F.concat(*sizes)).alias("piece"))
    counts = held.groupBy("kind", "piece").agg(F.count(F.lit(1)).alias("n"))
    asked = needles.where("text <> ''").select("kind", F.col("text").alias("needle"), F.explode(_pieces(F.col("text"), few)).alias("piece"))
    rarest = merged(asked, counts, ["kind", "piece"], "left").groupBy("kind", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    # A piece that no text holds rules its needle out.
    rarest = rarest.where("least.n > 0").select("kind", "needle", F.col("least.piece").alias("piece"))
    found = merged(rarest, held, ["kind", "piece"]).where(F.contains("hay", F.col("needle"))).select("kind", "needle", "hay")
    blank = needles.where("text = ''").select("kind", F.col("text").alias("needle")).join(hays.select("kind", F.col("text").alias("hay")), "kind")
    return found.unionByName(blank.select("kind", "needle", "hay"))
