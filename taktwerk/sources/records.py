"""Records of no fixed shape: texts of JSON as variants, read by paths and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loose(df: DataFrame, text: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with ``value`` (a variant), ``state`` and a column for each path (name: path and type).

    ``state`` is ``null`` for a null text, ``broken`` for one that is no JSON, ``other`` for a value that is no object, else
    ``object``.  Broken rows stay, with their text.  A path that is not there, or whose value has another type, gives null.
    """
    value = F.try_parse_json(F.col(text))
    state = (
        F.when(F.col(text).isNull(), "null").when(F.col("value").isNull(), "broken")
        .when(~F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")), "other").otherwise("object")
    )
    out = df.withColumn("value", value)
    return out.select("*", state.alias("state"), *[F.try_variant_get("value", path, kind).alias(name) for name, (path, kind) in paths.items()])


def as_text(value: str) -> Column:
    """A variant as JSON, without white space; null stays null."""
    return F.to_json(F.col(value))
