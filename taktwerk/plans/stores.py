"""Queries over sources and sinks: versions of a table, JSON arrays, records of no fixed shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.plans.common import shared_folder, table
from taktwerk.sources import arrays, records
from taktwerk.sources.versions import Versions


def dataset_versions(spark, sf):
    """A table before, after and behind a switch: a reader that began before keeps its version, a view follows when refreshed."""
    part = table(spark, sf, "part")
    versions = Versions(spark, shared_folder(spark, "versions"))
    view = "dataset_in_force"
    versions.publish(part.where("p_size % 3 <> 0"), "extracted")
    pinned, _ = versions.read(), versions.show_as(view)
    stale = spark.table(view)
    versions.publish(part.withColumn("p_brand", F.upper("p_brand")), "made up", after=1)
    current, _ = versions.read(), versions.show_as(view)
    fresh = spark.table(view)
    versions.switch(1)
    seen = {"pinned": pinned, "view_before": stale, "current": current, "view_after": fresh, "back": versions.read()}
    counted = [df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("long").alias("total")).select(F.lit(name).alias("reader"), "*") for name, df in seen.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def array_roundtrip(spark, sf):
    """Orders written as one array of records and read back."""
    path = f"{shared_folder(spark, 'array')}/orders.json"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.lit('"ש"\n')).alias("note"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    arrays.save_array(orders, path, ["o_orderkey"])
    return arrays.read_array(spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string, note string, o_orderdate string")


def loose_records(spark, sf):
    """Properties of events, some broken and some no objects, by their paths."""
    k = F.col("event_id")
    text = (
        F.when(k % 5 == 0, F.col("props")).when(k % 5 == 1, F.format_string('{"k": "%d", "tags": ["a", %d], "in": {"deep": %s}}', k, k % 3, (k % 2 == 0).cast("string")))
        .when(k % 5 == 2, F.lit('{"k": 1')).when(k % 5 == 3, F.format_string("[%d]", k)).when(k % 10 == 4, F.lit(None).cast("string")).otherwise(F.lit(""))
    )
    found = records.loose(table(spark, sf, "events").withColumn("raw", text), "raw", {"number": ("$.k", "long"), "tag": ("$.tags[1]", "int"), "deep": ("$.in.deep", "boolean")})
    return found.select("event_id", "state", "number", "tag", "deep", F.md5(records.as_text("value")).alias("text_md5"))


SQL = {
    "dataset_versions": """WITH a AS (SELECT p_brand, count(*) AS n, sum(p_size)::bigint AS total FROM part WHERE p_size % 3 <> 0 GROUP BY 1), b AS (SELECT upper(p_brand) AS p_brand, count(*) AS n, sum(p_size)::bigint AS total FROM part GROUP BY 1)
        SELECT reader, a.* FROM a, (VALUES ('pinned'), ('view_before'), ('back')) t(reader) UNION ALL SELECT reader, b.* FROM b, (VALUES ('current'), ('view_after')) t(reader)""",
    "array_roundtrip": """SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN '"ש"' || chr(10) END AS note, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""",
    "loose_records": """WITH e AS (SELECT event_id, event_id % 5 AS f, props FROM events)
        SELECT event_id, CASE f WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'broken' WHEN 3 THEN 'other' ELSE CASE WHEN event_id % 10 = 4 THEN 'null' ELSE 'broken' END END AS state,
               CASE f WHEN 0 THEN json_extract(props, '$.k')::bigint WHEN 1 THEN event_id END AS number, CASE f WHEN 1 THEN (event_id % 3)::int END AS tag, CASE f WHEN 1 THEN event_id % 2 = 0 END AS deep,
               md5(CASE f WHEN 0 THEN json(props)::varchar WHEN 1 THEN '{"in":{"deep":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '},"k":"' || event_id || '","tags":["a",' || (event_id % 3) || ']}' WHEN 3 THEN '[' || event_id || ']' END) AS text_md5 FROM e""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (dataset_versions, array_roundtrip, loose_records)}
