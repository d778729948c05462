"""What several groups of queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import evalcases, search
from taktwerk.sources.tables import shared_folder

#: Words of the given texts that stand for thanks, and for clearing a field.
STOP, CLEAR = ["thank", "stop"], [("day", ["the"]), ("time", ["und"]), ("category", ["eau"])]
SLOTS = ["day", "category", "start_after", "start_before"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def slots_of(t: Column) -> list[Column]:
    """Slots that a text sets, each with the number of its turn."""
    words = {"day": "er", "category": "ou", "start_after": "st", "start_before": "ei"}
    sign = {"day": "d", "category": "c", "start_after": "a", "start_before": "b"}
    return [F.when(F.contains(t, F.lit(words[s])), F.concat(F.lit(sign[s]), F.col("turn").cast("string"))).alias(s) for s in SLOTS]


def streamed(spark: SparkSession, sf: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over a table's files until all is read, and read what it wrote."""
    path = shared_folder(spark, "stream")
    source = spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")
    done = make(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def order_rows(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("ord"), F.when(k % 50 != 0, F.col("o_orderpriority")).alias("name"), F.when(k % 40 == 0, " ").otherwise("c").alias("center_name"),
        F.date_format("o_orderdate", "EEEE").alias("day"), F.when(k % 30 == 0, F.lit("25:00")).when(k % 31 != 0, F.format_string("%d:%02d", k % 24, k % 60)).alias("start_time"),
        F.when(k % 9 != 0, F.format_string("%d:%02d:00", (k + 1) % 25, k % 60)).alias("end_time"), (k % 130 - 5).cast("string").alias("min_age"),
        F.when(k % 17 == 0, "12.0").otherwise((k % 100).cast("string")).alias("max_age"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("instructor"),
        F.col("o_orderpriority").alias("location"),
    )


def parts_as_activities(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("day"), F.col("p_brand").alias("center_name"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).cast("string").alias("min_age"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 10).cast("string").alias("max_age"),
        F.when(F.col("p_size") % 7 == 0, "cancelled").alias("status"), F.format_string("%02d:%02d", F.col("p_size") % 24, F.col("p_size")).alias("start_time"),
        F.lit(None).cast("string").alias("english_name"), F.lit(None).cast("string").alias("category"),
    )


def requests(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        n.cast("long").alias("request_id"), F.when(n % 2 == 0, F.element_at(F.array(F.lit("red"), F.lit("BLUE "), F.lit("ring")), (n % 3 + 1).cast("int"))).alias("category"),
        F.when(n % 3 != 0, n * 2).alias("age"), F.when(n % 4 == 0, F.lit("economy")).when(n % 4 == 1, F.lit("small")).alias("day"),
        F.when(n % 5 == 0, F.lit("8:00")).alias("start_after"), F.when(n % 5 < 2, F.lit("17:30")).alias("start_before"), F.when(n % 6 == 5, F.lit("brand#1")).alias("center_name"),
    )


def eval_cases(spark, sf):
    q = requests(spark, sf)
    found = search.matches(parts_as_activities(spark, sf), q).select(F.col("request_id").alias("id"), "ord")
    cases = q.select(
        F.col("request_id").alias("id"), F.struct(F.when(F.col("request_id") % 3 == 0, "economy").alias("day"), F.when(F.col("request_id") % 2 == 0, "RED").alias("category_contains"), F.lit(5).alias("min_results")).alias("expected"),
        F.struct("day", "category").alias("observed"),
    )
    done = evalcases.evaluate(evalcases.result_counts(cases, found))
    return done.select("id", "result_count", F.size("failures").cast("long").alias("n_failures"), "passed")
