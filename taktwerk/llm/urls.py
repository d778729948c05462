"""URL rules by a sort-merge range join, in DataFrame functions only.

A host is turned round label by label (``www.example.com`` becomes ``com.example.www.``), so that a rule's host and all
its subdomains are the keys that begin with the rule's key: one interval.  Intervals of such prefixes nest or are apart.
Rules open and close at the ends of their intervals; in the order of the keys a running sum of these events is the
height of the stack of active rules, and the stack's entry at a height is the rule that opened last there.  A URL among
the events finds its whole stack in its own row, and the path decides between the rules on it.

The sweep is cut into key ranges, each one task; what is open at a range's start comes from the ranges before it, in a
table of one row a range.  A range that holds more than its share of the URLs (one hot host) is dealt to several tasks,
each of which gets the range's rules.  The cut points come from a sample of bounded size; they decide where work is done,
not what comes out.  Rules are a table of any size and never broadcast; a host with many path rules is swept a second time.

Defined results: a null URL or one without ``://`` has an empty host and path; of two rules with the same host and path
``block`` holds; a rule with a null host, path or verdict fits nothing; repeated rows each keep their own row; a null id is
carried along; an empty table gives an empty result, and without rules every URL gets the default.
"""

from __future__ import annotations

import string
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize

#: Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What a URL gets that no rule fits.
DEFAULT = "allow"
#: A host with more path rules than this is swept by path; fewer are compared where the host's stack is at hand.
INLINE_PATHS = 16
#: Keys that are drawn of either side to place the cuts, and bytes that are looked at of each.
SAMPLE_KEYS, CUT_BYTES = 10_000, 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z made small) and path of a URL; both empty where there is no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def host_key(host: Column) -> Column:
    """The labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``verdict, host, path`` of rules that are given as tuples."""
    schema = "array<struct<verdict:string,host:string,path:string>>"
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in ("verdict", "host", "path")])
    each = F.array(*[F.struct(*[F.lit(x).cast("string") for x in rule]) for rule in rules]).cast(schema)
    return spark.range(1).select(F.inline(each))


class _Ranges:
    """Cut points over binary keys, and how many tasks each range between them is dealt to."""

    def __init__(self, sample: list[bytes], n: int):
        keys = sorted(sample)
        self.cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
        share = [0] * (len(self.cuts) + 1)
        for key in keys:
            share[bisect_right(self.cuts, key)] += 1
        self.deals = [max(1, round(x * n / max(1, len(keys)))) for x in share]

    def range_of(self, key: Column) -> Column:
        """The number of cuts up to a key: first among every ``step``-th, then among those behind it."""
        if not self.cuts:
            return F.lit(0)
        step = max(1, int(len(self.cuts) ** 0.5))
        blocks = [self.cuts[i : i + step] for i in range(0, len(self.cuts), step)]
        among = lambda cuts: F.size(F.filter(cuts, lambda c: c <= key))
        block = among(F.array(*[F.lit(bytearray(b[0])) for b in blocks]))
        own = F.get(F.array(*[F.array(*[F.lit(bytearray(c)) for c in b]) for b in blocks]), block - 1)
        return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + among(own))

    def deals_of(self, rng: Column) -> Column:
        return F.get(F.array(*[F.lit(d) for d in self.deals]), rng)


def _drawn(df: DataFrame, key: str) -> list[bytes]:
    n = df.count()
    keys = df.select(F.substring(key, 1, CUT_BYTES).alias("k"))
    return [bytes(r.k) for r in (keys if n <= SAMPLE_KEYS else keys.sample(SAMPLE_KEYS / n, 7)).collect()]


def _events(rules: DataFrame, ranges: _Ranges) -> DataFrame:
    """``rng, key, height, load``: each rule's opening (with its load) and closing, and how many are open after it."""
    # Nothing in UTF-8 has the byte 255: behind a prefix it follows all that begins with the prefix.
    closing = F.concat("key", F.unhex(F.lit("FF")))
    both = rules.select("key", F.lit(1).alias("step"), "load").unionByName(
        rules.select(closing.alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(rules.schema["load"].dataType).alias("load"))
    )
    events = materialize(both.select(ranges.range_of(F.col("key")).alias("rng"), "key", "step", "load"), "rule-events")
    totals = events.groupBy("rng").agg(F.sum("step").alias("total"))
    before = totals.select("rng", F.coalesce(F.sum("total").over(Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.sum("step").over(Window.partitionBy("rng").orderBy("key"))
    # One row a range.
    return events.join(F.broadcast(before), "rng").select("rng", "key", (running + F.col("before")).cast("int").alias("height"), "load")


def with_stack(points: DataFrame, key: Column, rules: DataFrame) -> DataFrame:
    """The rows with a column ``stack``: the loads of the rules whose key is a prefix of the row's key, the shortest first.

    ``rules`` has ``key`` (string, unique) and ``load`` (a struct).  A row whose key is null has an empty stack.
    """
    spark = points.sparkSession
    rules = rules.select(F.col("key").cast("binary").alias("key"), "load")
    load = rules.schema["load"].dataType
    none = F.lit(None).cast(load)
    row = F.struct(*[points[c].alias(f"c{i}") for i, c in enumerate(points.columns)])
    keyed = points.select(F.coalesce(key, F.lit("")).cast("binary").alias("key"), key.isNotNull().alias("fits"), row.alias("row"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = _Ranges(_drawn(keyed, "key") + _drawn(rules, "key"), n)
    events = materialize(_events(rules, ranges), "rule-heights")
    depth = events.agg(F.max("height")).first()[0] or 0
    levels = [f"s{d}" for d in range(1, depth + 1)]
    opened = [F.col("load").isNotNull() & (F.col("height") == d) for d in range(1, depth + 1)]

    last = events.groupBy("rng").agg(F.max_by("height", "key").alias("height"), *[F.max_by(F.when(o, F.col("load")), F.when(o, F.col("key"))).alias(s) for o, s in zip(opened, levels, strict=True)])
    earlier = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    all_ranges = spark.range(len(ranges.deals)).select(F.col("id").cast("int").alias("rng"))
    start = all_ranges.join(F.broadcast(last), "rng", "left").select(
        "rng", F.lit(bytearray()).alias("key"), F.lit(0).alias("kind"),
        *[F.last(c, True).over(earlier).alias(c) for c in ("height", *levels)],
    )
    opens = events.select("rng", "key", F.lit(1).alias("kind"), "height", *[F.when(o, F.col("load")).alias(s) for o, s in zip(opened, levels, strict=True)])
    everywhere = start.unionByName(opens).withColumn("deal", F.explode(F.sequence(F.lit(0), ranges.deals_of(F.col("rng")) - 1)))
    placed = keyed.withColumn("rng", ranges.range_of(F.col("key")))
    placed = placed.select(
        "rng", F.pmod(F.xxhash64("row"), ranges.deals_of(F.col("rng")).cast("long")).cast("int").alias("deal"), "key", F.lit(2).alias("kind"),
        F.lit(None).cast("int").alias("height"), *[none.alias(s) for s in levels], "fits", "row",
    )
    swept = Window.partitionBy("rng", "deal").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = placed.unionByName(everywhere, allowMissingColumns=True)
    both = both.select("fits", "row", *[F.last(c, True).over(swept).alias(c) for c in ("height", *levels)]).where(F.col("row").isNotNull())
    height = F.when(F.col("fits"), F.coalesce("height", F.lit(0))).otherwise(F.lit(0))
    stack = F.slice(F.array(*levels), F.lit(1), height) if levels else F.array().cast(f"array<{load.simpleString()}>")
    return both.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(points.columns)], stack.alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: its id, ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null), ``verdict``.

    Rules have ``verdict, host, path``.  One fits its host and all subdomains if the path begins with the rule's; the one with the
    longest host decides, then the one with the longest path.
    """
    spark = pages.sparkSession
    host, path = host_and_path(pages[url_col])
    points = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rules = rule_table(spark) if rules is None else rules
    each = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    each = materialize(each.select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict"), "rules")
    one = F.struct("path", "rule", "verdict")
    # Hosts with few path rules carry these along; a host with many carries none and its paths are swept.
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = each.join(counted.where(F.col("n") <= INLINE_PATHS).hint("merge"), "key", "left_semi").groupBy("key").agg(F.collect_list(one).alias("paths"))
    wide = counted.where(F.col("n") > INLINE_PATHS).select("key", F.lit(None).cast("array<struct<path:string,rule:string,verdict:string>>").alias("paths"))
    hosts = few.unionByName(wide).select("key", F.struct("key", "paths").alias("load"))
    out = with_stack(points, host_key(F.col("host")), hosts)

    found = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fit = lambda paths: F.filter(paths, lambda p: F.startswith(F.col("path"), p["path"]))
    longest = lambda paths: F.array_max(F.transform(fit(paths), lambda p: F.struct(F.length(p["path"]).alias("n"), p["rule"].alias("rule"), p["verdict"].alias("verdict"))))
    wide_keys = wide.select("key")
    if wide_keys.isEmpty():
        # Deepest host first: the fold goes up the stack and the last find holds.
        found = F.aggregate("stack", found, lambda acc, host: F.coalesce(longest(host["paths"]), acc))
        out = out.withColumn("found", found)
    else:
        by_path = materialize(
            each.join(wide_keys.hint("merge"), "key", "left_semi").select(
                F.concat("key", F.lit("\0"), "path").alias("key"), F.struct(F.col("key").alias("host"), "path", "rule", "verdict").alias("load")
            ),
            "path-rules",
        )
        out = materialize(out.withColumn("found", found), "host-stacks")
        for level in range((out.agg(F.max(F.size("stack"))).first()[0] or 0) - 1, -1, -1):
            out = _by_path(out, level, by_path, longest)
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )


def _by_path(out: DataFrame, level: int, by_path: DataFrame, longest) -> DataFrame:
    """Decide by the rules of the hosts at one height of the stacks, where none above it has decided."""
    at = F.get("hosts", F.lit(level))
    rows = out.withColumnRenamed("stack", "hosts")
    open_ = F.col("found").isNull() & at.isNotNull() & at["paths"].isNull()
    swept = with_stack(rows, F.when(open_, F.concat(at["key"], F.lit("\0"), F.col("path"))), by_path)
    exact = F.filter("stack", lambda r: r["host"] == at["key"])
    found = F.coalesce("found", longest(exact), longest(at["paths"]))
    return swept.select("id", "host", "path", F.col("hosts").alias("stack"), found.alias("found"))
