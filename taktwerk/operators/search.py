"""Tolerant search of many requests over an activity table, ranking, paging and display.

``activities`` has the columns of :data:`taktwerk.schemas.ACTIVITY` that are used, and ``ord``, the
order of ingestion.  ``requests`` has ``request_id`` and the filters as nullable columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.ages import age_bound, age_status, bound_status, certainty
from taktwerk.functions.text import form_match, search_form, tolerant_match
from taktwerk.functions.timeofday import at_or_after, at_or_before, seconds_of
from taktwerk.operators.index import contained_pairs
from taktwerk.operators.ranking import ranked
from taktwerk.sources.tables import merged, scratch, written

#: Filters that are compared as text, with the activity's column of the same name.
TEXT_FILTERS = ["day", "location", "target_audience", "center_name", "branch", "instructor"]
PAGE = 5
#: Columns that a wanted type may stand in.
TYPE_COLUMNS = ["name", "category", "english_name"]
#: Years in a band of ages, the last band, and parts that all rows are dealt to for requests that ask for nothing.
AGE_BAND, AGE_BANDS, ALL_PARTS = 10, 12, 32
#: Keys of requests that are sent to the tasks that hold the activities; more of them are met by merging.
SENT_KEYS = 50_000


def category_of(explicit: Column, source_file: Column) -> Column:
    """The category: given, or sport for rows that came from a document."""
    return F.coalesce(explicit, F.when(F.endswith(source_file, F.lit(".docx")), F.lit(rules.SPORT)))


def type_matches(row: dict[str, Column], wanted: Column) -> Column:
    """Whether category, name or English name match the wanted type."""
    return tolerant_match(row["category"], wanted) | tolerant_match(row["name"], wanted) | tolerant_match(row["english_name"], wanted)


def any_filter(c: dict[str, Column]) -> Column:
    """Whether a request has any filter."""
    return F.coalesce(*[c[f].cast("string") for f in rules.SEARCH_FIELDS if f in c]).isNotNull()


def _present(c: Column) -> Column:
    return c.isNotNull() & (search_form(c) != "")


def conditions(row: dict[str, Column], want: dict[str, Column], with_cancelled: bool = False) -> Column:
    """All filters of a request; an absent or blank one lets every row pass."""
    ok = F.lit(True) if with_cancelled else ~row["status"].eqNullSafe(F.lit("cancelled"))
    if "category" in want:
        ok = ok & (~_present(want["category"]) | type_matches(row, want["category"]))
    if "age" in want:
        ok = ok & (F.coalesce(age_status(row["min_age"], row["max_age"], want["age"]), F.lit("match")) != "no_match")
    if "start_after" in want:
        ok = ok & (~_present(want["start_after"]) | at_or_after(row["start_time"], want["start_after"]))
    if "start_before" in want:
        ok = ok & (~_present(want["start_before"]) | at_or_before(row["start_time"], want["start_before"]))
    for f in TEXT_FILTERS:
        if f in want:
            ok = ok & (~_present(want[f]) | tolerant_match(row[f], want[f]))
    return ok


def _prepared(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns as the join compares them, each row's once: texts in search form, times in seconds, ages in years.

    A blank filter becomes null, as it lets every row pass; a bound that is no time becomes one that none meets.
    """
    made = {}
    for c in columns:
        if c == "start_time":
            made[c] = seconds_of(F.col(c))
        elif c in ("start_after", "start_before"):
            made[c] = F.when(_present(F.col(c)), F.coalesce(seconds_of(F.col(c)), F.lit(-1 if c == "start_before" else 86_400)))
        elif c in ("min_age", "max_age"):
            made[c] = age_bound(F.col(c))
        elif c in ("age", "status"):
            made[c] = F.col(c)
        else:
            made[c] = F.when(F.col(c).isNotNull(), search_form(F.col(c)))
    return df.select("*", *[v.alias(f"_f_{c}") for c, v in made.items()]), {c: f"_f_{c}" for c in made}


def _prepared_conditions(row: dict[str, Column], want: dict[str, Column], with_cancelled: bool = False) -> Column:
    """:func:`conditions` on columns of :func:`_prepared`."""
    asked = lambda f: want[f].isNotNull() & (want[f] != "")
    ok = F.lit(True) if with_cancelled else ~row["status"].eqNullSafe(F.lit("cancelled"))
    if "category" in want:
        ok = ok & (~asked("category") | form_match(row["category"], want["category"]) | form_match(row["name"], want["category"]) | form_match(row["english_name"], want["category"]))
    if "age" in want:
        ok = ok & (F.coalesce(bound_status(row["min_age"], row["max_age"], want["age"]), F.lit("match")) != "no_match")
    if "start_after" in want:
        ok = ok & (want["start_after"].isNull() | F.coalesce(row["start_time"] >= want["start_after"], F.lit(False)))
    if "start_before" in want:
        ok = ok & (want["start_before"].isNull() | F.coalesce(row["start_time"] <= want["start_before"], F.lit(False)))
    for f in TEXT_FILTERS:
        if f in want:
            ok = ok & (~asked(f) | form_match(row[f], want[f]))
    return ok


def search(activities: DataFrame, with_cancelled: bool = False, **filters) -> DataFrame:
    """One request: its rows, the age status if an age is asked for, in order of certainty and ingestion."""
    row = {c: activities[c] for c in activities.columns}
    for c in ("category", "english_name", "min_age", "max_age", "status", "start_time", *TEXT_FILTERS):
        row.setdefault(c, F.lit(None).cast("string"))
    want = {k: F.lit(v) for k, v in filters.items() if v is not None}
    out = activities.where(conditions(row, want, with_cancelled))
    if "age" in want:
        out = out.withColumn("age_match", age_status(row["min_age"], row["max_age"], want["age"]))
        return out.orderBy(certainty(F.col("age_match")), "ord")
    return out.orderBy("ord")


def _age_band(age: Column) -> Column:
    return F.least(F.floor(age / AGE_BAND), F.lit(AGE_BANDS)).cast("int")


def _row_keys(row: dict[str, Column], column: str, order: Column) -> Column:
    """Under which keys of a column an activity is found, as an array of texts."""
    if column == "start_time":
        keys = F.array(F.floor(row[column] / 3600))
    elif column == "age":
        low, high = _age_band(F.coalesce(row["min_age"], F.lit(0))), _age_band(F.coalesce(row["max_age"], F.lit(AGE_BAND * AGE_BANDS)))
        known = F.when(low <= high, F.sequence(low, F.greatest(low, high)))
        keys = F.when(row["min_age"].isNull() & row["max_age"].isNull(), F.array(F.lit(-1))).otherwise(known)
    elif column == "all":
        keys = F.array(F.pmod(F.xxhash64(order), F.lit(ALL_PARTS)))
    else:
        return F.array_compact(F.array(row[column]))
    return F.array_compact(F.coalesce(F.transform(keys, lambda k: k.cast("string")), F.array().cast("array<string>")))


def _request_keys(want: dict[str, Column]) -> dict[str, Column]:
    """Per column that is no text: the keys under which what a request can find stands, or null if it does not ask."""
    out = {"all": F.sequence(F.lit(0), F.lit(ALL_PARTS - 1))}
    after, before = (want.get(c, F.lit(None).cast("int")) for c in ("start_after", "start_before"))
    first, last = F.floor(F.coalesce(after, F.lit(0)) / 3600).cast("int"), F.floor(F.coalesce(before, F.lit(86_399)) / 3600).cast("int")
    hours = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    out["start_time"] = F.when(after.isNotNull() | before.isNotNull(), hours)
    if "age" in want:
        out["age"] = F.when(want["age"].isNotNull(), F.array(F.lit(-1), _age_band(want["age"])))
    return {c: F.transform(k, lambda x: x.cast("string")) for c, k in out.items()}


def _entries(kind: str | None, column: str, keys: Column) -> Column:
    named = [F.lit(kind).alias("kind")] if kind else []
    return F.transform(keys, lambda v: F.struct(*named, F.lit(column).alias("column"), v.alias("key")))


def _tied(activities: DataFrame, requests: DataFrame, row: dict[str, Column], want: dict[str, Column]) -> DataFrame:
    """``request_id, column, key``: for each request the keys of one column under which all that it finds stands.

    Of a request's filters that one drives whose keys hold fewest activities.  Which values a text filter lets through is
    looked up in an index over the distinct values, both for texts that hold the wanted one and for texts inside it.
    """
    columns = [(f, f) for f in TEXT_FILTERS if f in want] + ([("category", c) for c in TYPE_COLUMNS] if "category" in want else [])
    keys = _request_keys(want)
    each = [(f, c, _row_keys(row, c, F.col("ord"))) for f, c in [*columns, *[(k, k) for k in keys]]]
    entries = F.concat(*[_entries(f, c, k) for f, c, k in each])
    values = written(activities.select(F.inline(entries)).groupBy("kind", "column", "key").agg(F.count(F.lit(1)).alias("n")), "search-values")
    texts = [f for f in want if f in TEXT_FILTERS or f == "category"]
    asked = requests.select(
        "request_id", F.inline(F.array_compact(F.array(*[F.when(want[f].isNotNull() & (want[f] != ""), F.struct(F.lit(f).alias("kind"), want[f].alias("wanted"))) for f in texts] or [F.lit(None).cast("struct<kind:string,wanted:string>")])))
    )
    # Both directions in one look-up: wanted texts inside of held ones, and held ones inside of wanted ones.
    wanted = asked.select("kind", F.col("wanted").alias("text")).distinct()
    held = values.where(F.col("kind").isin(*texts)).select("kind", F.col("key").alias("text")).distinct()
    way = lambda df, sign: df.select(F.concat("kind", F.lit(sign)).alias("kind"), "text")
    pairs = contained_pairs(way(wanted, "<").unionByName(way(held, ">")), way(held, "<").unionByName(way(wanted, ">")))
    inside = F.endswith("kind", F.lit("<"))
    pairs = pairs.where(inside | (F.col("needle") != F.col("hay"))).select(
        F.expr("left(kind, length(kind) - 1)").alias("kind"), F.when(inside, F.col("needle")).otherwise(F.col("hay")).alias("wanted"), F.when(inside, F.col("hay")).otherwise(F.col("needle")).alias("key")
    )
    passed = merged(asked, pairs, ["kind", "wanted"], "left").select("request_id", "kind", "key")
    exact = requests.select("request_id", F.inline(F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(c).alias("kind"), k.alias("keys"))) for c, k in keys.items()]))))
    passed = passed.unionByName(exact.select("request_id", "kind", F.explode_outer("keys").alias("key")))
    costs = merged(passed, values, ["kind", "key"], "left").groupBy("request_id", "kind").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"), F.collect_list(F.when(F.col("column").isNotNull(), F.struct("column", "key"))).alias("keys"))
    least = costs.groupBy("request_id").agg(F.min_by("keys", F.struct("cost", "kind")).alias("keys"))
    return least.select("request_id", F.inline("keys"))


def matches(activities: DataFrame, requests: DataFrame, with_cancelled: bool = False) -> DataFrame:
    """Every request with every activity that fits: ``request_id``, the activity's columns and ``age_match``.

    Requests and activities meet in joins of equals, under the keys of one column for each request (:func:`_tied`), and all
    filters are tested then.  A request without any filter meets all rows, in ``ALL_PARTS`` parts.  The activities are never
    sent anywhere whole: up to ``SENT_KEYS`` keys of requests, as counted, go to where they are, more meet them by merging.
    """
    compared = ["name", "category", "english_name", "min_age", "max_age", "status", "start_time", *TEXT_FILTERS]
    shown_columns = activities.columns
    activities, own = _prepared(activities, [c for c in compared if c in shown_columns])
    requests, asked = _prepared(requests, [c for c in rules.SEARCH_FIELDS if c in requests.columns])
    kind = lambda c: "int" if c in ("min_age", "max_age", "start_time") else "string"
    row = lambda t: {c: F.col(f"{t}{own[c]}") if c in own else F.lit(None).cast(kind(c)) for c in compared}
    want = lambda t: {c: F.col(f"{t}{f}") for c, f in asked.items()}
    with scratch(activities.sparkSession) as keep:
        tied = keep(_tied(activities, requests, row(""), want("")), "search-keys")
    used = {r["column"]: r["n"] for r in tied.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    a_row, q_want = row("a."), want("q.")
    age = q_want.get("age", F.lit(None).cast("int"))
    shown = [F.col("q.request_id"), *[F.col(f"a.{c}") for c in shown_columns], bound_status(a_row["min_age"], a_row["max_age"], age).alias("age_match")]
    fits = _prepared_conditions(a_row, q_want, with_cancelled)
    keys = F.concat(F.array().cast("array<struct<column:string,key:string>>"), *[_entries(None, c, _row_keys(row(""), c, F.col("ord"))) for c in sorted(used)])
    a = activities.select("*", F.inline(keys).alias("_column", "_key")).alias("a")
    q = tied.withColumnsRenamed({"column": "_column", "key": "_key"})
    q = merged(q, requests.select("request_id", *asked.values()), "request_id")
    q = q.hint("broadcast" if sum(used.values()) <= SENT_KEYS else "merge").alias("q")
    for k, column in enumerate(TYPE_COLUMNS):
        # A row whose value in an earlier column lets it through has come out there.
        for earlier in TYPE_COLUMNS[:k] if column in used else ():
            fits = fits & ~((F.col("a._column") == column) & F.coalesce(form_match(a_row[earlier], q_want["category"]), F.lit(False)))
    return a.join(q, (F.col("a._column") == F.col("q._column")) & (F.col("a._key") == F.col("q._key"))).where(fits).select(*shown)


def search_many(activities: DataFrame, requests: DataFrame, with_cancelled: bool = False, first: int | None = None) -> DataFrame:
    """:func:`matches` with ``place`` (by certainty, then ingestion) and ``total`` of each request.

    With ``first`` only so many rows of each request come out, and no task holds more of one; else the places of requests that
    most rows fit are counted over many tasks.
    """
    out = matches(activities, requests, with_cancelled).withColumn("_certainty", certainty(F.col("age_match")))
    if first is None:
        return ranked(out, ["request_id"], ["_certainty", "ord"]).drop("_certainty")
    totals = out.groupBy("request_id").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("_certainty", "ord"))
    return out.withColumn("place", place).where(F.col("place") <= first).drop("_certainty").join(totals, "request_id")


def top(ranked: DataFrame, keys: list[str], order: list, n: int = PAGE) -> DataFrame:
    """The first ``n`` rows of each group, with their place."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def page(df: DataFrame, keys: list[str], order: list, offset: int, n: int = PAGE) -> DataFrame:
    """The page of each group after ``offset`` rows, with ``place``, ``next_offset`` and ``has_more``.

    No task holds more of a group than the rows up to the page's end; for pages far behind see :mod:`taktwerk.operators.ranking`.
    """
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    out = top(df, keys, order, offset + n).where(F.col("place") > offset).alias("p").join(totals.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("p.*", "t.total")
    return out.withColumn("next_offset", F.least(F.lit(offset + n), F.col("total"))).withColumn("has_more", F.col("total") > offset + n).drop("total")


def display_line(c: dict[str, Column]) -> Column:
    """An activity in one line: name, day and time, then only the parts that are there."""
    d = rules.DISPLAY

    def part(label: str, value: Column | None) -> Column:
        return F.lit(None) if value is None else F.when(value.cast("string") != "", F.concat(F.lit(d[label]), value.cast("string")))

    def shown(name: str) -> Column:
        return F.coalesce(F.trim(c[name].cast("string")), F.lit("")) if name in c else F.lit("")

    lo, hi = (age_bound(c[x]) if x in c else F.lit(None).cast("int") for x in ("min_age", "max_age"))
    head = F.concat(shown("name"), F.lit(" — "), shown("day"), F.lit(" "), shown("start_time"), F.when(shown("end_time") != "", F.concat(F.lit("–"), shown("end_time"))).otherwise(""))
    age = (
        F.when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit(d["age"]), lo.cast("string"), F.lit("–"), hi.cast("string")))
        .when(lo.isNotNull(), F.concat(F.lit(d["from_age"]), lo.cast("string")))
        .when(hi.isNotNull(), F.concat(F.lit(d["to_age"]), hi.cast("string")))
    )
    unknown = F.when(c["age_match"] == "unknown", F.lit(d["no_age"])) if "age_match" in c else F.lit(None)
    status = F.when(c["status"] != "active", F.concat(F.lit(d["status"]), c["status"])) if "status" in c else F.lit(None)
    return F.concat_ws(
        ", ", head, part("center", c.get("center_name")), part("branch", c.get("branch")), part("instructor", c.get("instructor")), part("location", c.get("location")),
        age, unknown, part("audience", c.get("target_audience")), status, part("notes", c.get("notes")),
    )


def age_summary(results: DataFrame) -> DataFrame:
    """Per request: counts of certain and unknown ages, and which of the four sentences applies."""
    out = results.groupBy("request_id").agg(F.count_if(F.col("age_match") == "match").alias("n_match"), F.count_if(F.col("age_match") == "unknown").alias("n_unknown"))
    kind = F.when((F.col("n_match") > 0) & (F.col("n_unknown") > 0), "both").when(F.col("n_match") > 0, "certain").when(F.col("n_unknown") > 0, "unknown").otherwise("none")
    return out.withColumn("summary", kind)


def answers(results: DataFrame, line: Column, n: int = PAGE) -> DataFrame:
    """Per request: the total, the first ``n`` lines as one text, and whether there are more."""
    first = results.where(F.col("place") <= n).withColumn("line", line)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    # At most ``n`` lines of a request meet in one row.
    return first.groupBy("request_id").agg(F.first("total").alias("total"), lines.alias("answer")).withColumn("has_more", F.col("total") > n)


def search_events(events: DataFrame, target_age_group: str | None = None, **filters) -> DataFrame:
    """Events by target age group, day, place and start; the filters of the activity search."""
    table = events.withColumnRenamed("target_age_group", "target_audience")
    return search(table, with_cancelled=True, **{"target_audience": target_age_group} | filters)


def search_volunteering(posts: DataFrame, volunteer_age: int | None = None, **filters) -> DataFrame:
    """Volunteer posts; the age must reach the least one, and is unknown where there is none."""
    table = posts.withColumnRenamed("title", "name")
    return search(table, with_cancelled=True, age=volunteer_age, **filters)
