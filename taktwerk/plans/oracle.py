"""DuckDB SQL with the same rows as the queries."""

from __future__ import annotations

from taktwerk.plans import chats, layouts, lookups, reports, stores

_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def _norm(c: str) -> str:
    return f"coalesce({_NORM.format(c)}, '')"


def _tolerant(value: str, wanted: str) -> str:
    return (
        f"CASE WHEN ({wanted}) IS NULL THEN true WHEN ({value}) IS NULL THEN false "
        f"ELSE contains({_norm(value)}, {_norm(wanted)}) OR contains({_norm(wanted)}, {_norm(value)}) END"
    )


_PARTS = """
acts AS (SELECT p_partkey AS ord, p_name AS name, p_type AS day, p_brand AS center_name,
    CASE WHEN p_size % 5 <> 0 THEN p_size END AS min_age, CASE WHEN p_size % 3 = 0 THEN p_size + 10 END AS max_age,
    CASE WHEN p_size % 7 = 0 THEN 'cancelled' END AS status, format('{:02d}:{:02d}', p_size % 24, p_size) AS start_time,
    CASE WHEN p_size <= 59 THEN (p_size % 24) * 3600 + p_size * 60 END AS sec FROM part)
"""
_REQUESTS = """
reqs AS (SELECT n_nationkey::bigint AS request_id, CASE WHEN n_nationkey % 2 = 0 THEN ['red', 'BLUE ', 'ring'][n_nationkey % 3 + 1] END AS category,
    CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 2 END AS age, CASE WHEN n_nationkey % 4 = 0 THEN 'economy' WHEN n_nationkey % 4 = 1 THEN 'small' END AS day,
    CASE WHEN n_nationkey % 5 = 0 THEN 28800 END AS after, CASE WHEN n_nationkey % 5 < 2 THEN 63000 END AS before,
    CASE WHEN n_nationkey % 6 = 5 THEN 'brand#1' END AS center FROM nation)
"""
_AGE = "CASE WHEN {age} IS NULL THEN NULL WHEN min_age IS NULL AND max_age IS NULL THEN 'unknown' WHEN {age} < min_age OR {age} > max_age THEN 'no_match' ELSE 'match' END"
_FOUND = f"""
found AS (SELECT q.request_id, a.*, {_AGE.format(age='q.age')} AS age_match FROM acts a JOIN reqs q ON a.status IS NULL
    AND (q.category IS NULL OR {_tolerant('a.name', 'q.category')}) AND (q.day IS NULL OR {_tolerant('a.day', 'q.day')})
    AND (q.center IS NULL OR {_tolerant('a.center_name', 'q.center')})
    AND (q.after IS NULL OR coalesce(a.sec >= q.after, false)) AND (q.before IS NULL OR coalesce(a.sec <= q.before, false))
    AND coalesce({_AGE.format(age='q.age')}, '') <> 'no_match'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE age_match WHEN 'match' THEN 0 WHEN 'unknown' THEN 1 WHEN 'no_match' THEN 2 ELSE 3 END, ord) AS place,
    count(*) OVER (PARTITION BY request_id) AS total FROM found)
"""
_SEARCH = f"WITH {_PARTS}, {_REQUESTS}, {_FOUND}"

_LINES = """
lines AS (SELECT doc_id, n, trim(text) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
    WHERE trim(text) <> '')
"""

_VERSIONS = """
base AS (SELECT c_custkey AS k, c_nationkey::varchar AS source_file, c_mktsegment AS a, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS b FROM customer),
e AS (SELECT * FROM base WHERE k % 7 <> 0),
x AS (SELECT k, source_file, CASE WHEN k % 5 = 0 THEN lower(a) ELSE a END AS a, CASE WHEN k % 4 = 0 THEN NULL ELSE b END AS b FROM base WHERE k % 11 <> 0)
"""

_ORDERS = """
o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 40 = 0 THEN ' ' ELSE 'c' END AS center,
    CASE WHEN o_orderkey % 30 = 0 THEN 'bad' WHEN o_orderkey % 31 <> 0 THEN 'ok' END AS start_kind, (o_orderkey % 24) * 60 + o_orderkey % 60 AS s,
    CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey + 1) % 25 END AS eh, o_orderkey % 60 AS em, o_orderkey % 130 - 5 AS lo, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 100 END AS hi,
    o_orderstatus AS status FROM orders),
v AS (SELECT k, unnest(list_filter([
    CASE WHEN name IS NULL THEN 'name_empty' END, CASE WHEN trim(center) = '' THEN 'center_empty' END, 'day_unknown', CASE WHEN start_kind IS NULL THEN 'start_empty' END,
    CASE WHEN start_kind = 'bad' THEN 'start_invalid' END, CASE WHEN eh IS NULL THEN 'end_empty' END, CASE WHEN eh > 23 THEN 'end_invalid' END,
    CASE WHEN start_kind = 'ok' AND eh <= 23 AND eh * 60 + em <= s THEN 'end_not_after_start' END, CASE WHEN hi IS NULL THEN 'max_age_invalid' END,
    CASE WHEN lo < 0 OR lo > 120 THEN 'min_age_range' END, CASE WHEN lo > hi THEN 'ages_crossed' END, 'status_unknown', 'instructor_empty'], lambda r: r IS NOT NULL)) AS rule FROM o),
w AS (SELECT *, CASE WHEN rule IN ('end_empty', 'end_not_after_start', 'status_unknown', 'instructor_empty', 'location_empty') THEN 'warning' ELSE 'error' END AS severity FROM v)
"""


def _holds(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _word(t: str, words: list[str]) -> str:
    """A word by itself; DuckDB's border knows ASCII only, so letters on either side are excluded by class."""
    return f"regexp_matches({t}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"


def _opens(t: str, words: list[str]) -> str:
    return f"regexp_matches({t}, '^({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"


_DAYS = "['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']"
_FIRST = "lower(regexp_extract(text, '^([A-Za-z]+)', 1))"
_DATE = "(date '2024-01-01' + (conv_id % 7)::int)"
_MESSAGES = f"""
m0 AS (SELECT conv_id, turn, text, lower(trim(text, ' ' || chr(10))) AS t, CASE WHEN turn % 2 = 0 THEN 'Mon' WHEN turn % 3 = 0 THEN 'Wed' END AS d, turn % 3 = 1 AS timed, {_FIRST} AS c, dayofweek({_DATE}) AS dow FROM conversations),
m1 AS (SELECT *, trim(regexp_replace(regexp_replace(t, '[?!.,:;׳״"''…]+', ' ', 'g'), '\\s+', ' ', 'g')) AS q,
    CASE WHEN {_word('t', ['that'])} THEN {_DAYS}[dow + 1] WHEN {_word('t', ['und'])} THEN {_DAYS}[(dow + 1) % 7 + 1] WHEN {_word('t', ['les'])} THEN {_DAYS}[(dow + 6) % 7 + 1] ELSE d END AS d2 FROM m0),
m2 AS (SELECT *,
    CASE WHEN {_holds('t', ['thing', 'tion '])} THEN 'activity' WHEN {_opens('t', ['the', 'der', 'la'])} THEN 'unknown'
         WHEN {_opens('q', ['of', 'que', 'die'])} AND {_holds('q', ['and', 'eau', 'ung'])} THEN 'activity' ELSE 'other' END AS intent,
    CASE WHEN {_holds('t', ['ered'])} OR {_word('t', ['with'])} THEN ['06:00', '12:00'] WHEN {_holds('t', ['ande'])} OR {_word('t', ['de', 'von'])} THEN ['12:00', '17:00']
         WHEN {_holds('t', ['ment'])} OR {_word('t', ['un'])} THEN ['17:00', '23:59'] WHEN {_holds('t', ['keit'])} OR {_word('t', ['ist'])} THEN ['21:00', '23:59']
         ELSE [CASE WHEN timed THEN '09:30' END, NULL] END AS bounds FROM m1),
m AS (SELECT conv_id, turn, text, intent, intent = 'activity' AS confident,
    CASE WHEN {_holds('t', ['schen'])} THEN 'mixed' WHEN {_holds('t', ['elle'])} THEN 'women' WHEN {_holds('t', ['esth'])} THEN 'families' END AS target_audience,
    CASE WHEN {_holds('t', ['that', 'und', 'les'])} OR (d2 = 'Mon' AND contains(t, 'on')) OR (d2 = 'Tue' AND contains(t, 'er')) OR (d2 = 'Wed' AND contains(t, 'en')) THEN d2 END AS day,
    bounds[1] AS start_after, bounds[2] AS start_before, CASE WHEN c NOT IN ('the', 'la') AND (c = '' OR contains(t, c)) THEN c END AS center_name,
    CASE WHEN c IN ('the', 'la') OR c = '' THEN c END AS location, CASE WHEN {_holds('t', ['in ing', 'ining'])} THEN 'ing' END AS branch, CASE WHEN contains(t, 'ther') THEN 'Ther' END AS instructor FROM m2)
"""

_TURNS = f"""
t0 AS (SELECT conv_id, turn, length(text) AS len, {_norm('text')} AS t FROM conversations),
t1 AS (SELECT *, CASE WHEN contains(t, 'ation') AND turn > 0 THEN 1 ELSE 0 END AS fresh, contains(t, 'the') AS no_day, contains(t, 'und') AS no_time, contains(t, 'eau') AS no_cat,
    CASE WHEN contains(t, 'er') THEN 'd' || turn END AS day, CASE WHEN contains(t, 'ou') THEN 'c' || turn END AS category,
    CASE WHEN contains(t, 'st') THEN 'a' || turn END AS sa, CASE WHEN contains(t, 'ei') THEN 'b' || turn END AS sb FROM t0),
t2 AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS epoch FROM t1),
st AS (SELECT conv_id, turn,
    last_value(CASE WHEN day IS NOT NULL OR no_day THEN {{'v': day}} END IGNORE NULLS) OVER w AS d, last_value(CASE WHEN category IS NOT NULL OR no_cat THEN {{'v': category}} END IGNORE NULLS) OVER w AS c,
    last_value(CASE WHEN sa IS NOT NULL OR sb IS NOT NULL OR no_time THEN {{'a': sa, 'b': sb}} END IGNORE NULLS) OVER w AS p
    FROM t2 WINDOW w AS (PARTITION BY conv_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING)),
state AS (SELECT conv_id, turn, d.v AS now_day, c.v AS now_category, p.a AS now_start_after, p.b AS now_start_before FROM st)
"""

SQL = {
    "norm_text": f"SELECT doc_id, md5({_norm('text')}) AS norm_md5 FROM documents",
    "clean_placeholders": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
        f AS (SELECT doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) AS s FROM l)
        SELECT doc_id, n, CASE WHEN s IN ('', '—', '-', 'The.', 'Of.', 'Is.') THEN NULL ELSE s END AS line, s = '' AS blank FROM f""",
    "tolerant_search": f"SELECT p_partkey, p_name, p_type FROM part WHERE {_tolerant('p_name', chr(39) + ' Red  Widget ' + chr(39))} OR {_tolerant('p_type', chr(39) + 'econ' + chr(39))}",
    "batch_search": f"{_SEARCH} SELECT request_id, ord, name, age_match, place, total FROM ranked WHERE place <= 5",
    "answer_text": f"""{_SEARCH} SELECT request_id, any_value(total) AS total, string_agg(name || ' — ' || day || ' ' || start_time || ', מרכז: ' || center_name
        || CASE WHEN min_age IS NOT NULL AND max_age IS NOT NULL THEN ', גיל ' || min_age || '–' || max_age WHEN min_age IS NOT NULL THEN ', מגיל ' || min_age WHEN max_age IS NOT NULL THEN ', עד גיל ' || max_age ELSE '' END
        || CASE WHEN age_match = 'unknown' THEN ', לא צוין טווח גיל במקור' ELSE '' END, chr(10) ORDER BY place) AS answer, any_value(total) > 5 AS has_more FROM ranked WHERE place <= 5 GROUP BY request_id""",
    "age_summaries": f"""{_SEARCH}, c AS (SELECT request_id, count(*) FILTER (age_match = 'match') AS n_match, count(*) FILTER (age_match = 'unknown') AS n_unknown FROM ranked GROUP BY request_id)
        SELECT *, CASE WHEN n_match > 0 AND n_unknown > 0 THEN 'both' WHEN n_match > 0 THEN 'certain' WHEN n_unknown > 0 THEN 'unknown' ELSE 'none' END AS summary FROM c""",
    "all_places": f"{_SEARCH} SELECT request_id, ord, age_match, place, total FROM ranked",
    "deep_page": """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events)
        SELECT *, least(1050, total) AS next_offset, total > 1050 AS has_more FROM r WHERE place BETWEEN 1001 AND 1050""",
    "next_page": """SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders WHERE (o_orderpriority, o_totalprice, o_orderkey) > ('3-MEDIUM', 100000.0, 0)
        ORDER BY 1, 2, 3 LIMIT 200""",
    "single_search": f"""WITH {_PARTS}, r AS (SELECT *, {_AGE.format(age='20')} AS age_match FROM acts WHERE status IS NULL AND contains(lower(day), 'medium') AND sec >= 36000)
        SELECT ord, age_match FROM r WHERE age_match <> 'no_match'""",
    "time_window": "WITH s AS (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::bigint AS second FROM events) SELECT * FROM s WHERE second BETWEEN 30600 AND 61200",
    "daypart_join": """WITH p(daypart, lo, hi) AS (VALUES ('morning', '06:00', '12:00'), ('noon', '12:00', '17:00'), ('evening', '17:00', '23:59'), ('night', '21:00', '23:59'))
        SELECT daypart, event_type, count(*) AS n FROM events JOIN p ON strftime(ts, '%H:%M') BETWEEN lo AND hi GROUP BY ALL""",
    "weekday_name": f"SELECT {_DAYS}[dayofweek(o_orderdate) + 1] AS weekday, count(*) AS n FROM orders GROUP BY 1",
    "add_minutes": """WITH m AS (SELECT event_id, (hour(ts) * 60 + minute(ts) + user_id % 180) % 1440 AS x FROM events)
        SELECT event_id, lpad((x // 60)::varchar, 2, '0') || ':' || lpad((x % 60)::varchar, 2, '0') AS end_time FROM m""",
    "time_forms": """WITH m AS (SELECT event_id, event_id % 4 AS f, hour(ts) AS h, minute(ts) AS mi FROM events),
        c AS (SELECT *, CASE f WHEN 0 THEN h WHEN 1 THEN h % 12 + 12 WHEN 2 THEN h + 3 ELSE h END AS x FROM m),
        t AS (SELECT *, CASE WHEN f <> 2 OR x <= 23 THEN lpad(x::varchar, 2, '0') || ':' || lpad(mi::varchar, 2, '0') END AS time FROM c)
        SELECT event_id, time AS start_time, CASE WHEN f = 3 THEN time END AS end_time, time FROM t""",
    "infer_end": """WITH e AS (SELECT event_id, event_type AS s, strftime(ts, '%a') AS d, user_id % 3 AS n, hour(ts) * 60 + minute(ts) AS m, event_id % 10 = 0 AS given FROM events),
        r AS (SELECT *, CASE WHEN s = 'click' AND n = 1 THEN 45 WHEN s = 'click' THEN 55 WHEN s = 'view' AND d = 'Mon' AND n <> 2 THEN 30 WHEN s = 'error' AND d = 'Tue' AND n = 0 THEN 60 END AS add FROM e)
        SELECT event_id, CASE WHEN given THEN '12:00' WHEN add IS NOT NULL THEN lpad((((m + add) % 1440) // 60)::varchar, 2, '0') || ':' || lpad(((m + add) % 60)::varchar, 2, '0') END AS end_inferred,
               CASE WHEN given THEN 'explicit' WHEN add IS NOT NULL THEN 'inferred_source_rule' ELSE 'missing' END AS end_time_source FROM r""",
    "range_status": f"""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 11 <> 0) THEN p_size END AS min_age, CASE WHEN p_size % 3 = 0 THEN p_size + 10 END AS max_age,
        CASE WHEN p_size % 5 <> 0 AND p_partkey % 2 <> 0 AND p_partkey % 11 <> 0 THEN p_size END AS strict FROM part)
        SELECT p_partkey, {_AGE.format(age='25')} AS age_match, min_age::bigint AS low, strict::bigint AS strict_low FROM r""",
    "certainty_rank": f"""WITH {_PARTS}, s AS (SELECT *, {_AGE.format(age='25')} AS age_match FROM acts),
        r AS (SELECT center_name, ord, age_match, row_number() OVER (PARTITION BY center_name ORDER BY CASE age_match WHEN 'match' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, ord) AS place FROM s)
        SELECT * FROM r WHERE place <= 5""",
    "page": """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events)
        SELECT user_id, event_id, place, least(10, total) AS next_offset, total > 10 AS has_more FROM r WHERE place BETWEEN 6 AND 10""",
    "dedup_first": f"SELECT min(doc_id) AS doc_id, key FROM (SELECT doc_id, md5({_norm('text')}) AS key FROM documents) GROUP BY key",
    "dedup_last": "SELECT max(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders GROUP BY 2, 3",
    "dup_groups": f"""SELECT min(doc_id) AS first_doc, count(*) AS n, string_agg(doc_id::varchar, ',' ORDER BY doc_id) AS members
        FROM (SELECT doc_id, md5({_norm('text')}) AS key FROM documents) GROUP BY key HAVING count(*) > 1""",
    "profile": """WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment FROM customer)
        SELECT 'segment' AS "column", coalesce(segment, 'missing') AS value, count(*) AS n FROM c GROUP BY ALL
        UNION ALL SELECT 'c_nationkey', c_nationkey::varchar, count(*) FROM c GROUP BY ALL
        UNION ALL SELECT 'missing:segment', 'missing', count(*) FROM c WHERE segment IS NULL""",
    "violations": f"WITH {_ORDERS} SELECT rule, severity, count(*) AS n, min(k) AS first, sum(k)::bigint AS total FROM w GROUP BY ALL",
    "verdict": f"WITH {_ORDERS} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'error') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM w",
    "source_summary": """SELECT o_orderpriority AS source_file, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_cancelled, count(*) FILTER (o_orderstatus = 'P') AS n_tbd,
        count(*) FILTER (o_custkey % 4 = 0) AS n_no_instructor, count(*) FILTER (o_custkey % 5 <> 0) AS n_no_location FROM orders GROUP BY 1""",
    "key_diff": """SELECT CASE WHEN l.doc_id IS NULL THEN 'extra' WHEN d.doc_id IS NULL THEN 'missing' ELSE 'both' END AS side, coalesce(l.doc_id, d.doc_id) AS doc_id
        FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id""",
    "precision_recall": f"""WITH {_VERSIONS}, j AS (SELECT e.k AS ek, x.k AS xk FROM e FULL JOIN x ON e.k = x.k AND e.source_file = x.source_file)
        SELECT count(*) FILTER (ek IS NOT NULL AND xk IS NOT NULL) AS matched, count(*) FILTER (xk IS NULL) AS missing, count(*) FILTER (ek IS NULL) AS extra,
               (count(*) FILTER (ek IS NOT NULL AND xk IS NOT NULL))::double / count(ek) AS recall, (count(*) FILTER (ek IS NOT NULL AND xk IS NOT NULL))::double / count(xk) AS precision FROM j""",
    "field_mismatch": f"""WITH {_VERSIONS}, j AS (SELECT e.source_file, e.a IS DISTINCT FROM x.a AS da, e.b IS DISTINCT FROM x.b AS db FROM e JOIN x ON e.k = x.k AND e.source_file = x.source_file),
        f AS (SELECT source_file, 'a' AS field FROM j WHERE da UNION ALL SELECT source_file, 'b' FROM j WHERE db)
        SELECT source_file, field, count(*) AS n FROM f GROUP BY GROUPING SETS ((source_file, field), (field))""",
    "set_ops": f"""WITH {_VERSIONS} SELECT 'both' AS side, k FROM (SELECT k FROM e INTERSECT SELECT k FROM x) UNION ALL SELECT 'missing', k FROM (SELECT k FROM e EXCEPT SELECT k FROM x)
        UNION ALL SELECT 'extra', k FROM (SELECT k FROM x EXCEPT SELECT k FROM e)""",
    "lookup_default": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1",
    "locations": r"""WITH s AS (SELECT s_suppkey, trim(regexp_replace(replace(regexp_replace(s_name, '#0+', ' - '), '-', '–'), '\s+', ' ', 'g')) AS place FROM supplier),
        c AS (SELECT s_suppkey, place, CASE WHEN s_suppkey % 3 = 0 THEN place || ' – סניף a''' ELSE place END AS combined FROM s)
        SELECT s_suppkey, combined, s_suppkey % 2 = 0 AS same FROM c""",
    "doc_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, md5(arg_min(text, n)) AS title_md5, sum(length(text))::bigint AS n_chars FROM lines GROUP BY doc_id",
    "header_carry": f"""WITH {_LINES}, c AS (SELECT doc_id, n, text, last_value(CASE WHEN length(text) < 40 THEN {{'v': CASE WHEN length(text) > 12 THEN text END}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS h FROM lines)
        SELECT doc_id, n::bigint AS n, h.v AS header FROM c WHERE length(text) >= 40 AND h.v IS NOT NULL""",
    "gate": f"""WITH {_LINES}, a AS (SELECT *, length(text) < 40 AS s, max(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) OVER w AS inside FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, max(CASE WHEN inside = 1 AND length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS done FROM a)
        SELECT doc_id, count(*) AS n_lines, min(n)::bigint AS first, max(n)::bigint AS last FROM b WHERE inside = 1 AND NOT s AND done = 0 GROUP BY doc_id""",
    "lookahead": f"""WITH {_LINES}, a AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM lines)
        SELECT doc_id, n::bigint AS n, md5(nxt) AS next_md5 FROM a WHERE length(text) < 40 AND length(nxt) > 200""",
    "matrix_unpivot": "SELECT strftime(ts, '%a') AS weekday, strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY ALL",
    "named_columns": "SELECT o_orderkey, o_orderstatus AS state, o_orderpriority AS priority, o_custkey::varchar AS who FROM orders",
    "adaptive_split": rf"""WITH {_LINES}, s AS (SELECT doc_id, n, CASE WHEN contains(text, '|') THEN string_split(text, '|') WHEN contains(text, ',') THEN string_split(text, ',') ELSE string_split_regex(text, '\s+[–-]\s+|\s{{2,}}') END AS p FROM lines),
        q AS (SELECT doc_id, n, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x NOT IN ('', '—', '-')) AS p FROM s)
        SELECT doc_id, n::bigint AS n, len(p)::bigint AS n_parts, p[1] AS head FROM q""",
    "regex_fields": """WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
        SELECT page_id, regexp_replace(host, '^(www|m|blog)[.]', '') AS site, try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS bigint) AS number, string_split(host, '.')[1] AS head, starts_with(url, 'https:') AS secure FROM h""",
    "display_line": """SELECT p_partkey, concat_ws(', ', p_name || ' — ' || p_type || ' 08:00' || CASE WHEN p_size % 2 = 0 THEN '–09:00' ELSE '' END, 'מרכז: ' || p_brand, CASE WHEN p_size % 3 = 0 THEN 'סניף a' END,
        CASE WHEN p_size % 5 = 2 THEN 'גיל ' || p_size || '–' || (p_size + 9) WHEN p_size % 5 < 2 THEN 'מגיל ' || p_size ELSE 'עד גיל ' || (p_size + 9) END, CASE WHEN p_size % 6 = 0 THEN 'סטטוס: tbd' END) AS line FROM part""",
    "audience_rule": "SELECT p_partkey, CASE p_name WHEN 'red ring' THEN 'mixed' WHEN 'blue bolt' THEN 'women' ELSE 'other' END AS audience FROM part",
    "message_rules": f"WITH {_MESSAGES} SELECT conv_id, turn, intent, confident, target_audience, day, start_after, start_before, center_name, location, branch, instructor FROM m",
    "merge_candidates": """SELECT conv_id * 1000 + turn AS id, CASE WHEN turn = 2 THEN 'Fri' WHEN turn % 2 = 0 THEN 'Mon' WHEN turn % 3 = 0 THEN 'Wed' END AS day,
        CASE WHEN turn > 1 THEN '7:00' WHEN turn % 3 = 1 THEN '9:30' END AS start_after FROM conversations""",
    "routes": f"""WITH {_MESSAGES} SELECT CASE WHEN conv_id % 9 = 0 OR trim(text) = '' OR turn = 5 THEN 'clarify' WHEN turn % 2 = 1 THEN CASE WHEN intent = 'activity' THEN 'search' ELSE 'clarify' END
        WHEN intent = 'activity' AND confident THEN 'search' ELSE 'fallback' END AS route, count(*) AS n FROM m GROUP BY 1""",
    "lexicon_slots": r"""WITH lex AS (SELECT DISTINCT (n_nationkey % 3)::varchar AS slot, ['the', 'and', 'that', 'der', 'que', 'con', 'les', 'und', 'with', 'of the', 'and the', 'in the'][n_nationkey % 12 + 1] AS variant FROM nation),
        w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations),
        tok AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM w)
        SELECT conv_id, turn, slot, upper(max_by(variant, (length(variant), variant))) AS canonical FROM tok JOIN lex ON token = variant GROUP BY conv_id, turn, slot""",
    "conv_labels": rf"""WITH c AS (SELECT conv_id, turn, text, {_norm('text')} AS t FROM conversations)
        SELECT conv_id, turn, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}]') THEN 'symbols' WHEN contains(t, 'thank') OR contains(t, 'stop') THEN 'stop' ELSE 'message' END AS label,
               concat_ws(',', CASE WHEN contains(t, 'the') THEN 'day' END, CASE WHEN contains(t, 'und') THEN 'time' END, CASE WHEN contains(t, 'eau') THEN 'category' END) AS cleared,
               turn > 0 AND (contains(t, 'ered') OR contains(t, 'eau') OR len(list_filter(string_split(t, ' '), lambda x: x <> '')) <= 6) AS follow_up,
               md5(regexp_replace(regexp_replace(t, '^[?!.,:;׳״"''…]+', ''), '[?!.,:;׳״"''…]+$', '')) AS core_md5 FROM c""",
    "conv_state": f"WITH {_TURNS} SELECT * FROM state",
    "known_slots": f"""WITH {_TURNS} SELECT concat_ws(',', CASE WHEN now_day IS NOT NULL THEN 'now_day' END, CASE WHEN now_category IS NOT NULL THEN 'now_category' END,
        CASE WHEN now_start_after IS NOT NULL THEN 'now_start_after' END, CASE WHEN now_start_before IS NOT NULL THEN 'now_start_before' END) AS known, count(*) AS n FROM state GROUP BY 1""",
    "paging_sessions": """WITH t AS (SELECT conv_id, turn, length(text) % 23 AS results, turn % 4 AS f, turn % 4 = 0 OR (turn % 4 = 3 AND conv_id % 3 = 0) AS r FROM conversations),
        p AS (SELECT *, sum(r::int) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM t),
        q AS (SELECT *, first_value(CASE WHEN f = 0 THEN results ELSE 0 END) OVER w AS found, sum((NOT r)::int) OVER w AS pages FROM p WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING)),
        o AS (SELECT *, least(pages * 5, found)::bigint AS offs FROM q)
        SELECT conv_id, turn, offs AS "offset", greatest(0, least(5, found - offs))::bigint AS page_rows, found > offs + 5 AS has_more FROM o""",
    "eval_cases": "",
    "eval_score": "",
    "json_fields": "SELECT (json_extract(props, '$.k')::bigint % 10) AS digit, count(*) AS n, sum(json_extract(props, '$.k')::bigint)::bigint AS total FROM events GROUP BY 1",
    "stream_state": f"WITH {_TURNS} SELECT * FROM state",
    "stream_validate": """SELECT 'late_hour' AS rule, 'error' AS severity, count(*) AS n, sum(event_id)::bigint AS total FROM events WHERE hour(ts) >= 22
        UNION ALL SELECT 'no_value', 'warning', count(*), sum(event_id)::bigint FROM events WHERE value < 1.0""",
    "stream_search": f"""WITH {_PARTS}, q AS (SELECT n_nationkey::bigint AS request_id, CASE WHEN n_nationkey % 2 = 0 THEN 'economy' ELSE 'small' END AS d, n_nationkey * 2 AS age FROM nation)
        SELECT request_id, count(*) AS n, sum(ord)::bigint AS total FROM acts JOIN q ON status IS NULL AND contains(lower(day), d) AND {_AGE.format(age='q.age')} <> 'no_match' GROUP BY 1""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
}
SQL["chat_sessions"] = SQL["stream_sessions"] = chats.sessions_sql(_TURNS[: _TURNS.index("t2 AS")].rstrip().rstrip(","))
SQL["stream_messages"] = SQL["message_rules"]
_CASES = f"""{_SEARCH}, n AS (SELECT request_id, count(*) AS c FROM found GROUP BY 1),
    e AS (SELECT q.request_id AS id, coalesce(c, 0) AS result_count,
        (CASE WHEN q.request_id % 3 = 0 AND q.day IS DISTINCT FROM 'economy' THEN 1 ELSE 0 END + CASE WHEN q.request_id % 2 = 0 AND NOT contains(lower(trim(coalesce(q.category, ''))), 'red') THEN 1 ELSE 0 END
         + CASE WHEN coalesce(c, 0) < 5 THEN 1 ELSE 0 END)::bigint AS n_failures FROM reqs q LEFT JOIN n ON q.request_id = n.request_id)"""
SQL["eval_cases"] = f"{_CASES} SELECT *, n_failures = 0 AS passed FROM e"
SQL["eval_score"] = f"""{_CASES} SELECT count(*) AS total, count(*) FILTER (n_failures = 0) AS passed, count(*) FILTER (n_failures > 0) AS failed,
    round(100.0 * count(*) FILTER (n_failures = 0) / count(*), 6)::double AS score_percent FROM e"""

#: What makes two orders one activity.
_SAME = """CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END, o_orderkey % 40 = 0, dayofweek(o_orderdate), o_orderpriority, CASE WHEN o_orderkey % 30 = 0 THEN -1 WHEN o_orderkey % 31 <> 0 THEN (o_orderkey % 24) * 60 + o_orderkey % 60 END,
    CASE WHEN o_orderkey % 9 <> 0 THEN ((o_orderkey + 1) % 25) * 60 + o_orderkey % 60 END"""


def oracle_sql() -> dict[str, str]:
    return SQL | layouts.SQL | stores.SQL | lookups.SQL | reports.sql({"orders": _ORDERS, "cases": _CASES, "same": _SAME})
