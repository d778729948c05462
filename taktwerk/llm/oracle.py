"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from taktwerk.llm import mixing, quality, urls

_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def _permuted(x: str, n: str, seed: str) -> str:
    """The permutation of :mod:`taktwerk.llm.mixing` as nested expressions."""
    factor = " ".join(f"WHEN {n} % {p} <> 0 THEN {p}" for p in mixing.PRIMES)
    bits = f"(length(to_base({n}, 2)) - 1)"
    for turn in range(3):
        x = f"(({x} * CASE {factor} END + ({seed} + {turn}) * 7919 + 104729) % {n})"
        if turn < 2:
            x = f"list_extract(list_transform([{x}], lambda y{turn}: CASE WHEN y{turn} < (1::bigint << {bits}) THEN xor(y{turn}, y{turn} >> (({bits} + 1) // 2)) ELSE y{turn} END), 1)"
    return x


OP7 = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint AS size,
           md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) AS key
    FROM documents),
s0 AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, [{', '.join(f'{w}.0' for w in mixing.WEIGHTS)}][rank % {len(mixing.WEIGHTS)} + 1]::double AS w, {mixing.MOST}.0::double * source_size AS cap FROM s1),
s3 AS (SELECT *, ({mixing.MIX}::double * sum(source_size) OVER ()
              - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s2),
s4 AS (SELECT *, (SELECT lev FROM s3 WHERE lev <= cap / w ORDER BY cap / w, rank LIMIT 1) AS level FROM s3),
s5 AS (SELECT source, rank, source_size, coalesce(least(cap, w * level), cap) AS target,
              ceil(source_size / {mixing.BLOCK}.0)::bigint AS blocks FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * blocks + 0.5)::bigint ELSE 0 END AS slots FROM s5),
q AS (SELECT rank, blocks, slots, (sum(slots) OVER (ORDER BY rank))::bigint AS e FROM s WHERE slots > 0),
n AS (SELECT sum(slots)::bigint AS total FROM q),
u AS (SELECT shard, ('0x' || substr(md5('0|' || shard || '|' || j), 1, 15))::bigint % total AS draw
      FROM n, unnest(range(total // {mixing.SHARD_SLOTS})) AS a(shard), unnest(range({mixing.SHARD_SLOTS})) AS c(j)),
m AS (SELECT shard, rank, count(*) AS n FROM u JOIN q ON draw >= e - slots AND draw < e GROUP BY ALL),
m2 AS (SELECT *, (sum(n) OVER (PARTITION BY rank ORDER BY shard) - n)::bigint AS base FROM m),
v AS (SELECT q.*, coalesce(have, 0)::bigint AS have, (SELECT total // {mixing.SHARD_SLOTS} FROM n) AS drawn
      FROM q LEFT JOIN (SELECT rank, sum(n) AS have FROM m GROUP BY rank) x ON q.rank = x.rank),
v2 AS (SELECT rank, blocks, have, drawn, slots, (sum(slots - have) OVER (ORDER BY rank) - (slots - have))::bigint AS place FROM v WHERE have < slots),
slot AS (SELECT m2.rank, q.blocks, shard, unnest(range(base, least(base + n, q.slots))) AS t FROM m2 JOIN q ON m2.rank = q.rank
         UNION ALL
         SELECT rank, blocks, drawn + (place + t - have) // {mixing.SHARD_SLOTS}, t FROM (SELECT *, unnest(range(have, slots)) AS t FROM v2)),
hit AS (SELECT rank, block, count(*) AS times, min(shard) AS f, max(shard) AS l FROM
           (SELECT rank, shard, {_permuted('(t % blocks)', 'blocks', '(rank * 31)')} AS block FROM slot) GROUP BY ALL),
p AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.rank,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size)::bigint AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM p WHERE size > 0),
t AS (SELECT b.doc_id, b.size, b.source_size, b.target, b.rank, b.start,
             sum((least(start + size, (b.block + 1) * {mixing.BLOCK}) - greatest(start, b.block * {mixing.BLOCK})) * coalesce(times, 0))::bigint AS taken,
             sum(coalesce(times, 0))::bigint AS n_blocks, min(f) AS first_shard, max(l) AS last_shard
      FROM b LEFT JOIN hit ON b.rank = hit.rank AND b.block = hit.block GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken, n_blocks, first_shard, last_shard FROM t
UNION ALL SELECT doc_id, size, source_size, target, 0, 0, NULL, NULL FROM p WHERE size = 0
"""

_NORMAL = rf"lower(trim(regexp_replace(line, '{_GAP}', ' ', 'g')))"

#: Lines of the documents with their hosts, in normal form, and those above the limits.
_LINES = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split_regex(coalesce(text, ''), '{_GAP}') AS parts FROM documents),
w AS (SELECT *, list_filter(parts, lambda x: x <> '') AS words FROM d),
l0 AS (SELECT rid, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
l AS (SELECT rid, source, text, line, {_NORMAL} AS normal, len(regexp_extract_all(line, '{_WORD}'))::bigint AS n FROM l0 WHERE regexp_matches(line, '{_WORD}')),
h AS (SELECT source, count(DISTINCT coalesce(text, chr(0))) AS docs FROM d GROUP BY source),
f AS (SELECT l.source, l.normal FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source
      GROUP BY l.source, l.normal, h.docs
      HAVING count(DISTINCT text) > {quality.LINE_MIN_DOCS}
         AND (count(DISTINCT text) * 100 > h.docs * {quality.LINE_MAX_PERCENT} OR count(DISTINCT text) > {quality.LINE_MANY_DOCS})),
r AS (SELECT l.rid, sum(l.n)::bigint AS removed FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.normal = f.normal GROUP BY l.rid),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::bigint AS n_dup_lines FROM l GROUP BY rid),
g AS (SELECT rid, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - {quality.WINDOW} + 2)) AS i FROM w WHERE len(words) >= {quality.WINDOW})),
g2 AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT j)::bigint AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {quality.WINDOW})) AS j FROM g2) GROUP BY rid),
a AS (SELECT w.rid, doc_id, source, text, len(words)::bigint AS n_words,
             length(regexp_replace(coalesce(text, ''), '{_GAP}', '', 'g'))::bigint AS word_chars,
             (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{quality.SYMBOLS}', '')))::bigint AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(words)::bigint - coalesce(removed, 0) AS n_words_kept
      FROM w LEFT JOIN dup ON w.rid = dup.rid LEFT JOIN c ON w.rid = c.rid LEFT JOIN r ON w.rid = r.rid),
z AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
"""

OP9 = f"""
WITH {_LINES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_words_kept >= {quality.MIN_KEPT_PERCENT} * n_words AS kept, n_words_kept
FROM z
"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

OP11 = f"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(verdict, h, p) AS (VALUES {_RULES})
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict
FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h) DESC, length(p) DESC) = 1
"""

#: The CRC-32 of a text of plain characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

OP12 = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                  len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint AS words FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, {_CRC.format(x='conv_id::varchar')} % 4 AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - (h.conv_id % 20 + 20) % 20),
p AS (SELECT conv_id, len(turns) AS n, d, CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS w,
             coalesce(array_to_string(list_transform(turns[1:d], lambda x: x.id), ''), '') AS k
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
                sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM p GROUP BY k, d),
kids AS (SELECT left(k, (d - 1) * 64) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT left(k, i * 64) AS k, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n - 1) * w) AS saved
          FROM (SELECT node.*, kids.n IS NULL AS leaf, unnest(range(0, d + 1)) AS i FROM node LEFT JOIN kids ON node.k = kids.k) GROUP BY 1)
SELECT a.conv_id, a.d::bigint AS depth, u.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       below.n_leaves, below.saved::bigint AS saved_tokens, a.ends AS ends_sha256
FROM node a JOIN below ON a.k = below.k LEFT JOIN kids ON a.k = kids.k LEFT JOIN node u ON a.d > 0 AND u.k = left(a.k, (a.d - 1) * 64)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7, "op9_quality_rules": OP9, "op11_url_rules": OP11, "op12_prefix_trie": OP12}
