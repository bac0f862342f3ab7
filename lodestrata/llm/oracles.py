"""DuckDB SQL for the operators that SQL can express, on plain joins of words and windows."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS ws FROM documents WHERE text IS NOT NULL),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- a linked pair shares one of the rarest fifth (and one more) of either side's shingles
ranked AS (
    SELECT s.doc_id, s.s, z.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.s) AS r
    FROM shingles s JOIN sizes z USING (doc_id) JOIN (SELECT s, count(*) AS c FROM shingles GROUP BY s) f USING (s)),
prefixes AS (SELECT doc_id, s FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
candidates AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefixes a JOIN prefixes b ON a.s = b.s AND a.doc_id < b.doc_id),
links AS (
    SELECT c.a, c.b FROM candidates c JOIN shingles x ON x.doc_id = c.a JOIN shingles y ON y.doc_id = c.b AND y.s = x.s
    JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b GROUP BY c.a, c.b, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
either_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM either_way UNION SELECT reach.node, e.b FROM reach JOIN either_way e ON e.a = reach.other),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN least l ON l.node = d.doc_id
"""

OP9_SQL = f"""
WITH w AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(ws[i + 1 : i + 35], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE win IN (SELECT win FROM repeated)),
each_word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
item_windows AS (
    SELECT DISTINCT id, least(len(ws), 10) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') AS win
    FROM (SELECT *, unnest(range(0, greatest(len(ws) - 9, 1))) AS i FROM items WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM w, lengths WHERE len(ws) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, t.id FROM doc_windows d JOIN item_windows t ON t.n = d.n AND t.win = d.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: CRC-32 of a string of ASCII characters: the table of bytes from its rule, and the fold over them.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


OP13_SQL = f"""
WITH hashed AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS ws, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, {_CRC_TABLE}),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM hashed),
w AS (
    SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws
    FROM (SELECT *, 1 + (len(ws) - a) // (3 + (h // 10) % 8) AS p FROM placed)),
-- a run's words, but for the last period, begin with six words that stand again one period later
passages AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS six FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 5)) AS i FROM w WHERE len(ws) > 5)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM passages x JOIN passages y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, n, min(q) AS q FROM islands WHERE n >= greatest(12, 2 * q) GROUP BY doc_id, s, n),
told AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
        first(s ORDER BY n DESC, s, q) AS s, max(n) AS n, first(q ORDER BY n DESC, s, q) AS q FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS k FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k FROM w) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, q AS period, 1000 * n // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _best(*offers: str) -> str:
    return f"list_min([{', '.join(offers)}])"


def _then(item: str, cost: str, edit: str, if_: str = "true") -> str:
    """What an item of the chart costs with one more edit; out of reach unless ``if_``."""
    return f"{{'c': {item}.c + CASE WHEN {if_} THEN {cost} ELSE 1000000000 END, 'w': {item}.w || {edit}}}"


def _read(item: str, initial: str) -> str:
    return _then(item, f"dearer + CASE WHEN i = '{initial}' THEN 0 ELSE 1 END", f"CASE WHEN i = '{initial}' THEN 'K' ELSE 'R' END", "NOT gone")


#: The same chart with whole audits in its items: e nothing, s a system turn, u an open question, a an answer.
OP11_SQL = f"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("key")} % 20 AS d
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations), {_CRC_TABLE}),
damaged AS (
    SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM coded WHERE d <> 0
    UNION ALL SELECT conv_id, turn, role, text FROM coded WHERE d = 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS i FROM damaged),
judged AS (
    SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM numbered),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS dearer FROM judged),
told AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id),
chart AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'w': ''}} AS e, {{'c': CAST(1000000000 AS BIGINT), 'w': ''}} AS s, {{'c': CAST(5 AS BIGINT), 'w': 'I'}} AS u, {{'c': CAST(10 AS BIGINT), 'w': 'II'}} AS a FROM told
    UNION ALL
    SELECT conv_id, n, e, s, u, {_best("a", _then("u", "5", "'I'"))} FROM (
        SELECT conv_id, n, e, s, {_best("u", _then("e", "5", "'I'"), _then("s", "5", "'I'"), _then("a", "5", "'I'"))} AS u, a FROM (
            SELECT c.conv_id, r.n, {_then("c.e", "2", "'D'")} AS e, {_best(_then("c.s", "2", "'D'"), _then("c.e", "dearer", "'K'", "NOT gone AND i = 's'"))} AS s,
                {_best(_then("c.u", "2", "'D'"), _read("c.e", "u"), _read("c.s", "u"), _read("c.a", "u"))} AS u, {_best(_then("c.a", "2", "'D'"), _read("c.u", "a"))} AS a
            FROM chart c JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.n = c.n + 1))),
done AS (SELECT t.*, {_best("c.e", "c.a")} AS best FROM told t JOIN chart c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.n = t.n),
letters AS (SELECT conv_id, best.w AS w, unnest(range(1, length(best.w) + 1)) AS k FROM done),
placed AS (SELECT *, w[k] AS edit, k - length(replace(w[1 : k], 'I', '')) AS before, k - (length(w[1 : k]) - length(replace(w[1 : k], 'D', ''))) AS place, length(replace(w, 'D', '')) % 2 AS odd FROM letters),
turns AS (
    SELECT p.conv_id, p.k, CASE edit WHEN 'K' THEN r.role ELSE CASE WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE r.text END AS line
    FROM placed p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = k - before AND edit <> 'I' WHERE edit <> 'D'),
said AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS text FROM turns GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
    coalesce(best.w, '') AS audit, sha256(coalesce(said.text, '')) AS repaired_sha256
FROM every LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM every.conv_id
"""
