"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from itertools import permutations

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

OP11 = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs),
flagged AS (SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails FROM words),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flagged LEFT JOIN said USING (doc_id) GROUP BY part, fails),
steps AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS f, substr(filter_order, 1, step::INTEGER - 1) AS before FROM (VALUES {_ORDERS}) o(filter_order), range(1, 6) s(step)),
cases AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS here, len(translate(fails, before, '')) < len(fails) AS earlier FROM counted, steps),
found AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
    FROM cases GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM found
"""

#: States (empty, opened, asked, reply) between which insertions lead, and edits of rows as the contract sees them: state, row
#: (its role's first letter, a capital if truncated, d if it must go), next state, cost, letter.
_INSERTS = "('e','a',5,'I'), ('o','a',5,'I'), ('r','a',5,'I'), ('a','r',5,'I'), ('e','r',10,'II'), ('o','r',10,'II')"
_NEXT = {"e": "a", "o": "a", "r": "a", "a": "r"}
_EDITS = [(q, row, q, 2, "D") for q in _NEXT for row in "dsuaxSUAX"]
_EDITS += [(q, row, _NEXT[q], 1 + 5 * row.isupper(), "R") for q in _NEXT for row in "suaxSUAX"]
_EDITS += [(q, row, to, 5 * row.isupper(), "K") for letter, froms, to in (("s", "e", "o"), ("u", "eor", "a"), ("a", "a", "r")) for q in froms for row in (letter, letter.upper())]

OP13 = f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
named AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT k, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM named), crc_table),
spoilt AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM named JOIN kinds USING (k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS plain FROM spoilt),
faulty AS (SELECT *, CASE WHEN plain = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(plain, '[.!?]$') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
seen AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN left(role, 1) NOT IN ('s', 'u', 'a') THEN CASE WHEN fault IS NULL THEN 'x' ELSE 'X' END WHEN fault IS NULL THEN left(role, 1) ELSE upper(left(role, 1)) END AS sees FROM faulty),
inserts(f, t, c, w) AS (VALUES ('e','e',0,''), ('o','o',0,''), ('a','a',0,''), ('r','r',0,''), {_INSERTS}),
edits(f, sees, t, c, w) AS (VALUES {", ".join(map(str, _EDITS))}),
steps AS (SELECT i.f, e.sees, e.t, min((i.c + e.c, i.w || e.w)) AS v FROM inserts i JOIN edits e ON i.t = e.f GROUP BY i.f, e.sees, e.t),
ways AS (
    SELECT DISTINCT conv, 0::BIGINT AS i, 'e' AS q, 0::BIGINT AS cost, '' AS audit FROM named
    UNION ALL
    SELECT conv, i, q, v[1]::BIGINT, v[2] FROM (SELECT w.conv, s.i, steps.t AS q, min((w.cost + steps.v[1], w.audit || steps.v[2])) AS v FROM ways w JOIN seen s ON s.conv = w.conv AND s.i = w.i + 1 JOIN steps ON steps.f = w.q AND steps.sees = s.sees GROUP BY w.conv, s.i, steps.t)),
chosen AS (SELECT conv, min((w.cost + i.c, w.audit || i.w)) AS v FROM ways w JOIN inserts i ON i.f = w.q AND i.t IN ('e', 'r') WHERE w.i = coalesce((SELECT max(s.i) FROM seen s WHERE s.conv = w.conv), 0) GROUP BY conv),
letters AS (SELECT conv, p, substr(v[2], p::INTEGER, 1) AS edit FROM (SELECT conv, v, unnest(range(1, length(v[2]) + 1)) AS p FROM chosen)),
applied AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv ORDER BY p) AS row, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv ORDER BY p) AS place FROM letters),
lines AS (SELECT a.conv, a.p, a.place, a.edit, s.role, CASE WHEN a.edit = 'I' THEN '' ELSE s.text END AS text FROM applied a LEFT JOIN seen s ON s.conv = a.conv AND s.i = a.row WHERE a.edit <> 'D'),
heads AS (SELECT conv, max(CASE WHEN place = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS system FROM lines GROUP BY conv),
texts AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text FROM lines JOIN heads USING (conv) GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    v[1]::BIGINT AS cost, v[2] AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM named) n JOIN chosen USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN texts USING (conv)
"""

ORACLES = {"op11_filter_audit": OP11, "op13_conversation_repair": OP13}
