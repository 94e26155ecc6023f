"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

from . import substring_dedup
from .decontamination import SHARE, SHORTEST, WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pairs over shared shingles, then components as everything reachable.
JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


_CUT = r"[w FOR w IN string_split_regex(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+') IF w <> '']"

#: Equal words of document and item by how they lie against each other, in all positions, then the best window of each; no seeds.
DECONTAMINATION = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
dw AS (SELECT doc_id, {_CUT} AS w FROM d), dt AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS t FROM dw),
iw AS (SELECT item_id, {_CUT} AS w FROM benchmark), it AS (SELECT item_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS t FROM iw),
x AS (SELECT doc_id, item_id, n, least({WINDOW}, n) AS z, dt.p - it.p AS start, list(it.p) AS ps FROM dt JOIN it ON dt.t = it.t WHERE n >= {SHORTEST} GROUP BY ALL HAVING count(*) >= ceil(least({WINDOW}, n) * {SHARE})),
y AS (SELECT *, len(ps) AS matched, list_max([len([q FOR q IN ps IF q >= s AND q < s + z]) FOR s IN range(0, n - z + 1)]) AS best_window FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, matched DESC, start) AS r FROM y WHERE best_window >= ceil(z * {SHARE}))
SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS item_words, matched::INTEGER AS matched, best_window::INTEGER AS best_window FROM k WHERE r = 1
"""

#: Words, characters and repeats of each text; windows of three words that occur twice or more, and the words inside them.
QUALITY_BASE = r"""
WITH w AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT i, generate_subscripts(w, 1) AS p, w FROM w WHERE len(w) >= 3), h AS (SELECT i, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM g WHERE p <= len(w) - 2),
again AS (SELECT i, p FROM h QUALIFY count(*) OVER (PARTITION BY i, g) > 1),
rep AS (SELECT i, count(DISTINCT q) AS n FROM (SELECT i, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY i),
lines AS (SELECT i, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN rep USING (i) LEFT JOIN dup USING (i)
"""

_BYTES = "octet_length(encode(coalesce(text, '')))"

#: What any placement keeps of the table, and what the law asks.
SHARDING_LAW = f"SELECT count(*) AS n_rows, sum({_BYTES} + 8)::BIGINT AS n_bytes, 24 AS shards, true AS gapless, true AS near_equal FROM documents"

_RUN = substring_dedup.WINDOW

#: All windows as text, those that begin twice or more, and the words within reach of their first words; no anchors.
SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT i, p, array_to_string(w[p : p + {_RUN - 1}], ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w) - {_RUN - 2})) AS p FROM d)),
again AS (SELECT i, p FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
word AS (SELECT i, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
marked AS (SELECT word.i, word.p, word, max(again.p) OVER (PARTITION BY word.i ORDER BY word.p ROWS BETWEEN {_RUN - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM word LEFT JOIN again ON again.i = word.i AND again.p = word.p),
kept AS (SELECT i, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY i)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (i)
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document scored for every item; no shards, blocks or bounds.
RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS total, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t),
m AS (SELECT i, doc_id, 25 + (75 * len(w) * total) // terms AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT item_id, text, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
x AS (SELECT item_id, text, doc_id, i, sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN df USING (t) JOIN tf USING (t) JOIN m USING (i) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM x QUALIFY rank <= 10
"""

#: CRC-32 bit by bit, then the cheapest edits row by row: of each conversation, row and state the least cost, and the least audit among equals.  No signatures.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, row_number() OVER () AS o FROM c, range(2) z(k) WHERE h <> 0 AND (k = 0 OR h = 3)),
s AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, o) > 1 AS again, left(role, 1) AS c, lag(left(role, 1)) OVER w AS before,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, o)),
f AS (SELECT *, empty AS blank, again AND NOT empty AS duplicate, open AND NOT again AND NOT empty AS truncated FROM s),
ins(state, j, after) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
edits(state, edit, own, after, cost) AS (VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)),
t(conv_id, i, state, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': ''} FROM f UNION ALL
    SELECT conv_id, i, state, min(best) FROM (SELECT t.conv_id, f.i, e.after AS state, {'cost': t.best.cost + 3 * ins.j + e.cost + CASE WHEN f.truncated AND e.edit <> 'D' THEN 3 ELSE 0 END, 'audit': t.best.audit || repeat('I', ins.j) || e.edit} AS best
        FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1 JOIN ins ON ins.state = t.state JOIN edits e ON e.state = ins.after AND (e.edit = 'D' OR NOT (f.blank OR f.duplicate)) AND (e.own IS NULL OR e.own = f.c)) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ends(state, cost, audit) AS (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')),
a AS (SELECT t.conv_id, min({'cost': best.cost + ends.cost, 'audit': best.audit || ends.audit}) AS best FROM t JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = n.n JOIN ends USING (state) GROUP BY t.conv_id),
p AS (SELECT conv_id, unnest(range(1, len(best.audit) + 1)) AS p, best.audit AS audit FROM a),
q AS (SELECT conv_id, p, audit[p] AS edit, count(*) FILTER (audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM p),
o AS (SELECT q.conv_id, q.p, q.edit, row_number() OVER w - 1 AS k, first_value(CASE WHEN q.edit = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER w AS led, f.role, f.text
    FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i AND q.edit <> 'I' WHERE q.edit <> 'D' WINDOW w AS (PARTITION BY q.conv_id ORDER BY q.p)),
l AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS lines FROM o GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(a.best.cost, 0) AS cost, coalesce(a.best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM d.conv_id
"""
