"""Results of the operators that SQL can state, over the whole tables."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d) x),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT win.doc_id, win.i FROM win JOIN least ON least.h = win.h WHERE least.first < win.doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM gone) x),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
kept AS (SELECT v.doc_id, string_agg(v.word, ' ' ORDER BY v.place) AS text, count(*) AS n FROM words v
 LEFT JOIN covered c ON c.doc_id = v.doc_id AND c.place = v.place WHERE c.place IS NULL GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.size + q.size - c)),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT doc_id AS start, doc_id AS node FROM d UNION SELECT r.start, l.y FROM reach r JOIN links l ON l.x = r.node),
part AS (SELECT start, min(node) AS least FROM reach GROUP BY start)
SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, part.least AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN part ON part.start = d.doc_id"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""

# The states of the role automaton are 0 (nothing yet), 1 (after s), 2 (after u) and 3 (after a); w* are the cheapest
# (cost, audit, repaired) from each state before row i on, worked out from the last row to the first; u and a follow from the state.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([1, 1, 1, 1, 1, 1, 1, 1] AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS draw FROM src),
damaged AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS p FROM placed),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM seen),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
  count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
best AS (
 SELECT conv_id, n + 1 AS i, [{c: 0, a: '', r: CAST([] AS VARCHAR[])}, {c: 999999, a: '', r: CAST([] AS VARCHAR[])}, {c: 2, a: 'I', r: ['assistant:']}, {c: 0, a: '', r: CAST([] AS VARCHAR[])}] AS w FROM sums
 UNION ALL
 SELECT conv_id, i, [list_min([row0, {c: 2 + row2.c, a: 'I' || row2.a, r: list_prepend('user:', row2.r)}]), list_min([row1, {c: 2 + row2.c, a: 'I' || row2.a, r: list_prepend('user:', row2.r)}]),
   list_min([row2, {c: 2 + row3.c, a: 'I' || row3.a, r: list_prepend('assistant:', row3.r)}]), list_min([row3, {c: 2 + row2.c, a: 'I' || row2.a, r: list_prepend('user:', row2.r)}])] AS w
 FROM (SELECT j.conv_id, j.i,
   list_min([del0, toU] || CASE WHEN ok AND j.c = 's' THEN [{c: t + b.w[2].c, a: 'K' || b.w[2].a, r: list_prepend(j.role || ':' || j.text, b.w[2].r)}] WHEN ok AND j.c = 'u' THEN [keepU] ELSE [] END) AS row0,
   list_min([del1, toU] || CASE WHEN ok AND j.c = 'u' THEN [keepU] ELSE [] END) AS row1,
   list_min([del2, {c: bad + 2 + t + b.w[4].c, a: 'R' || b.w[4].a, r: list_prepend('assistant:' || j.text, b.w[4].r)}]
    || CASE WHEN ok AND j.c = 'a' THEN [{c: t + b.w[4].c, a: 'K' || b.w[4].a, r: list_prepend(j.role || ':' || j.text, b.w[4].r)}] ELSE [] END) AS row2,
   list_min([del3, toU] || CASE WHEN ok AND j.c = 'u' THEN [keepU] ELSE [] END) AS row3
  FROM (SELECT b.conv_id, b.i, b.w, {c: 3 + b.w[1].c, a: 'D' || b.w[1].a, r: b.w[1].r} AS del0, {c: 3 + b.w[2].c, a: 'D' || b.w[2].a, r: b.w[2].r} AS del1,
    {c: 3 + b.w[3].c, a: 'D' || b.w[3].a, r: b.w[3].r} AS del2, {c: 3 + b.w[4].c, a: 'D' || b.w[4].a, r: b.w[4].r} AS del3, j.fault NOT IN ('b', 'd') AS ok,
    CASE WHEN j.fault IN ('b', 'd') THEN 999999 ELSE 0 END AS bad, CASE WHEN j.fault = 't' THEN 1 ELSE 0 END AS t,
    {c: CASE WHEN j.fault IN ('b', 'd') THEN 999999 ELSE 0 END + CASE WHEN j.fault = 't' THEN 1 ELSE 0 END + 2 + b.w[3].c, a: 'R' || b.w[3].a, r: list_prepend('user:' || j.text, b.w[3].r)} AS toU,
    {c: CASE WHEN j.fault = 't' THEN 1 ELSE 0 END + b.w[3].c, a: 'K' || b.w[3].a, r: list_prepend(j.role || ':' || j.text, b.w[3].r)} AS keepU
    FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1) b
  JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1) x)
SELECT o.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
 CAST(coalesce(b.w[1].c, 0) AS BIGINT) AS cost, coalesce(b.w[1].a, '') AS audit, sha256(coalesce(array_to_string(b.w[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1"""

SQL = {"op3_substring_dedup": SUBSTRING_DEDUP, "op7_jaccard_join": JACCARD_JOIN, "op11_exact_dedup": EXACT_DEDUP, "op12_conversation_repair": CONVERSATION_REPAIR}
