"""DuckDB SQL of the queries that SQL can express, written independently of
the DataFrame code: plain windows over all rows, no sketch, no automaton."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, {_WORD}), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(n.n, 0) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

CONTAMINATION = f"""
WITH items AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER.format('text')}, {_ITEM_WORD}) AS w FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0),
keys AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM starts),
lengths AS (SELECT DISTINCT n FROM keys),
d AS (SELECT doc_id, COALESCE(regexp_extract_all({_LOWER.format('text')}, {_ITEM_WORD}), []) AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lengths ON len(d.w) >= lengths.n),
hits AS (SELECT p.doc_id, p.i, p.n, k.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM places) p
         JOIN keys k ON k.n = p.n AND k.key = p.key),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hits),
c AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id),
edges AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM pos),
runs AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, run, count(*) AS n FROM edges GROUP BY doc_id, run) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(c.n_hit, 0) AS n_hit, COALESCE(ids.n_items, 0) AS n_items,
       sha256(COALESCE(ids.ids, '')) AS items_sha256, COALESCE(c.n_hit, 0) > 0 AS contaminated, COALESCE(runs.longest, 0) AS longest
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN runs USING (doc_id)"""

MIX = f"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, {_WORD})), 0) AS size FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5('7|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 12) AS BIGINT) AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS r FROM w),
f AS (SELECT *, budget - (SELECT COALESCE(sum(p.cap), 0) FROM o p WHERE p.r < o.r) AS left_budget,
             (SELECT sum(p.weight) FROM o p WHERE p.r >= o.r) AS left_weight FROM o),
level AS (SELECT max(left_budget / left_weight) AS level FROM f WHERE left_budget / left_weight <= cap / weight),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(weight * level, cap) END AS target FROM f, level),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM t),
want AS (SELECT *, greatest(target - whole * source_size, 0.0) AS want FROM plan),
h1 AS (SELECT source, u >> 36 AS b, sum(size) AS tokens FROM hashed GROUP BY ALL),
c1 AS (SELECT source, b, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY b) - tokens AS before FROM h1),
cut1 AS (SELECT c1.source, max(b) AS cut1, arg_max(before, b) AS before1 FROM c1 JOIN want ON want.source IS NOT DISTINCT FROM c1.source
         WHERE tokens > 0 AND before < want.want GROUP BY c1.source),
h2 AS (SELECT h.source, (u >> 24) & 4095 AS b, sum(size) AS tokens, any_value(before1) AS before1
       FROM hashed h JOIN cut1 ON cut1.source IS NOT DISTINCT FROM h.source AND h.u >> 36 = cut1.cut1 GROUP BY ALL),
c2 AS (SELECT *, before1 + sum(tokens) OVER (PARTITION BY source ORDER BY b) - tokens / 2 AS middle FROM h2),
cut2 AS (SELECT c2.source, max(b) AS cut2 FROM c2 JOIN want ON want.source IS NOT DISTINCT FROM c2.source WHERE middle <= want.want GROUP BY c2.source),
cut AS (SELECT want.*, CASE WHEN cut1 IS NULL THEN 0 ELSE cut1 * 4096 + COALESCE(cut2 + 1, 0) END AS cut
        FROM want LEFT JOIN cut1 ON cut1.source IS NOT DISTINCT FROM want.source LEFT JOIN cut2 ON cut2.source IS NOT DISTINCT FROM want.source)
SELECT h.doc_id, CAST(h.size AS BIGINT) AS size, c.source_size, c.target, copies * h.size AS taken, copies
FROM (SELECT h.doc_id, h.source, h.size, c.whole + CASE WHEN (h.u >> 24) < c.cut THEN 1 ELSE 0 END AS copies
      FROM hashed h JOIN cut c ON c.source IS NOT DISTINCT FROM h.source) h
JOIN cut c ON c.source IS NOT DISTINCT FROM h.source"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT k.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
         FROM k LEFT JOIN g USING (key) WHERE g.last IS NULL OR g.last = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, CAST(len(d.l) - COALESCE(kept.n, 0) AS BIGINT) AS n_dropped,
       sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: CRC-32 of a text column: its bytes, each followed by eight shifts
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, CAST(octet_length(encode({0})) AS BIGINT) + 1),
    lambda i: [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS s FROM t GROUP BY conv_id),
c AS (SELECT conv_id, s, {_CRC.format('name')} % 6 AS h FROM o),
b AS (SELECT c.conv_id, CASE WHEN o.s IS NULL THEN c.s[c.h + 1:] ELSE list_concat(o.s[1:c.h], c.s[c.h + 1:]) END AS s
      FROM c LEFT JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, s[1:d] AS k, d, d = len(s) AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends,
             CASE WHEN d = 0 THEN 0 ELSE length(k[d].t) END AS chars FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, COALESCE(kids.c, 0) AS c FROM n LEFT JOIN kids ON kids.k = n.k),
sums AS (SELECT k[1:e] AS k, sum((n - 1) * chars) AS saved, count(*) FILTER (WHERE c = 0) AS leaves
         FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n AS n_convs, m.c AS n_children, sums.leaves AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(COALESCE(m.ends, '')) AS ends_sha256
FROM m JOIN sums ON sums.k = m.k LEFT JOIN n up ON m.d > 0 AND up.k = m.k[1:m.d - 1] AND up.d = m.d - 1"""

SPELLING = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS k FROM t WHERE length(run) >= 5 GROUP BY ALL),
x AS (SELECT *, hex(encode(name)) AS hx FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(hx) // 2 + 1),
             lambda i: [CAST('0x' || hx[2 * i - 1:2 * i] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) AS h FROM x),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT v.word, c.word FROM v JOIN cut c ON c.rest = v.word
          UNION SELECT c.word, v.word FROM v JOIN cut c ON c.rest = v.word),
near AS (SELECT p.word, count(*) AS n_near, max(o.n) AS most FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word),
best AS (SELECT p.word, min(p.other) AS form FROM pairs p JOIN v o ON o.word = p.other JOIN near m ON m.word = p.word AND m.most = o.n GROUP BY p.word),
f AS (SELECT v.word, v.n, COALESCE(near.n_near, 0) AS n_near, CASE WHEN near.most >= 2 * v.n THEN best.form END AS form,
             CASE WHEN near.most >= 2 * v.n THEN near.most END AS form_n
      FROM v LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
led AS (SELECT word, word AS at, form AS next FROM f
        UNION ALL SELECT led.word, f.word, f.form FROM led JOIN f ON f.word = led.next)
SELECT f.word, f.form, led.at AS root, f.n, f.n_near, f.form_n FROM f JOIN led ON led.word = f.word AND led.next IS NULL"""
SPELLING = SPELLING.replace("WITH t AS", "WITH RECURSIVE t AS")

ORACLE = {
    "op2_count_min_substrings": SUBSTRINGS,
    "op7_entropy_balancing": MIX,
    "op8_suffix_automaton": CONTAMINATION,
    "op11_prefix_trie": TRIE,
    "op12_spelling_variants": SPELLING,
    "op13_line_runs": LINES,
}
