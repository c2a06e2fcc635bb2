"""The text queries in DuckDB SQL, for those that SQL can express.

Not here: language identification and page extraction (trained models), packing and token output (token ids, and a
free choice of sequences), and decontamination (its templates need look-behind). Their tests use held-out accuracy,
round trips and brute force.
"""

from __future__ import annotations

from tickspark.llm.secrets import BASE_RULES, RULES, Rule

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH docs AS (SELECT doc_id, text FROM documents),
cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS nth FROM docs WHERE text IS NOT NULL),
tok AS (SELECT doc_id, text, line, nth,
               [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
                FOR t IN regexp_extract_all(line, '[^\x20\x09-\x0D]+')] AS w FROM cut),
lines AS (SELECT *, (len(w)::VARCHAR || ' ' || array_to_string(w[1:3], ' ')) AS leaf FROM tok WHERE len(w) >= 3),
known AS (SELECT DISTINCT leaf, line, w, text FROM lines
          WHERE leaf IN (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT text) >= 10)),
codes AS (SELECT leaf, line, w, text, unnest(range(len(w))) AS pos, unnest(w) AS token FROM known),
fixed AS (SELECT leaf, pos, token FROM codes GROUP BY ALL HAVING count(DISTINCT text) >= 10),
kinds AS (SELECT DISTINCT leaf, line, w FROM known),
shaped AS (SELECT leaf, line, list(pos::VARCHAR || ' ' || token ORDER BY pos) AS template
           FROM (SELECT leaf, line, w, unnest(range(len(w))) AS pos, unnest(w) AS token FROM kinds)
           JOIN fixed USING (leaf, pos, token) GROUP BY leaf, line, w HAVING 100 * count(*) FILTER (WHERE token <> '<*>') >= 60 * len(w)),
total AS (SELECT leaf, template, arg_min(text, doc_id) AS owner FROM shaped JOIN lines USING (leaf, line)
          GROUP BY ALL HAVING count(DISTINCT text) >= 10),
gone AS (SELECT leaf, line, owner FROM shaped JOIN total USING (leaf, template)),
drops AS (SELECT DISTINCT l.doc_id, l.text, l.nth FROM lines l JOIN gone g ON l.leaf = g.leaf AND l.line = g.line AND l.text <> g.owner),
kept AS (SELECT c.doc_id, c.text, string_agg(c.line, chr(10) ORDER BY c.nth) AS new, count(*) AS n
         FROM cut c ANTI JOIN drops d ON c.doc_id = d.doc_id AND c.text = d.text AND c.nth = d.nth GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.new, '') END AS text,
       CASE WHEN coalesce(k.new, '') = '' THEN 0 ELSE k.n END AS n_lines,
       len(string_split(d.text, chr(10))) AS n_lines_before
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""


def _starts(rule: Rule, i: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{rule.kind}' AS kind, {i} AS rank, unnest(list_transform(range(1, len(hit) + 1), lambda j:
       {{'start': list_sum([length(x) FOR x IN gap[1:j]]) + coalesce(list_sum([length(x) FOR x IN hit[1:j - 1]]), 0),
         'size': length(hit[j]), 'checked': length(part[j])}})) AS s
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hit, regexp_extract_all(t, '{pattern}', {rule.group}) AS part,
             string_split_regex(t, '{pattern}') AS gap FROM texts WHERE regexp_matches(t, '{pattern}'))"""


def _secrets() -> str:
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    found = "\nUNION ALL".join(_starts(r, i) for i, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    each = "kind || ':' || (s.start)::BIGINT || ':' || (s.start + s.size)::BIGINT"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
good AS (SELECT * FROM found WHERE s.checked >= CASE kind {least} END),
told AS (SELECT doc_id, {counts}, string_agg({each}, ',' ORDER BY s.start, rank) FILTER (WHERE kind IN ({base})) AS base,
                string_agg({each}, ',' ORDER BY s.start, rank) AS spans FROM good GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)
"""


OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                                     FOR x IN {WORDS}] AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
               range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
sets AS (SELECT doc_id, len(s) AS n, s FROM shingled),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS class_id FROM sets WHERE n > 0 GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept, coalesce(class_id, doc_id) AS class_id
FROM sets JOIN comp USING (doc_id) LEFT JOIN classes c ON list_sort(sets.s) = c.s AND n > 0
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i,
                   unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM windows JOIN twice USING (doc_id, g)) GROUP BY doc_id),
base AS (SELECT doc_id, host, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
                coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
cut AS (SELECT doc_id, host, t, regexp_extract_all(unnest(lines), '[^\x20\x09-\x0D]+') AS w FROM judged),
normal AS (SELECT doc_id, host, t, regexp_replace(lower(array_to_string(w, ' ')), '[0-9]+', '0', 'g') AS line, len(w) AS n
           FROM cut WHERE len(w) >= 4),
frequent AS (SELECT host, line, arg_min(t, doc_id) AS owner FROM normal GROUP BY ALL HAVING count(DISTINCT t) > 10),
removed AS (SELECT doc_id, sum(n)::BIGINT AS r FROM normal JOIN frequent USING (host, line) WHERE t <> owner GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(r, 0) > 0 AND n_words - coalesce(r, 0) < 10) AS kept,
       coalesce(r, 0) AS removed_words, coalesce(r, 0) > 0 AND n_words - coalesce(r, 0) < 10 AS depleted
FROM judged LEFT JOIN removed USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i,
                   unnest(list_transform(range(1, greatest(len(w) - 18, 1)), lambda i: array_to_string(w[i:i + 19], ' '))) AS g FROM d),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP12 = r"""
WITH RECURSIVE turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                      {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(t ORDER BY pos) AS l FROM turns GROUP BY conv_id),
bits AS (SELECT range::UBIGINT AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
         UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT conv_id, conv_id::VARCHAR AS s, 4294967295::UBIGINT AS c, 0 AS k FROM whole
        UNION ALL SELECT conv_id, s, xor(crc.c >> 8, b.c), crc.k + 1 FROM crc
        JOIN bits b ON b.k = 8 AND b.i = xor(crc.c & 255, ascii(s[crc.k + 1])::UBIGINT) WHERE crc.k < length(s)),
heads AS (SELECT conv_id, (xor(c, 4294967295) % 9)::BIGINT AS h FROM crc WHERE k = length(s)),
built AS (SELECT w.conv_id, list_concat(coalesce(f.l[1:h], []), w.l[h + 1:]) AS l
          FROM whole w JOIN heads USING (conv_id) LEFT JOIN whole f ON f.conv_id = w.conv_id - w.conv_id % 5),
steps AS (SELECT conv_id, d, l[1:d] AS p, len(l) = d AS ends FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended FROM steps GROUP BY p, d),
parts AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
costed AS (SELECT n.*, coalesce(c.n, 0) AS n_children,
                  CASE WHEN d > 0 THEN (n_convs - 1) * strlen(n.p[d].text) ELSE 0 END AS cost
           FROM nodes n LEFT JOIN parts c ON n.p = c.p),
sums AS (SELECT p[1:k] AS p, sum(cost)::BIGINT AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
         FROM (SELECT *, unnest(range(d + 1)) AS k FROM costed) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved AS saved_tokens,
       sha256(coalesce(n.ended, '')) AS ends_sha256
FROM costed n JOIN sums s ON n.p = s.p LEFT JOIN nodes u ON n.d > 0 AND u.p = n.p[1:n.d - 1]
"""

OP13 = r"""
WITH terms AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT doc_id, t, len(t) AS n FROM terms WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
            FROM tf, total GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id HAVING score > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op4_secret_scan": _secrets(),
    "op5_near_duplicates": OP5,
    "op7_quality_rules": OP7,
    "op8_substring_dedup": OP8,
    "op12_prefix_trie": OP12,
    "op13_lexical_search": OP13,
}
