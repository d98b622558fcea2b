"""DuckDB SQL for the queries that SQL can express; written apart from the operators."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

CONTAMINATION = rf"""
WITH worded AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM worded CROSS JOIN lengths)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


#: CRC-32 of the decimal id, bit by bit; the constants are the polynomial and the start of that checksum.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PERIODIC_RUNS = rf"""
WITH marked AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents)),
shifted AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM marked),
texts AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT)]) AS w
    FROM (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM shifted)),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
-- A run holds four words q apart, at multiples of q: they name the lags worth a full comparison.
lattice AS (SELECT doc_id, q, unnest(range((n - 1) // q + 1)) * q AS i FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM texts)),
combs AS (SELECT doc_id, q, word, lead(word, 1) OVER r AS w1, lead(word, 2) OVER r AS w2, lead(word, 3) OVER r AS w3
    FROM lattice JOIN words USING (doc_id, i) WINDOW r AS (PARTITION BY doc_id, q ORDER BY i)),
lags AS (SELECT DISTINCT doc_id, q FROM combs WHERE word = w1 AND word = w2 AND word = w3),
same AS (SELECT doc_id, q, x.i, row_number() OVER (PARTITION BY doc_id, q ORDER BY x.i) AS k
    FROM lags JOIN words x USING (doc_id) JOIN words y USING (doc_id) WHERE y.i = x.i + q AND x.word = y.word),
stretches AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM same GROUP BY doc_id, q, i - k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _piece(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_piece(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


MANIFEST = rf"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, i, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2),
trees AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
forest AS (SELECT 0 AS level, i, n, subroot AS digest FROM trees
    UNION ALL SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i)) FROM forest WHERE n > 1 GROUP BY level, i // 2),
levels AS (SELECT DISTINCT tree, level FROM nodes WHERE n > 1),
paths AS (SELECT tree, i, level, xor(i >> level, 1) AS beside, (i >> level) % 2 = 1 AS is_right FROM placed JOIN levels USING (tree)),
steps AS (SELECT p.tree, p.i, list(CASE WHEN x.digest IS NULL THEN 'N' WHEN is_right THEN 'L' || x.digest ELSE 'R' || x.digest END ORDER BY p.level) AS steps
    FROM paths p LEFT JOIN nodes x ON x.tree = p.tree AND x.level = p.level AND x.i = p.beside GROUP BY p.tree, p.i),
high AS (SELECT t.tree, list(CASE WHEN x.digest IS NULL THEN 'N' WHEN (t.i >> l.level) % 2 = 1 THEN 'L' || x.digest ELSE 'R' || x.digest END ORDER BY l.level) AS steps
    FROM trees t CROSS JOIN (SELECT DISTINCT level FROM forest WHERE n > 1) l LEFT JOIN forest x ON x.level = l.level AND x.i = xor(t.i >> l.level, 1) GROUP BY t.tree),
proved AS (SELECT doc_id, leaf, shown, subroot, (SELECT digest FROM forest WHERE n = 1) AS root,
    list_concat(coalesce(s.steps, []), coalesce(h.steps, [])) AS steps
    FROM placed p JOIN trees USING (tree) LEFT JOIN steps s ON s.tree = p.tree AND s.i = p.i LEFT JOIN high h ON h.tree = p.tree),
checked AS (SELECT *, list_reduce(list_prepend(shown, steps), lambda d, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || d WHEN 'R' THEN d || s[2:] ELSE d END)) AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(steps, lambda s: s[2:])), 'string_agg', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM checked
"""

REPEATED_WINDOWS = rf"""
WITH worded AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM worded)),
first AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN first USING (g) WHERE doc_id > least),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
    FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM worded) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op1_jaccard_join": JACCARD,
    "op9_decontaminate": CONTAMINATION,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_manifest": MANIFEST,
    "op13_substring_dedup": REPEATED_WINDOWS,
}
