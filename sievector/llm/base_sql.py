"""SQL of what SQL can express of the ten operators: whole results, or the columns that their contracts fix."""

from __future__ import annotations

#: What separates words, what letters and digits are made of, and the letters that are folded.
SPACE = r"[\x20\x09-\x0D]"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda x: x <> '')"


#: crc32 of each id's text, a bit a step.
CRC = """RECURSIVE step(doc_id, s, k, c) AS (SELECT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents
UNION ALL SELECT doc_id, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE c END AS x FROM step WHERE k < 8 * length(s))),
crc AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM step WHERE k = 8 * length(s))"""

LM = f"""WITH {CRC}, t AS (SELECT doc_id, crc % 10 = 0 AS held_out, {words(FOLDED)} AS w FROM documents JOIN crc USING (doc_id)),
u AS (SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS w FROM t), c AS (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 6) AS base_score
FROM u LEFT JOIN c USING (w), n GROUP BY ALL"""

_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_HITS = " UNION ALL ".join(f"SELECT doc_id, place, '{label}' AS label FROM f WHERE " + " AND ".join(f"{f'x{i}' if i else 'x'} = '{w}'" for i, w in enumerate(p.split())) for p, label in _PHRASES.items())
LICENCES = f"""WITH t AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{LETTERS}') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS place FROM t),
f AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY place)), h AS ({_HITS}),
b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM t LEFT JOIN b USING (doc_id)"""

RULES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM d, (SELECT unnest(range(8)) AS j) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m"""

NEAR = f"""WITH RECURSIVE t AS (SELECT doc_id, {words(FOLDED)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
 GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach), c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

EDITED = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(first_value(text) OVER (ORDER BY doc_id), '') AS head, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS next FROM documents),
x AS (SELECT doc_id, text, length(text) AS n, coalesce(next, head) AS next FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(text, 1, n - n // 4) || substr(next, 1, n // 4)) AS edited_sha256 FROM x"""
