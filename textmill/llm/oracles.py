"""DuckDB SQL for the queries that SQL can express on the test tables."""

from __future__ import annotations

from textmill.llm.license_scan import TEMPLATES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _words(c: str) -> str:
    return _WORDS.format(c)


#: The distinct shingles of every document, and its number of them.
_SETS = f"""w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id)"""

OP4 = f"""WITH RECURSIVE {_SETS}, p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n_shingles + j.n_shingles - c)),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.z) SELECT doc_id, n_shingles, min(z) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles"""

#: Benchmark items of five words or more: windows of documents that share a shingle with the item.
OP2 = f"""WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, {_words("coalesce(text, '')")} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(range(len(w) - 4)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS sh FROM d WHERE len(w) >= 5),
bs AS (SELECT item_id, len(w) - 4 AS m, sh, count(*) AS c FROM (SELECT item_id, w, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS sh FROM b WHERE len(w) >= 5) GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, item_id, least(m, len(w) - 4) AS m, m AS items, len(w) - 4 AS n FROM ds JOIN bs USING (sh) JOIN d USING (doc_id)),
v AS (SELECT doc_id, item_id, m, items, unnest(range(n - m + 1)) AS start FROM p),
c AS (SELECT v.doc_id, v.item_id, v.start, v.m, v.items, ds.sh, count(*) AS c FROM v JOIN ds ON ds.doc_id = v.doc_id AND ds.i >= v.start AND ds.i < v.start + v.m GROUP BY ALL),
o AS (SELECT c.doc_id, c.item_id, c.start, c.m, c.items, sum(least(c.c, bs.c)) AS shared FROM c JOIN bs ON bs.item_id = c.item_id AND bs.sh = c.sh GROUP BY ALL),
q AS (SELECT doc_id, item_id, start, m + 4 AS n_words, shared::DOUBLE / (m + items - shared)::DOUBLE AS similarity FROM o)
SELECT doc_id, item_id, start AS start_word, n_words, similarity FROM q WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

OP8 = r"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM t),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l), k AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM w),
r AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= 3 GROUP BY 1, 2 UNION SELECT b.doc_id, max(a.i), b.i FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= 3 GROUP BY b.doc_id, b.i),
c AS (SELECT r.doc_id, r.a, r.b, string_agg(l.line, chr(10) ORDER BY l.i) AS content FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b GROUP BY ALL),
f AS (SELECT *, min(doc_id * 1000000 + a) OVER (PARTITION BY content) AS first FROM c), g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM f WHERE doc_id * 1000000 + a > first),
x AS (SELECT l.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS kept FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT doc_id, n_removed, length(kept)::BIGINT AS n_chars_kept, md5(kept) AS kept_md5 FROM x"""


def _op10() -> str:
    """All grid windows of all documents that share a shingle with a template: neither keywords nor MinHashes."""
    known = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in TEMPLATES.items())
    return f"""WITH k(license_id, text) AS (VALUES {known}), t AS (SELECT license_id, {_words("text")} AS w, len(w) AS size, greatest(1, len(w) // 8) AS stride FROM k),
ts AS (SELECT DISTINCT license_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS sh FROM t), tn AS (SELECT license_id, count(*) AS total FROM ts GROUP BY 1),
d AS (SELECT doc_id, {_words("text")} AS w, len(w) AS n FROM documents), ds AS (SELECT doc_id, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(1, n - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS sh FROM d WHERE n >= 5),
h AS (SELECT doc_id, license_id, n, i, sh, size, stride, greatest(n - size, 0) AS last FROM ds JOIN ts USING (sh) JOIN t USING (license_id)),
v AS (SELECT DISTINCT doc_id, license_id, unnest(list_append(list_transform(range(greatest(0, (i + 5 - size - stride) // stride), (i + stride) // stride + 1), lambda k: least(k * stride, last)), last)) AS start FROM h),
c AS (SELECT h.doc_id, h.license_id, v.start, count(DISTINCT sh) AS c FROM v JOIN h ON h.doc_id = v.doc_id AND h.license_id = v.license_id AND h.i >= greatest(v.start - h.stride, 0) AND h.i + 5 <= least(h.n, v.start + h.size + h.stride) GROUP BY ALL)
SELECT doc_id, license_id, max(c)::DOUBLE / any_value(total) AS containment FROM c JOIN tn USING (license_id) GROUP BY doc_id, license_id HAVING max(c)::DOUBLE / any_value(total) >= 0.75"""


ORACLE_SQL: dict[str, str] = {"op2_decontaminate": OP2, "op4_jaccard_join": OP4, "op8_line_dedup": OP8, "op10_license_scan": _op10()}
