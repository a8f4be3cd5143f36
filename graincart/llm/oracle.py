"""SQL for the corpus operators whose rows SQL can express, for DuckDB."""

from __future__ import annotations

from graincart.llm.secrets import BASE, RULES

_TEXT = "coalesce(text, '')"


def secrets_sql() -> str:
    """Spans of each rule from what stands between its matches."""
    found = []
    for place, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        found.append(
            f"""SELECT doc_id, t, {place} AS place, '{r.kind}' AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS wholes,
            regexp_extract_all(t, '{p}', {r.group}) AS parts, {r.least} AS least FROM d WHERE regexp_matches(t, '{p}')"""
        )
    of = lambda kinds: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place){kinds}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents), f AS ({' UNION ALL '.join(found)}),
    u AS (SELECT doc_id, place, kind, least, gaps, wholes, parts, unnest(range(1, len(wholes) + 1)) AS i FROM f),
    s AS (SELECT doc_id, place, kind, length(parts[i]) >= least AS ok, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda x: length(x))), 0) AS a, length(wholes[i]) AS n FROM u),
    k AS (SELECT doc_id, place, kind, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM s WHERE ok AND n > 0),
    g AS (SELECT doc_id, {counts}, {of(f" FILTER (place < {len(BASE)})")} AS base, {of("")} AS spans FROM k GROUP BY 1)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


CONTAMINATION = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

#: Sizes and targets of the mix, and which words are taken: the whole order of keys in one window.
MIX = r"""WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  1.0::DOUBLE - 0.75::DOUBLE * (length(text) - length(translate(text, '0123456789|{}<>[]=_#*~^\@$%+/&;', ''))) / greatest(length(text), 1) AS weight,
  (('0x' || substr(md5('0' || chr(31) || doc_id || chr(31) || text), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, least(greatest(floor((1.0::DOUBLE - exp(ln(u) / weight)) * 281474976710656.0::DOUBLE)::BIGINT, 0), 281474976710655) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
r AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT arg_min(level, cap / w) FILTER (level * w <= cap) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, m.level * w), cap) AS target FROM l, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
o AS (SELECT k.*, source_size, target, passes, target - passes * source_size AS lft, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(least(size, round(lft - before)), 0))::BIGINT AS taken FROM o"""

#: All pairs that share a shingle, and the closure of those similar enough.
NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x, min(y) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, d.doc_id = coalesce(m.m, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""

#: crc32 bit by bit over the digits of a conv_id (its polynomial is a fixed value), the rebuilt conversations, and all prefixes as texts.
TRIE = r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, chr(1) || coalesce(role, '') || chr(2) || coalesce(text, '') AS x,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT conv_id, s, n, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM c0 UNION ALL
  SELECT conv_id, s, n, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, CAST(ascii(s[k // 9 + 1]) AS BIGINT)) WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END FROM r WHERE k < 9 * length(s)),
c AS (SELECT conv_id, n, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM r WHERE k = 9 * length(s)),
b AS (SELECT c.conv_id, c.h, least(c.h, coalesce(f.n, 0)) AS b, greatest(c.n - c.h, 0) + least(c.h, coalesce(f.n, 0)) AS size FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % 20),
u AS (SELECT b.conv_id, i - h + b AS d, x, words FROM b JOIN t USING (conv_id) WHERE i > h UNION ALL SELECT b.conv_id, i, x, words FROM b JOIN t ON t.conv_id = b.conv_id - b.conv_id % 20 WHERE i <= b),
p AS (SELECT conv_id, d, words, sha256(string_agg(x, '') OVER w) AS k, coalesce(sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS up FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY d)
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM b),
e AS (SELECT p.*, size = d AS last FROM p JOIN b USING (conv_id)),
g AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
n AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN n USING (d, k)),
a AS (SELECT DISTINCT x.d, x.k, y.d AS d2, y.k AS k2 FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d),
s AS (SELECT a.d, a.k, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.words) AS BIGINT) AS saved_tokens FROM a JOIN m ON m.d = d2 AND m.k = k2 GROUP BY 1, 2)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256 FROM m JOIN s ON s.d = m.d AND s.k = m.k LEFT JOIN m f ON f.d = m.d - 1 AND f.k = m.up"""
