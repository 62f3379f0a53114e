"""SQL for DuckDB that recomputes those queries of the package that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
           r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT rid, {rank} AS rank, '{kind}' AS kind, v[i] AS val,
           (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(h[i]) AS n
    FROM (SELECT rid, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d),
         unnest(range(1, len(h) + 1)) AS u(i)
    WHERE length(v[i]) >= {least}"""


OP2 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents),
base AS MATERIALIZED ({_kind(0, 'assign', _ASSIGN, 2, 6)} UNION ALL {_kind(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_kind(2, 'hex', '[0-9a-f]+', 0, 24)}),
tokens AS ({_kind(3, 'owned', '[A-Za-z0-9+/_=-]+', 0, 20)}),
more AS MATERIALIZED (SELECT * FROM tokens m WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.s < m.s + m.n AND m.s < b.s + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
held AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM every JOIN d USING (rid) GROUP BY val),
spans AS (SELECT e.*, owners, repos, owners >= 3 OR repos >= 6 AS copied, kind || ':' || s || ':' || (s + n) AS span FROM every e JOIN held USING (val)),
found AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS x,
    coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
    coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3 OR owners = 1 AND NOT copied), '') AS spans,
    count(*) FILTER (owners = 1 AND NOT copied) AS live, count(*) FILTER (copied AND rank < 3) AS example, max(repos) FILTER (rank < 3 OR owners = 1 AND NOT copied) AS repos FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example, coalesce(repos, 0) AS n_repos
FROM d LEFT JOIN found USING (rid)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP3 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS MATERIALIZED (SELECT rid, i, n, item_id FROM grams JOIN win USING (n, s)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY rid),
lists AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN lists USING (rid)
"""

_CRLF = "chr(13) || chr(10)"
_RECORD = (f"'WARC/1.1' || {_CRLF} || 'WARC-Type: response' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '')"
           f" || {_CRLF} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || {_CRLF} || {_CRLF} || coalesce(html, '') || {_CRLF} || {_CRLF}")
OP5 = f"""
WITH theirs_raw AS (
    SELECT page_id, url, CASE WHEN page_id % 97 = 7 THEN substring(html, 1, length(html) // 2) || chr(1) || substring(html, length(html) // 2 + 2)
        WHEN page_id % 193 = 11 THEN substring(html, 1, length(html) - 1) ELSE html END AS html FROM pages WHERE page_id % 389 <> 13
    UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 401 = 17),
ours AS (SELECT page_id, octet_length(encode({_RECORD})) AS length, sha256({_RECORD}) AS digest FROM pages),
theirs AS (SELECT page_id, octet_length(encode({_RECORD})) AS length, sha256({_RECORD}) AS digest FROM theirs_raw),
placed AS MATERIALIZED (SELECT *, floor(page_id / 4096)::BIGINT AS archive, floor(page_id / 256)::BIGINT AS section, floor(page_id / 16)::BIGINT AS block,
    (sum(length) OVER (PARTITION BY floor(page_id / 4096) ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS off FROM ours),
ranges AS (SELECT archive, section, block,
    min(min(off)) OVER (PARTITION BY archive) || '-' || max(max(off + length)) OVER (PARTITION BY archive) AS ra,
    min(min(off)) OVER (PARTITION BY section) || '-' || max(max(off + length)) OVER (PARTITION BY section) AS rs,
    min(off) || '-' || max(off + length) AS rb FROM placed GROUP BY archive, section, block)
SELECT floor(coalesce(a.page_id, b.page_id) / 4096)::BIGINT AS archive, coalesce(a.page_id, b.page_id) AS page_id, 0 AS copy,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' ELSE 'changed' END AS status,
       a.off AS "offset", a.length, a.digest, b.length AS replica_length, b.digest AS replica_digest,
       CASE WHEN r.ra IS NULL THEN '' ELSE r.ra || '/' || r.rs || '/' || r.rb END AS ranges
FROM placed a FULL JOIN theirs b ON a.page_id = b.page_id LEFT JOIN ranges r ON r.block = a.block
WHERE a.digest IS DISTINCT FROM b.digest
"""

_WORD = r"[^\x20\x09-\x0D]+"
OP7 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, o = na.n AND o = nb.n AS same FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id),
copies AS (SELECT a AS doc_id, min(b) AS m, count(*) AS c FROM links WHERE same GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.m, d.doc_id)) AS class_id,
       coalesce(c, 0) + 1 AS n_copies
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ l USING (doc_id) LEFT JOIN copies c USING (doc_id)
"""

#: As OP7, with the number of other sets that the document's set links to.
OP7_LINKS = f"""
WITH x AS MATERIALIZED ({OP7}),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, count(DISTINCT y.class_id) AS k FROM pairs JOIN x ON x.doc_id = a JOIN x y ON y.doc_id = b
           WHERE x.class_id <> y.class_id AND 100 * o >= 85 * (x.n_shingles + y.n_shingles - o) GROUP BY a)
SELECT x.*, coalesce(k, 0)::BIGINT AS n_links FROM x LEFT JOIN linked ON a = x.doc_id
"""

OP9 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT rid, p FROM win JOIN again USING (s), unnest(range(i, i + 35)) AS u(p)),
words AS MATERIALIZED (SELECT rid, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
counts AS (SELECT rid, count(*) AS c, count(*) FILTER (first) AS spans FROM (SELECT rid, p, p - lag(p) OVER (PARTITION BY rid ORDER BY p) IS DISTINCT FROM 1 AS first FROM gone) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid)
"""

#: crc32 of a text's bytes, step by step over a table made by the rule of the polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i))"
_BYTES = "list_transform(range(1, length(hex(encode(x))), 2), lambda i: 16 * (instr('0123456789ABCDEF', hex(encode(x))[i]) - 1) + instr('0123456789ABCDEF', hex(encode(x))[i + 1]) - 1)"
OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents),
b AS MATERIALIZED (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark),
f AS MATERIALIZED (SELECT rid, array_to_string(w[i:i + n - 1], ' ') AS x, count(*) AS c FROM d, (VALUES (1), (2), (3)) AS o(n), unnest(range(1, len(w) - n + 2)) AS u(i) GROUP BY ALL),
g AS MATERIALIZED (SELECT array_to_string(w[i:i + n - 1], ' ') AS x, count(*) AS c FROM b, (VALUES (1), (2), (3)) AS o(n), unnest(range(1, len(w) - n + 2)) AS u(i) GROUP BY ALL),
tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
bucket AS MATERIALIZED (SELECT x, xor(4294967295, list_reduce({_BYTES}, lambda c, y: xor(tab[xor(c, y) % 256 + 1], c >> 8), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT x FROM (SELECT x FROM f UNION ALL SELECT x FROM g)), tab),
s AS (SELECT bucket, sum(c) AS s FROM f JOIN bucket USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM g JOIN bucket USING (x) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
    FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weight AS (SELECT rid, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM f JOIN bucket USING (x) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight USING (rid)),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE may),
drawn AS (SELECT * FROM ranked WHERE rank <= (SELECT count(*) * 5 // 100 FROM scored WHERE may))
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, rank::BIGINT AS rank FROM scored LEFT JOIN drawn USING (rid)
"""

OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
x AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
y AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM y
"""

SQL = {"op2_secret_scans": OP2, "op3_benchmark_decontamination": OP3, "op5_warc_fixity": OP5, "op7_ngram_jaccard_join": OP7, "op7_ngram_jaccard_links": OP7_LINKS,
       "op9_substring_dedup": OP9, "op11_importance_resampling": OP11, "op12_minhash_dedup": OP12, "op13_fill_in_middle": OP13}
