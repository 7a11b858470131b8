"""DuckDB twins of the queries that SQL can express."""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT item, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS gram
  FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT row_no, n, unnest(range(1, len(w) - n + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
  FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT row_no, pos, n, item FROM grams JOIN windows USING (n, gram)),
words AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY row_no),
items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""

URL_FILTERS = r"""
WITH rules(host, path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, url, host, path,
       (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
       coalesce((SELECT max_by(r.action, length(r.host || r.path)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p
"""

WARC = r"""
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, i * 5 + 1, 5))::INT >> s) & 31) + 1 AS BIGINT), 1)), '')), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS ok
FROM f
"""

#: Each level of the trees from the one below; then each leaf's way up, its digest replaced where its row is tampered with.
MANIFEST = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rn, doc_id, lang, n_chars, {before} || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || {after} AS cells,
    {before} || coalesce(octet_length(encode(CAST(n_chars::HUGEINT + 1 AS VARCHAR))) || ':' || (n_chars::HUGEINT + 1), '-') || {after} AS other,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT rn, doc_id, coalesce('+' || lang, '') AS grp, sha256(cells) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(other) ELSE sha256(cells) END AS new
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree(grp, lvl, pos, n, digest) AS (
  SELECT grp, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 2, (n + 1) // 2),
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, (n + 1) // 2),
way(rn, grp, lvl, pos, n, proof, now) AS (
  SELECT rn, grp, 0, pos, n, '', new FROM placed
  UNION ALL
  SELECT w.rn, w.grp, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN w.pos % 2 = 0 THEN w.now || coalesce(s.digest, '') ELSE s.digest || w.now END)
  FROM way w LEFT JOIN tree s ON s.grp = w.grp AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
over(rn, lvl, pos, n, proof, now) AS (
  SELECT w.rn, 0, r.pos, r.n, w.proof, w.now FROM way w JOIN subroots r USING (grp) WHERE w.n = 1
  UNION ALL
  SELECT w.rn, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN w.pos % 2 = 0 THEN w.now || coalesce(s.digest, '') ELSE s.digest || w.now END)
  FROM over w LEFT JOIN top s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(o.proof) AS proof_sha256, o.now AS folded_root, o.now = t.digest AS verified
FROM placed p JOIN subroots r USING (grp) JOIN (SELECT rn, proof, now FROM over WHERE n = 1) o USING (rn), (SELECT digest FROM top WHERE n = 1) t
""".format(
    before=" || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang")),
    after="coalesce(octet_length(encode(text)) || ':' || text, '-')")
