"""DuckDB oracles of the training-data queries."""

SQL = {
    "op8_line_dedup": r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
held AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 AND doc_id IS NOT NULL
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (k) GROUP BY doc_id
""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM cut WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
best AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN best ON best.a = d.doc_id
""",
    "op2_source_mixing": r"""
WITH total AS (SELECT 1.25 * count(*) AS budget FROM documents),
weights(named, w) AS (VALUES ('src0', 0.2::DOUBLE), ('src1', 0.1::DOUBLE), ('src2', 0.05::DOUBLE)),
grouped AS (SELECT d.doc_id, d.source, d.text, w.named FROM documents d LEFT JOIN weights w ON d.source = w.named),
rates AS (
  SELECT g.named, any_value(coalesce(w.w, 1.0::DOUBLE - (0.2::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE))) * any_value(budget) / count(*) AS rate
  FROM grouped g LEFT JOIN weights w ON w.named IS NOT DISTINCT FROM g.named CROSS JOIN total GROUP BY g.named),
steps AS (
  SELECT named, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY named ORDER BY k) AS cdf, k
  FROM rates CROSS JOIN (SELECT unnest(range(0, 80))::DOUBLE AS k)),
drawn AS (
  SELECT doc_id, source, text, named,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM grouped),
counted AS (
  SELECT d.doc_id, d.source, any_value(d.text) AS text, count(*) FILTER (WHERE s.cdf <= d.u) AS n
  FROM drawn d JOIN steps s ON s.named IS NOT DISTINCT FROM d.named GROUP BY d.doc_id, d.source)
SELECT doc_id, source, text, "copy"::INT AS "copy", md5('mix order|' || doc_id::VARCHAR || '|' || "copy"::VARCHAR) AS shuffle_key
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS "copy" FROM counted WHERE n > 0)
""",
    "op1_mtree_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op4_url_filter": r"""
WITH terms(term, weight) AS (VALUES ('adult', 0), ('casino', 0), ('hentai', 0), ('porn', 0), ('porno', 0), ('xxx', 0), ('escort', 0), ('warez', 0), ('malware', 0), ('phishing', 0), ('spam', 1), ('farm', 1), ('cheap', 1), ('pills', 1), ('free', 1), ('bets', 1), ('bet', 1), ('betting', 1), ('win', 1), ('ads', 1), ('track', 1), ('tracker', 1), ('viagra', 1), ('poker', 1), ('slots', 1), ('loan', 1), ('loans', 1), ('sex', 1), ('dating', 1), ('torrent', 1), ('crack', 1), ('keygen', 1), ('replica', 1), ('clickbait', 1)),
rules(kind, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fitting AS (
  SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(kind, length(h) * 1000 + length(p)) AS kind
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
hits AS (
  SELECT page_id,
         coalesce(sum(len(regexp_extract_all(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))) FILTER (WHERE weight = 0), 0)::INT AS strict_hits,
         coalesce(sum(weight) FILTER (WHERE weight > 0), 0)::INT AS soft_hits
  FROM parts JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY page_id)
SELECT page_id, host, path, rule,
       CASE WHEN kind IS NOT NULL THEN kind WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits
FROM parts LEFT JOIN fitting USING (page_id) LEFT JOIN hits USING (page_id)
""",
    "op11_prefix_trie": r"""
WITH stored AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list(turn ORDER BY pos) AS turns,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h
  FROM stored GROUP BY c),
built AS (
  SELECT own.c, list_concat(coalesce(base.turns[1:own.h], []), own.turns[own.h + 1:]) AS s
  FROM own LEFT JOIN own base ON base.c = own.c - own.c % 5),
members AS (SELECT c, s, s[1:d] AS p FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, len(p) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(s) = len(p)), '')) AS ends_sha256
  FROM members GROUP BY p),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
weighed AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(nodes.p[depth].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN children ON children.p = nodes.p),
sums AS (
  SELECT p[1:d] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT p, n_children, saved, unnest(range(depth + 1)) AS d FROM weighed) GROUP BY 1)
SELECT w.conv_id, w.depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM weighed w JOIN sums ON sums.p = w.p LEFT JOIN nodes parent ON w.depth > 0 AND parent.p = w.p[1:w.depth - 1]
""",
    "op12_substring_dedup": r"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS passage
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM cut WHERE doc_id IS NOT NULL)),
repeated AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + j AS i FROM repeated, (SELECT unnest(range(50)) AS j)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut),
kept AS (
  SELECT words.r, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM words LEFT JOIN gone ON gone.r = words.r AND gone.i = words.i GROUP BY words.r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (r)
""",
    "op13_ranked_search": r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM cut WHERE len(w) > 0),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM cut) GROUP BY r, term),
spread AS (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM cut, total WHERE len(w) > 0 AND doc_id IS NOT NULL),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN spread USING (term) JOIN held USING (term) JOIN sized USING (r), total GROUP BY item_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
