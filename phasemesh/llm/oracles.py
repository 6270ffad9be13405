"""DuckDB SQL of the queries that SQL can express."""

_COMPONENTS = """
, walk(a, b) AS (SELECT a, b FROM edges UNION SELECT w.a, e.b FROM walk w JOIN edges e ON e.a = w.b)
, lowest AS (SELECT a, min(b) m FROM walk GROUP BY a)
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n FROM pages)
, t AS (SELECT page_id, n, sha1(h) d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END m FROM p)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, d payload_digest, CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN page_id < m THEN m END refers_to FROM t
"""

OP2 = """
WITH s AS (SELECT source, sum(length(text)) size FROM documents GROUP BY source)
, t AS (SELECT sum(size) a, sum(sqrt(size)) b FROM s)
, r AS (SELECT source, a * sqrt(size) / b / size rate FROM s, t)
, c AS (
  SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) cum
  FROM (SELECT source, rate, unnest(generate_series(0, 120)) k FROM r))
, d AS (SELECT doc_id, source, (CAST('0x' || substr(md5('7:' || doc_id || ':1'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 u FROM documents)
, n AS (SELECT doc_id, d.source, count(*) n FROM d JOIN c ON c.source = d.source AND cum < u GROUP BY ALL)
, x AS (SELECT doc_id, source, CAST(unnest(generate_series(1, n)) AS INTEGER) copy FROM n)
SELECT doc_id, source, CAST(1 AS INTEGER) part, copy, md5('shuffle:7:' || doc_id || ':1:' || copy) shuffle_key FROM x
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] ws
  FROM documents)
, s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) i FROM w WHERE len(ws) > 0))
, n AS (SELECT doc_id, count(*) c FROM s GROUP BY doc_id)
, p AS (SELECT x.doc_id a, y.doc_id b, count(*) i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
, l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.c + nb.c - i))
, edges AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
{_COMPONENTS}
SELECT d.doc_id, coalesce(n.c, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, d.doc_id <= coalesce(m, d.doc_id) kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON a = d.doc_id
"""

OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
, edges AS (SELECT x.vec_id a, y.vec_id b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93)
{_COMPONENTS}
, c AS (SELECT a, count(*) n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP9 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END r FROM pages)
, h AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM u)
, rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
, f AS (
  SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(rh, '.')) DESC, length(rp) DESC) k
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND k = 1
"""

OP10 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') x, [w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] ws FROM documents)
, g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) i FROM t WHERE len(ws) > 8))
, r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) c FROM g) WHERE c > 1)
, q AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nxt FROM r) GROUP BY doc_id)
, l AS (
  SELECT doc_id, count(*) n, count(*) - count(DISTINCT line) d FROM (SELECT doc_id, unnest(string_split(x, chr(10))) line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
, st AS (SELECT doc_id, count(*) n FROM (SELECT doc_id, ws, unnest(generate_series(2, len(ws))) i FROM t WHERE len(ws) > 1) WHERE ws[i] = ws[i - 1] GROUP BY doc_id)
, m AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) n_lines,
    CAST(coalesce(l.d, 0) AS BIGINT) n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) n_repeat_words, coalesce(st.n, 0) n_stutter,
    length(regexp_replace(x, '[^A-Za-z]+', '', 'g')) n_letters, length(regexp_replace(x, '[^A-Z]+', '', 'g')) n_upper
  FROM t LEFT JOIN q USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN st USING (doc_id))
, f AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END) + (CASE WHEN 10 * n_stutter > 3 * n_words THEN 128 ELSE 0 END) AS INTEGER) failed FROM m)
, a(mask, alone) AS (VALUES (1, 'few_words'), (2, 'repeated_windows'), (4, 'symbols'), (8, 'duplicate_lines'), (16, 'short_words'), (32, 'long_words'), (64, 'upper_case'), (128, 'stutter'))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 base_failed, failed = 0 kept, failed,
  'default' policy, CAST(1 AS INTEGER) policy_version, alone, CASE WHEN alone IS NOT NULL THEN count(*) OVER (PARTITION BY failed) END alone_docs
FROM f LEFT JOIN a ON mask = failed
"""

#: Costs, letters and repaired text of the cheapest way to each state (start, s, u, a), row by row.
OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(generate_series(0, 7), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT)) FOR b IN generate_series(0, 255)] tab)
, d AS (
  SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ord(x) AS BIGINT)) b
  FROM conversations)
, h AS (
  SELECT conv_id, turn, role, txt, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 k FROM d, crc)
, g AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END txt,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) copy
  FROM h WHERE k <> 0)
, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(txt), copy) i FROM g)
, q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) seen, regexp_replace(txt, '[\x20\x09-\x0D]+$', '') bare FROM o)
, r AS (
  SELECT conv_id, i, turn, role, txt, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' ELSE '' END f,
    substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) pair
  FROM q)
, c AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) gaps, count(*) FILTER (f = 'blank') blank, count(*) FILTER (f = 'duplicate') duplicate,
    count(*) FILTER (f = 'truncated') truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal,
    list({'n': substr(role, 1, 1), 'x': f IN ('blank', 'duplicate'), 'e': CASE WHEN f = 'truncated' THEN 3 ELSE 0 END, 't': role || ':' || txt, 'p': txt} ORDER BY i) l
  FROM r GROUP BY conv_id)
, walk AS (
  SELECT conv_id, 0 i, {'c': 0, 'a': '', 'r': ''} z, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) s, {'c': 3, 'a': 'I', 'r': chr(10) || 'user:'} u,
    {'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} a FROM c
  UNION ALL
  SELECT conv_id, i, z, s, u, CASE WHEN u IS NULL THEN a ELSE list_min([a, {'c': u.c + 3, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}]) END
  FROM (
    SELECT conv_id, i, z, s, a, list_min([u, CASE WHEN z IS NOT NULL THEN {'c': z.c + 3, 'a': z.a || 'I', 'r': z.r || chr(10) || 'user:'} END,
      CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'} END,
      CASE WHEN a IS NOT NULL THEN {'c': a.c + 3, 'a': a.a || 'I', 'r': a.r || chr(10) || 'user:'} END]) u
    FROM (
      SELECT w.conv_id, w.i + 1 i,
        CASE WHEN z IS NOT NULL THEN {'c': z.c + 4, 'a': z.a || 'D', 'r': z.r} END z,
        list_min([CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'a': s.a || 'D', 'r': s.r} END,
          CASE WHEN z IS NOT NULL AND NOT y.x AND y.n = 's' THEN {'c': z.c + y.e, 'a': z.a || 'K', 'r': z.r || chr(10) || y.t} END]) s,
        list_min([CASE WHEN u IS NOT NULL THEN {'c': u.c + 4, 'a': u.a || 'D', 'r': u.r} END,
          CASE WHEN z IS NOT NULL AND NOT y.x AND y.n = 'u' THEN {'c': z.c + y.e, 'a': z.a || 'K', 'r': z.r || chr(10) || y.t} END,
          CASE WHEN s IS NOT NULL AND NOT y.x AND y.n = 'u' THEN {'c': s.c + y.e, 'a': s.a || 'K', 'r': s.r || chr(10) || y.t} END,
          CASE WHEN a IS NOT NULL AND NOT y.x AND y.n = 'u' THEN {'c': a.c + y.e, 'a': a.a || 'K', 'r': a.r || chr(10) || y.t} END,
          CASE WHEN z IS NOT NULL AND NOT y.x THEN {'c': z.c + 3 + y.e, 'a': z.a || 'R', 'r': z.r || chr(10) || 'user:' || y.p} END,
          CASE WHEN s IS NOT NULL AND NOT y.x THEN {'c': s.c + 3 + y.e, 'a': s.a || 'R', 'r': s.r || chr(10) || 'user:' || y.p} END,
          CASE WHEN a IS NOT NULL AND NOT y.x THEN {'c': a.c + 3 + y.e, 'a': a.a || 'R', 'r': a.r || chr(10) || 'user:' || y.p} END]) u,
        list_min([CASE WHEN a IS NOT NULL THEN {'c': a.c + 4, 'a': a.a || 'D', 'r': a.r} END,
          CASE WHEN u IS NOT NULL AND NOT y.x AND y.n = 'a' THEN {'c': u.c + y.e, 'a': u.a || 'K', 'r': u.r || chr(10) || y.t} END,
          CASE WHEN u IS NOT NULL AND NOT y.x THEN {'c': u.c + 3 + y.e, 'a': u.a || 'R', 'r': u.r || chr(10) || 'assistant:' || y.p} END]) a
      FROM (SELECT walk.*, l[walk.i + 1] y FROM walk JOIN c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE walk.i < len(l)) w)))
, best AS (
  SELECT walk.conv_id, list_min([z, a]) b FROM walk JOIN c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE walk.i = len(l))
SELECT k.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') audit, sha256(substr(coalesce(b.r, ''), 2)) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id
"""

SQL = {
    "op1_warc_zip": OP1,
    "op2_poisson_mix": OP2,
    "op6_minmax_dedup": OP6,
    "op8_cover_tree": OP8,
    "op9_url_trie": OP9,
    "op10_rule_ledger": OP10,
    "op12_conversation_repair": OP12,
}
