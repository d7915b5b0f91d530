"""The numbered queries in SQL, where SQL can express them."""

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), m AS (
  SELECT page_id, body, strlen(body) AS n,
         max(page_id) OVER (PARTITION BY body) AS head
  FROM p
)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to
FROM m
"""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP9 = f"""
WITH item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), doc_window AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc CROSS JOIN (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, n, item FROM doc_window JOIN item_window USING (n, gram)
), hit_words AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hit) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP10 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
), k AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""

# crc32 of a list of bytes, with its table of 256 entries made by the rule.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def _crc32(octets):
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}),
         lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295)"""


_ASCII = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))"

OP11 = f"""
WITH RECURSIVE {_CRC_TABLE}, said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce("text", '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, "text" NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(struct_pack(role := role, body := body) ORDER BY p) AS turns FROM said GROUP BY c
), plan AS (
  SELECT c, turns, c - c % 20 AS base, {_crc32(_ASCII)} % 4 AS h FROM own CROSS JOIN crc
), rebuilt AS (
  SELECT plan.c, list_concat(coalesce(b.turns, [])[1 : h], plan.turns[h + 1 :]) AS turns
  FROM plan LEFT JOIN own b ON b.c = plan.base
), prefix AS (
  SELECT c, d, turns[1 : d] AS path, d = len(turns) AS ended
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT path, min(d) AS d, min(c) AS conv, count(*) AS n,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '') AS ends,
         CASE WHEN min(d) = 0 THEN 0 ELSE len(regexp_extract_all(path[-1].body, '[^\x20\x09-\x0D]+')) END AS words
  FROM prefix GROUP BY path
), linked AS (
  SELECT a.*, b.conv AS parent_conv, (SELECT count(*) FROM node k WHERE k.d = a.d + 1 AND k.path[1 : a.d] = a.path) AS kids
  FROM node a LEFT JOIN node b ON b.d = a.d - 1 AND b.path = a.path[1 : a.d - 1]
), below AS (
  SELECT a.path, sum(CASE WHEN b.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.words) AS saved
  FROM linked a JOIN linked b ON b.d >= a.d AND b.path[1 : a.d] = a.path GROUP BY a.path
)
SELECT conv AS conv_id, d AS depth, parent_conv AS parent_conv_id, n AS n_convs, kids AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM linked JOIN below USING (path)
"""

OP12 = """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings
), l AS (
  SELECT a.r AS u, b.r AS v FROM r a JOIN r b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT r AS u, r AS v FROM r UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v
), c AS (
  SELECT u, min(vec_id) AS component_id FROM reach JOIN r ON r.r = reach.v GROUP BY u
), n AS (
  SELECT u, count(*) AS n_links FROM l GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM r JOIN c ON c.u = r.r LEFT JOIN n ON n.u = r.r
"""

_OCTETS = """flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128
         THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"""

OP13 = f"""
WITH RECURSIVE {_CRC_TABLE}, run AS (
  SELECT doc_id, run, count(*) AS m
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL
), checked AS (
  SELECT run, m, {_crc32(_OCTETS)} AS h FROM run CROSS JOIN crc
), spelled AS (
  SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked
), words AS (
  SELECT word, CAST(sum(m) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3
), cut AS (
  SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pair AS (
  SELECT a.word AS u, b.word AS v FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT word, head || tail FROM cut WHERE head || tail IN (SELECT word FROM words)
  UNION SELECT head || tail, word FROM cut WHERE head || tail IN (SELECT word FROM words)
), best AS (
  SELECT u, count(*) AS n_near, max(w.n) AS top, min(struct_pack(n := -w.n, word := v)) AS form
  FROM pair JOIN words w ON w.word = v GROUP BY u
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form.word END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words LEFT JOIN best ON u = word
), up AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN up ON up.word = f.word JOIN formed e ON e.word = up.at WHERE e.form IS NULL
"""

ORACLES = {"op1_warc": OP1, "op9_decontaminate": OP9, "op10_neighbours": OP10, "op11_prefix_trie": OP11, "op12_vector_copies": OP12, "op13_variants": OP13}
