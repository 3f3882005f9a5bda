"""DuckDB SQL for the queries that SQL can express."""

from pairlens.llm.licenses import HOLDER, NOTICES, SPELLINGS, TERMS, whole_texts


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical() -> str:
    form = "translate(lower(coalesce(text, '')), chr(1), ' ')"
    form = f"regexp_replace({form}, {_quoted(f'(^|{chr(10)})({HOLDER})')}, concat('\\1', chr(1), '\\2'), 'g')"
    for pattern, replacement in SPELLINGS:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"
    form = f"regexp_replace({form}, '[\\x00\\x02-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"
    lines = f"list_transform(string_split({form}, chr(10)), lambda x: regexp_replace(trim(x, ' '), '^\\x01 ', chr(1)))"
    lines = (f"list_transform({lines}, lambda x: CASE WHEN starts_with(x, chr(1)) AND regexp_matches(x, {_quoted(TERMS)}) "
             "THEN substr(x, 2) ELSE x END)")
    return f"list_filter({lines}, lambda x: x <> '' AND x <> chr(1))"


_UNNAMED = "list_filter(lines, lambda x: NOT starts_with(x, chr(1)))"
_WHOLE = "list_transform(lines, lambda x: ltrim(x, chr(1)))"

OP4 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP2 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM f
"""

OP9 = r"""
WITH words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM words WHERE kind = 'i' AND len(w) > 0),
windows AS (
  SELECT kind, id, k, s, array_to_string(w[s : s + k - 1], ' ') AS t
  FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM words, sizes WHERE kind = 'd' OR k = least(10, len(w)))),
hits AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.s, d.k
  FROM windows d JOIN windows i ON d.k = i.k AND d.t = i.t WHERE d.kind = 'd' AND i.kind = 'i'),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id::varchar AS item_id FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places ON places.doc_id = id LEFT JOIN named ON named.doc_id = id WHERE kind = 'd'
"""

OP6 = f"""
WITH models AS (
  SELECT license_id, {_canonical()} AS lines
  FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in (*NOTICES, *whole_texts()))}) v(license_id, text)),
known AS (
  SELECT DISTINCT license_id, sha256(array_to_string(form, ' ')) AS digest
  FROM (SELECT license_id, unnest([{_UNNAMED}, {_WHOLE}]) AS form FROM models) WHERE len(form) > 0),
marked AS (SELECT doc_id, {_canonical()} AS lines FROM documents),
forms AS (SELECT doc_id, {_UNNAMED} AS lines, {_WHOLE} AS every FROM marked),
wholes AS (
  SELECT doc_id, sha256(coalesce(array_to_string(lines, ' '), '')) AS digest, sha256(coalesce(array_to_string(every, ' '), '')) AS every
  FROM forms),
found AS (
  SELECT doc_id, license_id FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM forms) JOIN known USING (digest))
SELECT doc_id, digest AS canonical_sha256,
  coalesce((SELECT string_agg(DISTINCT license_id, ',' ORDER BY license_id) FROM known k WHERE k.digest IN (w.digest, w.every)), '') AS whole,
  coalesce(notices, '') AS notices, coalesce(n_lines, 0) AS n_lines
FROM wholes w LEFT JOIN (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_lines
  FROM found GROUP BY doc_id) USING (doc_id)
"""

OP11 = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
steps AS (SELECT o, s, o[s] AS f, o[1 : s - 1] AS before FROM orders, range(1, 6) r(s)),
x AS (
  SELECT part, o, s, f, n, good, toxic, contains(fails, f) AS now, fails,
    len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone
  FROM cells, steps),
e AS (
  SELECT part, o, s, f, sum(CASE WHEN NOT gone AND NOT now THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN now AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN now AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN now AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN now AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, o, s, f)
SELECT part, o AS filter_order, s::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
  unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley
FROM e
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT rid, lang, generate_subscripts(pieces, 1) AS pi, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
w AS (SELECT rid, lang, pi, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM p),
q AS (
  SELECT lang, w AS w1, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4
  FROM w WINDOW x AS (PARTITION BY rid, pi ORDER BY i)),
g AS (
  SELECT lang, 1 AS k, [w1] AS g FROM q UNION ALL SELECT lang, 2, [w1, w2] FROM q WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, [w1, w2, w3] FROM q WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, [w1, w2, w3, w4] FROM q WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, k, g),
totals AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, phrase, f AS a FROM f WHERE k >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (c.a::hugeint * 2000000 // (x.f + y.f)::hugeint)::bigint AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1 : j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[j + 1 : c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(g[s : s + z - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT lang, g, a, k, z, unnest(range(1, k - z + 2)) AS s FROM c, range(2, 4) r(z) WHERE z < k) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE held IS NULL OR 100 * held < 80 * a
QUALIFY rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {
    "op2_warc": OP2,
    "op4_exact_dedup": OP4,
    "op6_license_scan": OP6,
    "op9_decontamination": OP9,
    "op11_filter_audit": OP11,
    "op12_collocations": OP12,
    "op13_ngram_join": OP13,
}
