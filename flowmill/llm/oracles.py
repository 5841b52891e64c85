"""DuckDB SQL of the training-data queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates(words: int, percent: float) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})) END AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= {percent} * (len(a.g) + len(b.g) - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(y, doc_id)) AS kept FROM s LEFT JOIN m ON doc_id = x"""


OP7 = near_duplicates(3, 85)

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d),
c AS (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS n FROM g),
r AS (SELECT k, count(DISTINCT p + x) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS x) WHERE n > 1 GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (k)),
v AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * len(l) OR 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words) AS kept FROM v"""


def _words(table: str, key: str) -> str:
    return f"SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}"


OP2 = f"""
WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
iw AS (SELECT id AS item, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT id, size, p, array_to_string(w[p:p + size - 1], ' ') AS g FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT DISTINCT id, item, p, dw.size FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
h AS (SELECT id, count(DISTINCT x) AS n_hit FROM (SELECT id, unnest(range(p, p + size)) AS x FROM m) GROUP BY id),
i AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM m) GROUP BY id)
SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.id = d.id LEFT JOIN i ON i.id = d.id"""

OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS head FROM p),
x AS (SELECT *, concat(CAST(('0x' || sha1(b)) AS VARCHAR)) AS sha FROM h),
c AS (SELECT *, substr(sha, 3) AS hex FROM x),
n AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(hex, CAST(i AS INT), 1)) - 1) AS v FROM c)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((((v[5 * g + 1] << 16) | (v[5 * g + 2] << 12) | (v[5 * g + 3] << 8) | (v[5 * g + 4] << 4) | v[5 * g + 5]) >> (15 - 5 * k)) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM n"""
