"""DuckDB SQL for the queries of this subpackage that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BENCH = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, {_BENCH} AS w FROM documents),
b AS (SELECT item_id, {_BENCH} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k,
              array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS s
       FROM b, unnest(range(greatest(len(w) - 12, 1))) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s
       FROM d, ks, unnest(range(len(w) - k + 1)) AS r(i)),
h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP5 = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n:
    list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
d AS (SELECT doc_id, source, coalesce(text, '') AS t, hex(coalesce(text, '')) AS h FROM documents),
c AS (
  SELECT doc_id, source, CAST(strlen(t) + 1 AS BIGINT) AS size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(strlen(t)),
             lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM d, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id) AS r,
             count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS FIRST, r) - 1 AS p FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 16 // total AS INTEGER) AS shard,
       p - ((p * 16 // total) * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s
         FROM d, unnest(range(len(w) - 4)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM runs) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         n_repeat_words, n_capitals, n_marks, len(l) AS n_lines FROM m),
g AS (
  SELECT *, CAST((n_words < 10) AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT)
    + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT)
    + 16 * CAST(2 * n_capitals > word_chars AS BIGINT) + 32 * CAST(10 * n_marks > 3 * n_words AS BIGINT)
    + 64 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS BIGINT) AS failed_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 != 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits FROM g
"""

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pc AS (SELECT id, lang, j, s FROM (SELECT id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s,
              generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS j FROM d)),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM pc),
g AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS p
      FROM w, unnest(range(1, 6)) AS ks(k), unnest(range(len(w) - k + 1)) AS r(i)),
f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, p, k, f AS a, string_split(p, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, p, a, m, array_to_string(ws[1:m], ' ') AS lp, array_to_string(ws[m + 1 : k], ' ') AS rp
        FROM c, unnest(range(1, k)) AS r(m)),
sc AS (SELECT cut.lang, cut.p, cut.a, m, x.f AS l, y.f AS r, CAST(n AS BIGINT) AS n,
              CAST((CAST(1000 AS HUGEINT) * cut.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
       FROM cut JOIN f x ON x.lang = cut.lang AND x.p = lp JOIN f y ON y.lang = cut.lang AND y.p = rp JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, m) AS o FROM sc) WHERE o = 1),
inn AS (SELECT lang, array_to_string(ws[i + 1 : i + m], ' ') AS p, max(a) AS longer
        FROM c, unnest(range(2, k)) AS s(m), unnest(range(k - m + 1)) AS r(i) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inn USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, p AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) WHERE rank <= 2000
"""

#: Runs are stretches of equal words q apart; of equal stretches the one of the smallest q is the run.
_OP12 = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n:
    list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(length(CAST(doc_id AS VARCHAR))),
             lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM documents, tab),
e AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a,
             3 + (h // 10) % 8 AS m FROM d),
x AS (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1]
               ELSE w[a + (i - a) % (1 + (n - a) // m) + 1] END AS s FROM e, unnest(range(n)) AS r(i)),
pairs AS (SELECT u.doc_id, v.i - u.i AS q, u.i FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.s = v.s AND v.i > u.i
          WHERE 4 * (v.i - u.i) <= u.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
st AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e FROM isl GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, e, min(q) AS q FROM st WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) AS o FROM runs) WHERE o = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(s, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i
         WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period,
       1000 * (e - s) // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_decontaminate": _OP1, "op5_shard": _OP5, "op8_rules": _OP8, "op11_collocations": _OP11, "op12_runs": _OP12}
