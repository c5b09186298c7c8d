"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op6_substring_dedup": f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS words FROM documents),
place AS (SELECT rid, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
win AS (SELECT p.rid, p.i, md5(array_to_string(w.words[p.i : p.i + 34], ' ')) AS h FROM place p JOIN w USING (rid)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT rid, list(DISTINCT i + k) AS spots FROM hit, range(35) AS r(k) GROUP BY rid),
word AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (
  SELECT word.rid, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n
  FROM word LEFT JOIN (SELECT rid, unnest(spots) AS i FROM gone) g ON word.rid = g.rid AND word.i = g.i
  WHERE g.i IS NULL GROUP BY word.rid)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (rid)
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
s AS (SELECT lang, count(*) AS v, sum(total) AS tn FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, total, sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) AS gn
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT x.lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (gn + 5 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (total + 5)) // (tn + 5 * v) AS BIGINT) AS q
  FROM x JOIN s USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
""",
}
