"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from corpusforge.llm.divergence import op12_source_divergence
from corpusforge.llm.embedding_dedup import op10_embedding_dedup
from corpusforge.llm.licenses import op2_license_scan
from corpusforge.llm.mixing import op13_source_mix
from corpusforge.llm.ngram_join import op3_ngram_join
from corpusforge.llm.packing import op8_packing
from corpusforge.llm.quality_classifier import op5_quality_classifier
from corpusforge.llm.quality_rules import op1_quality_rules
from corpusforge.llm.sentencepiece_codec import op9_sentencepiece
from corpusforge.llm.sharding import op4_sharding
from corpusforge.llm.spelling import op11_spelling_variants
from corpusforge.llm.token_files import op7_token_files
from corpusforge.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mix": op13_source_mix,
}

_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(words) - 3), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT doc_id, len(grams) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = s.doc_id) AS component_id FROM s
"""

#: The first two steps make the table of crc32; positions are cut out one by one, so that near words share what is left.
_SPELLING = r"""
WITH RECURSIVE bits AS (SELECT n AS byte, n::BIGINT AS c, 0 AS k FROM range(256) r(n) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
codes AS (SELECT list(c ORDER BY byte) AS crc FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
found AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS marked, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(marked) + 1), lambda i: ('0x' || substr(hex(encode(marked)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM found, codes),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, length(word) AS len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
paths AS (SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN paths p ON p.word = f.word JOIN forms e ON e.word = p.at AND e.form IS NULL
"""

_DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
numbered AS (SELECT row_number() OVER () AS id, * FROM d),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM numbered),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(o.total, 0) + 5 * s.v) AS p, 1 + (1000000000 * (k.lang_n + 5)) // (s.lang_total + 5 * s.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals o ON o.lang = g.lang AND o.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
standing AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM standing) WHERE rank <= 50
"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE row_number() OVER (ORDER BY source IS NULL, source) % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM d GROUP BY source),
c AS (SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM s),
tries AS (SELECT t.level, 1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (full_at < t.level), 0) AS rest, sum(weight) FILTER (full_at >= t.level) AS open
  FROM c, (SELECT 0.0::DOUBLE AS level UNION SELECT full_at FROM c) t GROUP BY t.level),
best AS (SELECT rest, open FROM tries WHERE rest <= level * open OR open IS NULL ORDER BY level LIMIT 1),
found AS (SELECT rest, open FROM best UNION ALL SELECT 0, 1 WHERE NOT EXISTS (SELECT 1 FROM best)),
targets AS (SELECT source, source_size, least(weight * rest / open, cap) AS target, CASE WHEN source_size > 0 THEN floor(least(weight * rest / open, cap) / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS step,
  ('0x' || md5('13:' || coalesce(source, ''))[1:6])::BIGINT AS start FROM c, found),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.step, t.start, row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, ''))) - 1 AS k FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (((start + step * (k + 1)) >> 24) - ((start + step * k) >> 24)) AS taken FROM placed
"""

ORACLE_SQL: dict[str, str] = {"op3_ngram_join": _NGRAM_JOIN, "op11_spelling_variants": _SPELLING, "op12_source_divergence": _DIVERGENCE, "op13_source_mix": _MIX}
