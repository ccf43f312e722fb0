"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from plantstate.llm.license_digests import DIGESTS
from plantstate.llm.licenses import KNOWN, SPELLINGS
from plantstate.llm.quality import FEATURES, PRIOR, REACH

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source AS src, {WORDS}::BIGINT AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), sizes AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src
), weighed AS (
  SELECT *, source_size * 3.0::DOUBLE AS stop, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY stop / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aims AS (
  SELECT src, source_size, least(stop, w * (SELECT arg_min(level, stop / w) FROM levels WHERE level <= stop / w)) AS target FROM levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS reps FROM aims
), hashes AS (
  SELECT src, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY src ORDER BY h) AS upto,
         lead(h) OVER (PARTITION BY src ORDER BY h) IS NULL AS final FROM sized GROUP BY src, h
), edges AS (
  SELECT p.src, min(h) AS cut FROM plans p JOIN hashes x ON p.src IS NOT DISTINCT FROM x.src
  WHERE upto > target - reps * source_size OR final GROUP BY p.src
), cuts AS (
  SELECT p.*, e.cut, (target - reps * source_size - (x.upto - x.words)) * 2 >= x.words AS cut_in
  FROM plans p JOIN edges e ON p.src IS NOT DISTINCT FROM e.src
  JOIN hashes x ON x.src IS NOT DISTINCT FROM e.src AND x.h = e.cut
)
SELECT doc_id, size, source_size, target,
       (least(reps + CASE WHEN h < cut OR (h = cut AND cut_in) THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM sized s JOIN cuts c ON s.src IS NOT DISTINCT FROM c.src
"""

_PAIRS = ", ".join(f"{{'feature': '{f.name}', 'bucket': CASE WHEN {f.bottom} > 0 THEN {f.scale} * {f.top} // {f.bottom} ELSE 0 END}}" for f in FEATURES)
_WIDE = "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {f.wide}" for f in FEATURES) + " END"
_LOW = "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {f.low}" for f in FEATURES) + " END"
_HIGH = "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {f.high}" for f in FEATURES) + " END"

OP10 = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source AS src, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS z(k) GROUP BY r
), counts AS (
  SELECT words.r, doc_id, lang, src, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))::BIGINT AS n_echo_words, length(regexp_replace(t, '[^A-Z!]+', '', 'g'))::BIGINT AS n_loud
  FROM words LEFT JOIN covered ON words.r = covered.r
), judged AS (
  SELECT *, n_lines - n_own_lines AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), pairs AS (
  SELECT r, lang, src, n_words, p.feature AS feature, (p.bucket - p.bucket % (1::BIGINT << greatest(length(bin(p.bucket::BIGINT)) - 10, 0)))::BIGINT AS bucket FROM (SELECT r, lang, src, n_words, unnest([{_PAIRS}]) AS p FROM judged)
), sketch AS (
  SELECT lang, src, feature, bucket, count(*) AS n FROM pairs WHERE n_words > 0 GROUP BY ALL
), merged AS (
  SELECT 0 AS level, lang, src, feature, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, feature, bucket, sum(n) FROM sketch GROUP BY lang, feature, bucket
  UNION ALL SELECT 2, NULL, NULL, feature, bucket, sum(n) FROM sketch GROUP BY feature, bucket
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, src, feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, src, feature) AS total FROM merged
), quartiles AS (
  SELECT level, lang, src, feature, max(total)::BIGINT AS n, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM ranked GROUP BY level, lang, src, feature
), fences AS (
  SELECT level, lang, src, feature, n, (CASE WHEN {_LOW} THEN greatest(q1 - {REACH} * greatest(q3 - q1, {_WIDE}), 0) ELSE 0 END)::BIGINT AS lo, (CASE WHEN {_HIGH} THEN q3 + {REACH} * greatest(q3 - q1, {_WIDE}) ELSE 1099511627776 END)::BIGINT AS hi FROM quartiles
), langs AS (
  SELECT l.lang, l.feature, (l.n * l.lo + {PRIOR} * a.lo) // (l.n + {PRIOR}) AS lo, (l.n * l.hi + {PRIOR} * a.hi) // (l.n + {PRIOR}) AS hi FROM fences l JOIN fences a ON l.level = 1 AND a.level = 2 AND l.feature = a.feature
), cuts AS (
  SELECT g.lang, g.src, g.feature, (g.n * g.lo + {PRIOR} * l.lo) // (g.n + {PRIOR}) AS lo, (g.n * g.hi + {PRIOR} * l.hi) // (g.n + {PRIOR}) AS hi FROM fences g JOIN langs l ON g.level = 0 AND g.feature = l.feature AND g.lang IS NOT DISTINCT FROM l.lang
), failing AS (
  SELECT DISTINCT r FROM (SELECT p.r, p.feature, p.bucket, lo, hi FROM pairs p JOIN cuts c ON p.feature = c.feature AND p.lang IS NOT DISTINCT FROM c.lang AND p.src IS NOT DISTINCT FROM c.src)
  WHERE bucket < lo OR bucket > hi
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failing.r IS NULL AS kept
FROM judged LEFT JOIN failing ON judged.r = failing.r
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def _lines(text: str) -> str:
    """The canonical lines of a text, as a list."""
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, '(^|\\n)[^a-z0-9\\n]*(copyright\\b[^\\n]*([0-9]{{4}}|\\(c\\)|©)|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
    out = f"' ' || replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for plain, to in SPELLINGS:
        out = f"replace({out}, '{plain}', '{to}')"
    return f"list_transform(list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, ' +', ' ', 'g'))"


_KNOWN = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for n, t in KNOWN.items())
_SHIPPED = ", ".join(f"('{d}', '{n}')" for d, n in sorted(DIGESTS.items()))

OP2 = f"""
WITH known AS (
  SELECT digest, min(name) AS name FROM (SELECT name, sha256(array_to_string({_lines('text')}, ' ')) AS digest FROM (VALUES {_KNOWN}) AS k(name, text)) GROUP BY digest
  UNION ALL SELECT digest, name FROM (VALUES {_SHIPPED}) AS s(digest, name)
), cut AS (
  SELECT row_number() OVER () AS r, doc_id, {_lines('text')} AS ls FROM documents
), whole AS (
  SELECT r, doc_id, sha256(array_to_string(ls, ' ')) AS digest FROM cut
), lines AS (
  SELECT DISTINCT r, sha256(line) AS digest FROM (SELECT r, unnest(ls) AS line FROM cut)
), hits AS (
  SELECT r, count(DISTINCT name) AS n, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM lines JOIN known USING (digest) GROUP BY r
)
SELECT doc_id, w.digest, k.name AS license, coalesce(n, 0)::BIGINT AS n_notices, coalesce(names, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN hits h ON w.r = h.r
"""

OP11 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM cut
), ranked AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts
"""

OP12 = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT r, i, hash(array_to_string(ws[i:i+34], ' ')) AS g, md5_number(array_to_string(ws[i:i+34], ' ')) AS m FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM words WHERE len(ws) >= 35)
), twice AS (
  SELECT r, i FROM windows SEMI JOIN (SELECT g, m FROM windows GROUP BY g, m HAVING count(*) > 1) USING (g, m)
), gone AS (
  SELECT r, list(i) AS places FROM (SELECT DISTINCT r, i + k AS i FROM twice, range(35) AS z(k)) GROUP BY r
), kept AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
         CASE WHEN places IS NULL THEN ws WHEN len(places) = len(ws) THEN [] ELSE NULL END AS kept FROM words w LEFT JOIN gone USING (r)
), rest AS (
  SELECT r, list(w ORDER BY i) AS left_ FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words SEMI JOIN kept ON words.r = kept.r AND kept.kept IS NULL)
  ANTI JOIN (SELECT r, unnest(places) AS i FROM gone) USING (r, i) GROUP BY r
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(coalesce(kept, left_), ' ')) AS kept_sha256 FROM kept LEFT JOIN rest USING (r)
"""

OP13 = """
WITH rows AS (
  SELECT row_number() OVER () AS uid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid AS anchor, a.id AS anchor_id, a.label = r.label AS same, r.id, r.uid, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.uid <> r.uid WHERE a.id % 100 = 0
), good AS (
  SELECT anchor, anchor_id, id, uid, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, uid) <= 5
)
SELECT g.anchor_id, g.id AS positive_id, (row_number() OVER (PARTITION BY g.anchor, g.uid ORDER BY s.score DESC, s.id, s.uid))::INTEGER AS rank,
       s.id AS negative_id, g.score AS positive_score, s.score AS negative_score
FROM good g JOIN scored s ON g.anchor = s.anchor AND NOT s.same AND 30 * g.score <= 100 * s.score AND 100 * s.score <= 90 * g.score
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op2_license_scan": OP2, "op7_top_k": OP7, "op1_mix_sources": OP1, "op10_quality_rules": OP10, "op11_fill_in_middle": OP11, "op12_without_repeats": OP12, "op13_hard_negatives": OP13}
