"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from hopframe.llm import quality_rules as rules
from hopframe.llm.decontam import WINDOW
from hopframe.llm.mixing import MOST, WEIGHTS


def op1() -> str:
    """Own formulas where there are any: windows by position, the tail from lgamma."""
    grid = ", ".join(f"('{r}', {j}, {c!r})" for r in rules.RULES for j, c in enumerate(rules.cutoffs(r)))
    ratio = " ".join(
        f"WHEN '{r}' THEN CASE WHEN {whole} = 0 THEN 0.0 ELSE {part}::DOUBLE / {whole}::DOUBLE END" for r, (part, whole, _, _) in rules.RULES.items()
    )
    rate = rules.RISK / len(rules.RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS body, CASE WHEN lang IS NULL THEN 'n' ELSE 's' || lang END AS stratum FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rn, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT rn, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rn),
m AS (SELECT rn, doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  length(regexp_replace(body, '[^!?]', '', 'g'))::BIGINT AS n_marks FROM w LEFT JOIN cov USING (rn)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, step, cutoff) AS (VALUES {grid}),
held AS (SELECT stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
k AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER ((CASE rule {ratio} END) > cutoff) AS k FROM held, grid GROUP BY ALL),
p AS (SELECT *, (SELECT count(DISTINCT stratum) FROM held) AS strata,
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({rate!r}::DOUBLE) + (n - i) * ln(1 - {rate!r}::DOUBLE)))) AS tail FROM k),
c AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM p WHERE k < n * {rate!r} AND tail <= {rules.DELTA / len(rules.RULES)!r} / strata GROUP BY ALL),
bad AS (SELECT DISTINCT rn FROM b JOIN c USING (stratum) WHERE (CASE rule {ratio} END) > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rn NOT IN (SELECT rn FROM bad) AS kept FROM b
"""


def op4() -> str:
    """Exact order by hash instead of histograms."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, (SELECT sum(source_size) FROM s)::DOUBLE AS rest, (SELECT sum(weight) FROM s)::DOUBLE AS weights, 0.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, (SELECT sum(source_size) FROM s) - (SELECT coalesce(sum({MOST} * source_size), 0) FROM s WHERE {MOST} * source_size < weight * rest / weights),
    (SELECT coalesce(sum(weight), 0) FROM s WHERE {MOST} * source_size >= weight * rest / weights), rest / weights
  FROM fill WHERE round < 60 AND weights > 0),
t AS (SELECT source, source_size, least({MOST} * source_size, weight * (SELECT level FROM fill ORDER BY round DESC LIMIT 1))::DOUBLE AS target FROM s),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, count(*) AS m, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
n AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id, size) AS rn FROM d)
SELECT d.doc_id, d.size, q.source_size, q.target,
  (d.size * (q.copies + CASE WHEN 2 * (g.upto - g.s) + (2 * rn - 1) * (g.s / g.m) <= 2 * (q.target - q.copies * q.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n AS d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h
"""


def op10() -> str:
    """Windows as texts, joined whole."""
    words = "regexp_extract_all(lower_az(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = words.replace("lower_az(coalesce(text, ''))", lower)
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rn, doc_id, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spans AS (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT rn, i, s.n, item_id FROM (SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM spans) s JOIN win ON s.g = win.g AND s.n = win.n),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rn, item_id::VARCHAR AS item_id FROM hits) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN items USING (rn)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op4_mixing": op4(), "op10_decontamination": op10()}
