"""DuckDB SQL of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from cartulary.llm import quality_rules as rules


def quality_rules_sql() -> str:
    k = range(len(rules.RULES))
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (good, bad) in enumerate(rules.RULES.values()))
    vs = ", ".join(f"v{j}" for j in k)
    counted = r"""
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) AS s(o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
  len(list_filter(l, lambda x: regexp_matches(x, '[.!?][\x20\x09-\x0D]*$'))) AS n_ended, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]{2,}', '', 'g')) AS n_run_symbols FROM w LEFT JOIN rep USING (doc_id)),"""
    parts = [
        f"WITH {counted}",
        f"v AS (SELECT *, {votes} FROM f),",
        f"p AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),",
        f"m0 AS MATERIALIZED (SELECT {rules.START_GOOD}::DOUBLE AS good, {', '.join(f'{rules.START_ON_GOOD}::DOUBLE AS a{j}, {rules.START_ON_BAD}::DOUBLE AS b{j}' for j in k)}),",
    ]
    odds = " + ".join(["ln(good) - ln(1 - good)", *(f"CASE v{j} WHEN 1 THEN ln(a{j}) - ln(1 - b{j}) WHEN -1 THEN ln(1 - a{j}) - ln(b{j}) ELSE 0 END" for j in k)])
    bound = "greatest(0.02::DOUBLE, least(0.98::DOUBLE, {}))"
    for r in range(1, rules.ROUNDS + 1):
        one = lambda vote, g, j: bound.format(f"(sum(CASE WHEN v{j} = {vote} THEN n * ({g}) ELSE 0 END) + 4) / (sum(CASE WHEN v{j} = 0 THEN 0 ELSE n * ({g}) END) + 5)")
        parts += [
            f"g{r} AS MATERIALIZED (SELECT {vs}, n, 1 / (1 + exp(-({odds}))) AS g FROM p, m{r - 1}),",
            f"m{r} AS MATERIALIZED (SELECT {bound.format('(sum(n * g) + 1) / (sum(n) + 2)')} AS good, {', '.join(f'{one(1, "g", j)} AS a{j}, {one(-1, "1 - g", j)} AS b{j}' for j in k)} FROM g{r}),",
        ]
    parts += [
        f"j AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS g FROM v, m{rules.ROUNDS})",
        "SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND g >= 0.5 AS kept FROM j",
    ]
    return "\n".join(parts)


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
often AS (SELECT key, max(doc_id) AS keeper FROM each WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT doc_id, i, line, coalesce(doc_id <> keeper, false) AS gone FROM each LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""

#: Whole audit strings by layers of turns; the check sum by its table, as the strings are short.
TURNS_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM keyed, tbl),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS time FROM src WHERE f <> 0)),
seq AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), md5(text)) AS k FROM dam),
told AS (SELECT *, substr(role, 1, 1) AS ini, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM seq),
kind AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN substr(bare, length(bare), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM kind GROUP BY conv_id),
runs(p, q, i, added) AS (VALUES ('', '', 0, []::VARCHAR[]), ('', 'u', 1, ['user:']), ('', 'a', 2, ['user:', 'assistant:']), ('s', 's', 0, []), ('s', 'u', 1, ['user:']), ('s', 'a', 2, ['user:', 'assistant:']), ('u', 'u', 0, []), ('u', 'a', 1, ['assistant:']), ('a', 'a', 0, []), ('a', 'u', 1, ['user:'])),
ops(op) AS (VALUES ('D'), ('K'), ('R')),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, '' AS st, {'cost': 0::BIGINT, 'audit': '', 'items': []::VARCHAR[]} AS b FROM kind
UNION ALL SELECT conv_id, k, st, b FROM (SELECT d.conv_id, r.k, CASE op WHEN 'D' THEN q WHEN 'K' THEN ini WHEN 'R' THEN CASE WHEN q = 'u' THEN 'a' ELSE 'u' END END AS st,
  min({'cost': (d.b.cost + 2 * i + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END)::BIGINT, 'audit': d.b.audit || repeat('I', i) || op,
  'items': list_concat(list_concat(d.b.items, added), CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END || text] END)}) AS b
  FROM dp d JOIN kind r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.k = d.k + 1 JOIN runs ON p = d.st CROSS JOIN ops
  WHERE op = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR (ini = 's' AND q = '') OR (ini = 'u' AND q <> 'u') OR (ini = 'a' AND q = 'u'))) GROUP BY ALL)),
ends AS (SELECT dp.conv_id, min({'cost': (b.cost + 2 * CASE st WHEN 's' THEN 2 WHEN 'u' THEN 1 ELSE 0 END)::BIGINT, 'audit': b.audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
  'items': list_concat(b.items, CASE st WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END)}) AS b FROM dp JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id AND facts.n = dp.k GROUP BY ALL)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
coalesce(e.b.cost, 0)::BIGINT AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.items, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
