"""Further queries of the engine's own operators, with the same in DuckDB's SQL; ``catalogue`` adds them to its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary import catalogue as c
from cartulary.catalogue import query, table, values
from cartulary.functions import paths, text
from cartulary.operators import dashboard, evaluate, experiments, harvest, metrics
from cartulary.plans import actions, coverage
from cartulary.vocabulary import get


@query("""WITH r AS (SELECT p_partkey AS k, (p_size)::VARCHAR AS folder, 'a' || p_partkey % 3 AS base FROM part),
taken AS (SELECT DISTINCT folder, regexp_extract(name, '^(.+)-[1-9][0-9]*\\.pdf$', 1) AS base, regexp_extract(name, '-([1-9][0-9]*)\\.pdf$', 1)::INT AS n FROM (SELECT (s_suppkey % 50 + 1)::VARCHAR AS folder, 'a' || s_suppkey % 3 || '-' || (s_suppkey % 4 + 1) || '.pdf' AS name FROM supplier)),
spots AS (SELECT folder, base, list(n) AS t FROM taken GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY k) AS seat FROM r)
SELECT k, folder, CASE WHEN seat = 1 THEN base || '.pdf' ELSE base || '-' || list_filter(range(1, seat + len(coalesce(t, [])) + 1), lambda x: NOT list_contains(coalesce(t, []), x))[seat - 1] || '.pdf' END AS new_name FROM s LEFT JOIN spots USING (folder, base)""")
def q39_rename_free_names(spark, sf_dir):
    """Every part wants one of a few names in its folder, beside files that exist."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("folder"), F.concat(F.lit("a"), (F.col("p_partkey") % 3).cast("string"), F.lit(".pdf")).alias("target"))
    s = F.col("s_suppkey")
    held = table(spark, sf_dir, "supplier").select((s % 50 + 1).cast("string").alias("folder"), F.concat(F.lit("a"), (s % 3).cast("string"), F.lit("-"), (s % 4 + 1).cast("string"), F.lit(".pdf")).alias("name"))
    return actions.rename_all(rows, "folder", "target", "k", held).select("k", "folder", "new_name")


_RAW = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m00') WHEN 2 THEN strftime(o_orderdate, '%Y00%d') WHEN 3 THEN '00000000' ELSE strftime(o_orderdate, '0000%m%d') END"


@query(f"""WITH r AS (SELECT o_orderkey, {_RAW} AS d FROM orders)
SELECT o_orderkey, d = '00000000' OR NOT (substr(d, 1, 4) = '0000' OR substr(d, 5, 2) = '00' OR substr(d, 7, 2) = '00') AS strict, d = '00000000' OR substr(d, 1, 4) <> '0000' AS lax FROM r""")
def q40_ground_truth_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyyMM'00'")).when(k == 2, F.date_format(d, "yyyy'00'dd")).when(k == 3, F.lit("00000000")).otherwise(F.date_format(d, "'0000'MMdd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("d"))
    return rows.select("o_orderkey", text.valid_ground_truth_date(F.col("d")).alias("strict"), text.valid_ground_truth_date(F.col("d"), strict=False).alias("lax"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') || '/b/c/x.pdf' WHEN 1 THEN p_name || '/x.pdf' WHEN 2 THEN 'a/b/c/d/e/f/x.pdf' ELSE 'a/' || repeat('y', 250 + p_size) || '.pdf' END AS path FROM part),
f AS (SELECT p_partkey, path, list_slice(string_split(path, '/'), 1, -2) AS folders FROM p)
SELECT p_partkey, CASE WHEN length(path) > 255 THEN 'Generated path exceeds max length of 255: ' || length(path) || ' chars' WHEN len(folders) > 4 THEN 'Generated path exceeds max folder depth of 4: ' || len(folders) || ' levels'
WHEN len(list_filter(folders, lambda x: NOT regexp_matches(x, '^[a-z0-9_-]+$'))) > 0 THEN 'Folder segment ''' || list_filter(folders, lambda x: NOT regexp_matches(x, '^[a-z0-9_-]+$'))[1] || ''' contains disallowed characters (allowed: [a-z0-9_-])' END AS error FROM f""")
def q41_path_validation(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    path = F.when(k == 0, F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("/b/c/x.pdf"))).when(k == 1, F.concat(name, F.lit("/x.pdf"))).when(k == 2, F.lit("a/b/c/d/e/f/x.pdf")).otherwise(F.concat(F.lit("a/"), F.repeat(F.lit("y"), F.col("p_size") + 250), F.lit(".pdf")))
    return table(spark, sf_dir, "part").select("p_partkey", paths.path_error(path).alias("error"))


_MATCHES = "WITH r AS (SELECT c_nationkey AS original, c_custkey AS seq FROM customer), p AS (SELECT s_nationkey AS name, s_name AS path FROM supplier)"


@query(f"""{_MATCHES}, a AS (SELECT *, row_number() OVER (PARTITION BY original ORDER BY seq) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS k FROM p)
SELECT original, seq, path FROM a LEFT JOIN b ON a.original = b.name AND a.k = b.k""")
def q42_results_to_paths_by_rank(spark, sf_dir):
    return actions.by_rank(*_matches(spark, sf_dir))


@query(f"{_MATCHES}, f AS (SELECT name, min(path) AS path FROM p GROUP BY 1) SELECT original, seq, path FROM r LEFT JOIN f ON original = name")
def q43_results_to_first_path(spark, sf_dir):
    return actions.first_match(*_matches(spark, sf_dir))


def _matches(spark, sf_dir):
    results = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("original"), F.col("c_custkey").alias("seq"))
    return results, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_name").alias("path"))


@query(f"WITH {c.HARVEST} SELECT count_if(rd IS NOT NULL AND rc IS NOT NULL AND rt IS NOT NULL) AS processed, count_if(rd IS NULL OR rc IS NULL OR rt IS NULL) AS errors FROM h")
def q44_harvest_counters(spark, sf_dir):
    return harvest.counters(c.harvest_(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 9000 + 1)::DOUBLE AS s, (o_orderkey % 80 + 1)::DOUBLE AS n, strftime(o_orderdate, '%Y-%m-%d 10:00:00') AS a, strftime(o_orderdate + INTERVAL (o_orderkey % 7 - 2) DAY, '%Y-%m-%d 10:00:30') AS b FROM orders),
e AS (SELECT *, s / n AS each FROM r)
SELECT o_orderkey, CASE WHEN each >= 60 THEN floor(each / 60)::BIGINT || 'm ' || floor(each % 60 + 0.5)::BIGINT || 's' ELSE floor(each * 10 + 0.5)::BIGINT // 10 || '.' || floor(each * 10 + 0.5)::BIGINT % 10 || 's' END AS runtime,
CASE WHEN date_diff('second', a::TIMESTAMP, b::TIMESTAMP) > 0 THEN date_diff('second', a::TIMESTAMP, b::TIMESTAMP) END AS seconds FROM e""")
def q45_runtimes(spark, sf_dir):
    k = F.col("o_orderkey")
    later = F.date_add(F.col("o_orderdate").cast("date"), (k % 7 - 2).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dashboard.runtime((k % 9000 + 1).cast("double"), (k % 80 + 1).cast("double")).alias("runtime"),
        dashboard.seconds_between(F.date_format("o_orderdate", "yyyy-MM-dd 10:00:00"), F.date_format(later, "yyyy-MM-dd 10:00:30")).alias("seconds"),
    )


RATES = {"input": 3.0, "read": 0.3, "write": 3.75, "output": 15.0}


@query("""WITH e AS (SELECT event_id, user_id % 5000 + 100 AS tin, event_id % 900 AS r, user_id % 700 AS w, event_id % 300 AS tout FROM events)
SELECT event_id, (greatest(tin - r - w, 0) * 3.0::DOUBLE + r * 0.3::DOUBLE + w * 3.75::DOUBLE + tout * 15.0::DOUBLE) / 1e6 AS cost, 0.0::DOUBLE AS unrated FROM e""")
def q46_cached_cost(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    args = (u % 5000 + 100, e % 900, u % 700, e % 300)
    return table(spark, sf_dir, "events").select("event_id", metrics.cached_cost(*args, RATES).alias("cost"), metrics.cached_cost(*args, None).alias("unrated"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


@query(f"""WITH v AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN c_name || ' & Sons of the Old Town Ltd.' WHEN 1 THEN '  ' || c_name || '!' ELSE '***' END AS v, 'account-statement' AS t, '2024-01-15' AS d FROM customer),
s AS (SELECT k, {_SLUG} AS head, '_' || t || '_' || d || '.pdf' AS tail FROM v)
SELECT k, CASE WHEN length(head) > 50 - length(tail) THEN regexp_replace(substr(head, 1, 50 - length(tail)), '-+$', '') ELSE head END || tail AS filename FROM s""")
def q47_synthetic_filenames(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    vendor = F.when(k % 3 == 0, F.concat(name, F.lit(" & Sons of the Old Town Ltd."))).when(k % 3 == 1, F.concat(F.lit("  "), name, F.lit("!"))).otherwise("***")
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.synthetic_filename(vendor, F.lit("account-statement"), F.lit("2024-01-15")).alias("filename"))


@query(f"""WITH {c.RECORDS}, w AS (SELECT * FROM rr WHERE success AND NOT coalesce(all_match, false))
SELECT field, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT '{f}' AS field FROM w WHERE NOT m_{f}" for f in experiments.FIELDS) + ") GROUP BY ALL")
def q48_mismatches_by_field(spark, sf_dir):
    none = F.lit(None).cast("map<string,string>")
    records = c.records_(spark, sf_dir).withColumns({"expected": none, "result": none})
    return experiments.mismatches(records).groupBy("field").agg(F.count("*").alias("n"))


@query(f"""WITH {c.DOCS}, b AS ({c.answers_sql('documents', 's.doc_id', 3, keep='s.doc_id')}), x AS (SELECT {c.norm_('doctype')} AS term, count(*) AS base FROM a GROUP BY ALL), y AS (SELECT CASE domain WHEN 'medical' THEN 'chart' ELSE {c.norm_('doctype')} END AS term, count(*) AS new FROM b GROUP BY ALL),
j AS (SELECT term, coalesce(base, 0) AS base, coalesce(new, 0) AS new FROM x FULL JOIN y USING (term))
SELECT term, base, new, new - base AS delta, CASE WHEN new >= 5 AND base < 5 THEN 'new' WHEN base >= 5 AND new < 5 THEN 'gone' WHEN abs(new - base) >= 8 THEN 'moved' ELSE 'steady' END AS verdict FROM j""")
def q49_harvest_verdicts(spark, sf_dir):
    """What is medical is a chart to the second harvest."""
    count = lambda df: df.groupBy(text.normalise(F.col("doctype")).alias("term")).agg(F.count("*").alias("n"))
    new = c.docs_(spark, sf_dir, 3).withColumn("doctype", F.when(F.col("domain") == "medical", "chart").otherwise(F.col("doctype")))
    return harvest.verdicts(harvest.delta(count(c.docs_(spark, sf_dir)), count(new), "term"))


@query("""WITH a AS (SELECT c_name AS filename FROM customer UNION SELECT s_name FROM supplier), p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'order-' || o_orderkey ELSE c_name END AS filename FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, filename FROM p WHERE filename NOT IN (SELECT filename FROM a)""")
def q50_not_yet_written(spark, sf_dir):
    name = lambda t, n: table(spark, sf_dir, t).select(F.col(n).alias("filename"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    key = F.col("o_orderkey")
    planned = table(spark, sf_dir, "orders").join(customers, "o_custkey").select("o_orderkey", F.when(key % 3 == 0, F.concat(F.lit("order-"), key.cast("string"))).otherwise(F.col("c_name")).alias("filename"))
    return coverage.not_yet(planned, name("customer", "c_name"), name("supplier", "s_name")).select("o_orderkey", "filename")


@query(f"""WITH {c._dims()}, {c.DOCS}, t AS (SELECT canonical AS term FROM ds UNION SELECT one FROM ds), s AS (SELECT raw AS term, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM dc WHERE raw = canonical AND raw IN (SELECT term FROM t) AND raw NOT IN ('agreement') GROUP BY 1),
u AS (SELECT term, count(*) AS n FROM (SELECT {c.norm_('category')} AS term FROM a UNION ALL SELECT {c.norm_('doctype')} FROM a) GROUP BY ALL) SELECT term, domains, coalesce(n, 0) AS n FROM s LEFT JOIN u USING (term)""")
def q51_shared_terms(spark, sf_dir):
    """Terms that are categories and doctypes, and how many answers about the documents use them as either."""
    used = c.docs_(spark, sf_dir).select(F.explode(F.array(text.normalise(F.col("category")), text.normalise(F.col("doctype")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return coverage.shared_terms(get(), spark, ("agreement",)).join(used, "term", "left").select("term", "domains", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT count_if(event_type <> 'error') AS written, count_if(event_type = 'error') AS rejected, count_if(event_type <> 'error' AND user_id % 1000 > 512) AS long_documents, count_if(event_type = 'error') > count(*) * 0.1 AS warn FROM events""")
def q52_generation_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 1000).alias("tokens"))
    return metrics.generation(rows, "tokens", "ok")


@query(f"""WITH {c._dims()}, {c.DOCS}, {c.canon_('a', 'x.*')} SELECT doc_id, CASE WHEN cd IS NULL THEN 'unknown domain: ' || domain WHEN cc IS NULL THEN 'unknown category: ' || category WHEN ct IS NULL THEN 'unknown doctype: ' || doctype END AS error,
replace(category || ' ' || doctype, '_', ' ') AS subject, CASE WHEN (domain, category, doctype) IN ({values(coverage.LONG_TRIPLES)}) THEN {coverage.LONG_WORDS} ELSE {coverage.SHORT_WORDS} END AS words FROM k""")
def q53_triples_checked_and_asked(spark, sf_dir):
    rows = c.docs_(spark, sf_dir).select("doc_id", "domain", "category", "doctype")
    return coverage.asked(coverage.checked(rows)).select("doc_id", "error", "subject", "words")


@query("""WITH t AS (SELECT doc_id AS f, CASE WHEN quality = 1 THEN 'x' ELSE ' ' END AS d FROM labels), g AS (SELECT CASE lang WHEN 'fr' THEN -doc_id - 1 ELSE doc_id END AS f FROM documents)
SELECT f AS filename, 'empty: domain' AS issue FROM t WHERE trim(d) = '' UNION ALL SELECT f, 'no file' FROM t WHERE f NOT IN (SELECT f FROM g) UNION ALL SELECT f, 'no entry' FROM g WHERE f NOT IN (SELECT f FROM t)""")
def q54_ground_truth_issues(spark, sf_dir):
    """Labels as ground truth, documents as the files; French ones have names that no entry knows."""
    x = F.lit("x")
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filename"), F.when(F.col("quality") == 1, "x").otherwise(" ").alias("domain"), x.alias("category"), x.alias("doctype"))
    return evaluate.stub_issues(truth, table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "fr", -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("filename")))


@query(f"""WITH {c.TRUTH}, w AS (SELECT filename, a_domain, p_domain FROM c WHERE NOT domain_ok) SELECT filename || ': ' || a_domain || ' -> ' || p_domain AS line, (SELECT count(*) FROM w) - 5 AS more FROM w ORDER BY filename LIMIT 5""")
def q55_first_mistakes(spark, sf_dir):
    lines, more = evaluate.first_mistakes(c.compared_(spark, sf_dir))
    return spark.createDataFrame([(x, more) for x in lines], "line string, more long")


@query("""SELECT 'model' AS kind, coalesce(source || '/', '') || lang AS name, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'document', doc_id::VARCHAR, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY ALL""")
def q56_distinct_models(spark, sf_dir):
    """Models and documents of a report: here sources and languages, and the documents."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("source").alias("provider"), F.col("lang").alias("model"), F.col("doc_id").cast("string").alias("document"))
    return experiments.names(rows)
