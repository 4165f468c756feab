"""Queries of calls that are logged, of sums along one order, and of lines by number; ``catalogue`` adds them to its own."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from cartulary import calls, sql, storage
from cartulary import catalogue as c
from cartulary.backends import Answer, ApiError
from cartulary.catalogue import query, table, values
from cartulary.classify import asker
from cartulary.operators import canonicalise, metrics, prefix
from cartulary.sources import lines, paged, structure
from cartulary.streaming import landing

#: A template that hands a document on as it is.
BARE = "# System Prompt\n{taxonomy_menu}\n# Human Prompt\n{document_content}"
MODELS = (("here", "even"), ("here", "odd"), ("there", "even"))
REFUSED = 13


class ByLength:
    """Stand-in of a model whose rule SQL can follow: a document's length picks one of the fixed answers, or a refusal."""

    def __init__(self, shift: int):
        self.shift = shift

    def answer(self, system: str, human: str) -> Answer:
        n = len(human) + self.shift
        if n % REFUSED == 0:
            raise ApiError(f"refused: {n}")
        return Answer(json.dumps(dict(zip(c.COLUMNS, c.ANSWERS[n % len(c.ANSWERS)], strict=True))), n, 7)


def _shift(provider: str, model: str) -> int:
    return len(provider) + len(model)


@query(f"""WITH m(provider, model) AS (VALUES {values(MODELS)}), d AS (SELECT doc_id::VARCHAR AS document, provider, model, length(coalesce(text, '')) + length(provider) + length(model) AS n FROM documents, m),
a(k, domain, subject) AS (VALUES {values((k, x[0], x[5]) for k, x in enumerate(c.ANSWERS))})
SELECT document, provider, model, CASE WHEN n % {REFUSED} = 0 THEN 'LLM_API_ERROR' END AS error_code, CASE WHEN n % {REFUSED} = 0 THEN 'refused: ' || n END AS error_message, CASE WHEN n % {REFUSED} <> 0 THEN domain END AS domain,
CASE WHEN n % {REFUSED} <> 0 THEN subject END AS subject, CASE WHEN n % {REFUSED} <> 0 THEN n + 7 ELSE 0 END AS total_tokens FROM d JOIN a ON k = n % {len(c.ANSWERS)}""")
def q57_logged_calls(spark, sf_dir):
    """Every document asked of every model, several calls open in each partition, each outcome logged as it ends."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document"), F.coalesce("text", F.lit("")).alias("content"), *[F.lit(None).cast("string").alias(x) for x in ("error_code", "error_message")])
    models = spark.createDataFrame(list(MODELS), "provider string, model string")
    path = f"{storage.shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    logged = calls.log(docs, models, path, asker(lambda p, m: lambda: ByLength(_shift(p, m)), BARE), width=4)
    told = lambda name: F.get_json_object("response", f"$.{name}").alias(name)
    return logged.select(*calls.KEYS, "error_code", "error_message", told("domain"), told("subject"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


@query(f"""WITH {c._PRICED}, s AS (SELECT event_id, (tin * coalesce(i, 0) * 100 + tout * coalesce(o, 0) * 100)::BIGINT AS cents FROM ev LEFT JOIN best USING (model)),
r AS (SELECT event_id, cents, sum(cents) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM s) SELECT * FROM r WHERE running - cents <= 20000000000""")
def q58_running_cost_of_all(spark, sf_dir):
    """One order over all events, without a key: no task sees all of them."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    cents = (F.col("tin") * zero(F.col("price_in")) * 100 + F.col("tout") * zero(F.col("price_out")) * 100).cast("decimal(20, 0)").cast("long")
    return metrics.running_cost(c.spent_(spark, sf_dir).select("event_id", cents.alias("cents")), "event_id", "cents", 20_000_000_000)


@query("SELECT event_id, event_type, sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM events")
def q59_running_sums_of_hot_keys(spark, sf_dir):
    """A few keys, each of so many rows that it is dealt by ranges."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return prefix.running(rows, "event_id", "user_id", ("event_type",), per_task=500).select("event_id", "event_type", "running")


_JSONL = """j AS (SELECT doc_id, coalesce(lang, 'none') AS part, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS number, CASE doc_id % 7 WHEN 0 THEN 'no object' WHEN 1 THEN 'missing: category, doctype' END AS reason FROM documents)"""


def truth_files_(spark, sf_dir) -> str:
    """Ground truth of all documents as JSON lines, a folder for each language, with bad lines among them; its files are ranges in order."""
    k, entry = F.col("doc_id") % 7, F.struct(F.col("doc_id").cast("string").alias("filename"), F.lit("d").alias("domain"), F.when(F.col("doc_id") % 7 != 1, "c").alias("category"), F.when(F.col("doc_id") % 7 != 1, "t").alias("doctype"), F.substring("text", 1, 300).alias("notes"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("part"), F.when(k == 0, F.concat(F.lit("{not json "), F.col("doc_id").cast("string"))).otherwise(F.to_json(entry)).alias("value"))
    path = f"{storage.shared_folder(spark)}/truth-{uuid.uuid4().hex}"
    rows.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").select("value", "part").write.partitionBy("part").text(path)
    return path


@query(f"WITH {_JSONL} SELECT part, number, reason FROM j WHERE reason IS NOT NULL")
def q60_bad_lines_by_number(spark, sf_dir):
    """Numbers of bad lines in large files of ground truth, which many tasks read in blocks."""
    bad = lines.bad_lines(spark, f"{truth_files_(spark, sf_dir)}/*", pieces=True)
    return bad.select(F.regexp_extract("file", "part=([^/]+)/", 1).alias("part"), "number", "reason")


# ---- in SQL ----------------------------------------------------------------------------------------------------------


@query(c.SQL["q03_suggested_path"])
def q61_sql_filing_paths(spark, sf_dir):
    """The paths of q03 with the registered SQL functions."""
    sql.register(spark)
    canonicalise.with_singular(canonicalise.canonicalise(c.filings_(spark, sf_dir))).createOrReplaceTempView("canonical_filings")
    return spark.sql("""SELECT o_orderkey, file_name(singular, c_name, subject, day, '.PDF') AS suggested_filename,
filing_path(canon_domain, canon_category, canon_doctype, singular, c_name, subject, day, '.PDF') AS suggested_path FROM canonical_filings""")


@query(f"""WITH d AS (SELECT doc_id, ((length(text) + {c.PAGE - 1}) // {c.PAGE}) AS pages FROM documents), p AS (SELECT doc_id, pages, n AS page FROM d, unnest(range(1, pages + 1)) u(n))
SELECT doc_id, strategy, page::INT AS page FROM p JOIN (VALUES ('full'), ('first_n'), ('bookends'), ('adaptive')) x(strategy) ON pages <= {c.MOST} OR strategy = 'full' OR (strategy = 'first_n' AND page <= {c.MOST})
OR (strategy = 'bookends' AND (page <= {c.MOST - c.MOST // 2} OR page > pages - {c.MOST // 2})) OR (strategy = 'adaptive' AND (pages <= 5 OR (pages <= 20 AND page <= {c.MOST}) OR (pages > 20 AND (page <= {c.MOST - c.MOST // 2} OR page > pages - {c.MOST // 2}))))""")
def q62_sql_sampled_pages(spark, sf_dir):
    """The pages of q08 with the registered table function."""
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("all_documents")
    return spark.sql(f"""WITH d AS (SELECT doc_id, CAST(ceil(length(text) / {c.PAGE}) AS INT) AS pages FROM all_documents WHERE length(text) > 0)
SELECT doc_id, strategy, page FROM d CROSS JOIN (VALUES ('full'), ('first_n'), ('bookends'), ('adaptive')) AS x(strategy), LATERAL sampled_pages(pages, strategy, {c.MOST})""")


# ---- as a stream -----------------------------------------------------------------------------------------------------

FULL = 12  # of the fixed answers, those that lack nothing


class Full(ByLength):
    def answer(self, system: str, human: str) -> Answer:
        if len(human) % REFUSED == 0:
            raise ApiError("refused")
        return Answer(json.dumps(dict(zip(c.COLUMNS, c.ANSWERS[len(human) % FULL], strict=True))))


@query(f"""WITH {c._dims()}, n AS (SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 20000 THEN 20023 ELSE length(coalesce(text, '')) END AS n FROM documents),
a AS (SELECT n.doc_id, n.n, e.* FROM n JOIN (VALUES {values((k, *x) for k, x in enumerate(c.ANSWERS[:FULL]))}) e(k, {', '.join(c.COLUMNS)}) ON e.k = n.n % {FULL}), {c.canon_('a', 'x.*')}
SELECT doc_id || '.txt' AS original, 1::BIGINT AS calls, CASE WHEN n % {REFUSED} = 0 THEN 'LLM_API_ERROR' END AS error_code, CASE WHEN n % {REFUSED} <> 0 THEN coalesce(cd, 'other') END AS domain, CASE WHEN n % {REFUSED} <> 0 THEN subject END AS subject FROM k""")
def q63_stream_of_late_copies(spark, sf_dir):
    """Every document arrives twice, the second time after the first has been classified: one call and one row each."""
    base = f"{storage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), none.alias("error_code"), none.alias("error_message"))
    for minutes in (0, 10):
        docs.withColumn("time", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES")).write.mode("append").parquet(f"{base}/landing")
        arriving = landing.unique_within(spark.readStream.schema("path string, content string, error_code string, error_message string, time timestamp").parquet(f"{base}/landing"), "time")
        landing.classified(arriving, base, lambda p, m: lambda: Full(0), template=BARE, width=4).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(calls.RECORD).json(f"{base}/calls").groupBy(F.col("document").alias("original")).agg(F.count("*").alias("calls"))
    return landing.results(spark, base).join(made, "original").select("original", "calls", "error_code", "domain", "subject")


@query("""SELECT doc_id, sum(length(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS of_all,
sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS of_source FROM documents""")
def q64_characters_so_far(spark, sf_dir):
    """How many characters all documents, and those of a source, hold up to each one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    of_all = prefix.running(rows, "doc_id", "n", out="of_all")
    return prefix.running(of_all, "doc_id", "n", ("source",), "of_source", per_task=10_000).select("doc_id", "of_all", "of_source")


_BLOCK = r"<(h1|p|li|div|footer)\b[^>]*>((?:[^<]|<br>|</?[ab]\b[^>]*>)*)"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>', '', 'g'), '(?s)<style\b.*?</style>', '', 'g'), '(?s)<title\b.*?</title>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS body FROM pages),
x AS (SELECT page_id, unnest(regexp_extract_all(body, '{_BLOCK}', 1)) AS tag, unnest(regexp_extract_all(body, '{_BLOCK}', 2)) AS raw FROM b),
t AS (SELECT page_id, CASE tag WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'item' ELSE 'text' END AS kind, {c.strip_(f"regexp_replace({c.references_("regexp_replace(regexp_replace(raw, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')")}, '{c.WS}+', ' ', 'g')")} AS text FROM x)
SELECT page_id, kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM t WHERE text <> '' GROUP BY ALL UNION ALL SELECT page_id, 'list', len(regexp_extract_all(body, '<ul')), 0 FROM b WHERE contains(body, '<ul')""")
def q65_page_structure(spark, sf_dir):
    """Nodes of the pages' trees by kind, and the characters that they hold."""
    found = structure.nodes(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", "html")
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT coalesce(lang, 'none') AS part, count(*) + 1 AS pages, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars, max(length(coalesce(text, ''))) AS longest FROM documents GROUP BY ALL")
def q66_paged_files(spark, sf_dir):
    """Documents as pages of large texts, one for each language in many pieces, read page by page: pages begin with the end of the line before."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("part"), F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "\\f", " "), F.lit("\f")).alias("value"))
    path = f"{storage.shared_folder(spark)}/paged-{uuid.uuid4().hex}"
    # a task writes a piece of each language's text as it reads documents: no language's rows meet in one
    rows.write.partitionBy("part").text(path)
    n = F.length("content").cast("long")
    read = paged.pages(spark, path, task=8_000_000, pieces=True).select(F.regexp_extract("path", "part=([^/]+)$", 1).alias("part"), n.alias("n"), (n - (F.col("page_no") > 1).cast("int")).alias("own"))
    return read.groupBy("part").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"), F.max("own").alias("longest"))
