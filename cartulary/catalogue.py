"""The queries registered for the engine's own operators, and the same in DuckDB's SQL.

The tables hold no classifier's output, so each row's raw terms are those of the list below at its key modulo the list's
length; both sides read the same list.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary import storage
from cartulary.functions import json, paths, tags, text
from cartulary.operators import canonicalise, dashboard, evaluate, experiments, harvest, metrics, sampling
from cartulary.plans import actions, coverage
from cartulary.sources import files, lines
from cartulary.vocabulary import get

#: domain, category, doctype, vendor, date, subject of a classifier's answer.
ANSWERS = (
    ("financial", "banking", "statement", "Chase Inc.", "20240115", "checking account"),
    ("Finance", "checking", "bank_statement", "Home Depot LLC", "240220", "kitchen faucet"),
    ("medical", "rx", "receipt", "Acme Corp", "2023-11-05", "pet supplies"),
    ("doctor", "visit", "summary", "Test Ltd", "2022/01/31", "annual exam"),
    ("home", "home repairs", "invoice", "Smith & Co", "19991231", "roof repair"),
    ("Real Estate", "lease", "Rental Agreement", "Harvest Table Company", "", "two bedroom flat"),
    ("auto", "vehicle", "registration", "City of Oak", "2024", "car plates"),
    ("gov", "federal", "1040", "IRS", "20240415", "tax return"),
    ("food", "purchase", "ticket", "Corner Shop", "00000000", "groceries"),
    ("unknown", "banking", "mystery", "  Blank  ", "n/a", ""),
    ("career", "resume", "cv", "Big Employer Inc", "20210607", "job search"),
    ("legal", "contract", "contract", "Law LLC", "20200229", "service terms"),
    ("pets", "spending", "order", "Dog-food Co.", "20230303", "dog food"),
    ("", "banking", "statement", "", "20230101", "empty domain"),
    ("utilities", "electric", "bill", "Power Corp.", "12/31/2022 23:59", "electric bill"),
    ("travel", "trip", "itinerary", "Air Line", "20250102", "summer trip"),
    ("insurance", "billing", "insurance policy", "Safe Ltd.", "202506", "car policy"),
    ("\u00a0Finance\u2003", "\u3000checking", "bank statement\u2028", "Café\u00a0du Nord\u2003Inc.", "2024\u20130115", "\u2003Été à la mer"),
    ("", "", "", "", "", ""),
    ("\u00a0", "\t", " \n ", "\u2003", "\u00a0", "\u205f"),
)
COLUMNS = ("domain", "category", "doctype", "vendor", "date", "subject")
#: A cell of the fixed lists as SQL.
quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'" if isinstance(s, str) else str(s)
values = lambda rows: ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answered(df: DataFrame, key, shift: int = 0, prefix: str = "") -> DataFrame:
    """Add the answer of each row's key: one array of literals, read by place."""
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(a, COLUMNS, strict=True)]) for a in ANSWERS])
    at = F.element_at(listed, ((key + shift) % len(ANSWERS) + 1).cast("int"))
    return df.withColumns({prefix + c: at[c] for c in COLUMNS})


def answers_sql(source: str, key: str, shift: int = 0, prefix: str = "", keep: str = "s.*") -> str:
    picked = ", ".join(f"e.{c} AS {prefix}{c}" for c in COLUMNS)
    return f"SELECT {keep}, {picked} FROM {source} s JOIN (VALUES {values((n, *a) for n, a in enumerate(ANSWERS))}) e(n, {', '.join(COLUMNS)}) ON e.n = ({key} + {shift}) % {len(ANSWERS)}"


# ---- SQL of the text functions ---------------------------------------------------------------------------------------

#: Unicode's white space.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def references_(x: str) -> str:
    """Character references of the pages; & comes last, so that what it leaves is not read again."""
    for name, char in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("#x27", 39), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
        x = f"regexp_replace({x}, '&{name};?', chr({char}), 'g')"
    return x


def norm_(x: str) -> str:
    return f"replace({strip_(f'lower({x})')}, ' ', '_')"


def component_(x: str, limit: int = 40) -> str:
    words = rf"regexp_replace(regexp_replace({strip_(f'lower({x})')}, '{WS}+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
    return f"regexp_replace(substr(regexp_replace(regexp_replace({words}, '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, {limit}), '_+$', '')"


def vendor_(x: str) -> str:
    return component_(rf"regexp_replace({x}, '(?i)\b(inc|llc|ltd|corp|co|company)\b\.?', '', 'g')")


def date_(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) = 8 THEN {d} WHEN length({d}) = 6 THEN '20' || {d} WHEN length({d}) > 8 THEN substr({d}, 1, 8) ELSE '00000000' END"


def filename_(doctype: str, vendor: str, subject: str, date: str, ext: str) -> str:
    return f"concat_ws('-', nullif({component_(doctype)}, ''), nullif({vendor_(vendor)}, ''), nullif({component_(subject)}, ''), {date_(date)}) || {ext}"


def _dims() -> str:
    v = get()
    return f"""dd(raw, canonical) AS (VALUES {values(sorted(v.domains.items()))}),
dc(domain, raw, canonical) AS (VALUES {values(sorted((d, r, c) for (d, r), c in v.categories.items()))}),
dt(raw, canonical) AS (VALUES {values(sorted(v.doctypes.items()))}),
ds(canonical, one) AS (VALUES {values(sorted(v.singulars.items()))})"""


def canon_(source: str, keep: str, name: str = "k") -> str:
    """CTE ``name``: source with cd, cc, ct, null where unknown."""
    return f"""{name} AS (SELECT {keep}, dd.canonical AS cd, dc.canonical AS cc, dt.canonical AS ct FROM {source} x
LEFT JOIN dd ON dd.raw = {norm_('x.domain')} LEFT JOIN dc ON dc.domain = dd.canonical AND dc.raw = {norm_('x.category')} LEFT JOIN dt ON dt.raw = {norm_('x.doctype')})"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DOCS = f"a AS ({answers_sql('documents', 's.doc_id', keep='s.doc_id')})"


def docs_(spark, sf_dir, shift: int = 0) -> DataFrame:
    return answered(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), shift)


@query(f"WITH {_dims()}, {DOCS}, {canon_('a', 'x.doc_id')} SELECT doc_id, coalesce(cd, 'other') AS canon_domain, coalesce(cc, 'other') AS canon_category, coalesce(ct, 'other') AS canon_doctype FROM k")
def q01_canonicalize(spark, sf_dir):
    return canonicalise.canonicalise(docs_(spark, sf_dir)).select("doc_id", "canon_domain", "canon_category", "canon_doctype")


@query(f"""WITH {_dims()}, {DOCS}, {canon_('a', 'x.*')} SELECT doc_id, cd AS canon_domain, cc AS canon_category, ct AS canon_doctype,
CASE WHEN cd IS NULL OR cc IS NULL OR ct IS NULL THEN 'TAXONOMY_VALIDATION_FAILED' END AS error_code,
CASE WHEN cd IS NULL THEN 'unknown domain: ' || domain WHEN cc IS NULL THEN 'unknown category: ' || category WHEN ct IS NULL THEN 'unknown doctype: ' || doctype END AS error_message FROM k""")
def q02_canonicalize_strict_errors(spark, sf_dir):
    return canonicalise.canonicalise(docs_(spark, sf_dir), mode="strict").select("doc_id", "canon_domain", "canon_category", "canon_doctype", "error_code", "error_message")


def filings_(spark, sf_dir) -> DataFrame:
    """Orders with their customers: raw terms by order, vendor and date of the row's own."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return answered(orders.join(customers, "o_custkey"), F.col("o_orderkey"))


FILINGS = f"f AS (SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y%m%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey), a AS ({answers_sql('f', 's.o_orderkey')})"
PLACED = f"""{FILINGS}, {canon_('a', 'x.*')}, n AS (SELECT o_orderkey, c_name, day, coalesce(cd, 'other') AS d, coalesce(cc, 'other') AS c, coalesce(ct, 'other') AS t, coalesce(ds.one, ct, 'other') AS one, subject FROM k LEFT JOIN ds ON ds.canonical = ct),
p AS (SELECT o_orderkey, d || '/' || c || '/' || t AS folder, {filename_('one', 'c_name', 'subject', 'day', "'.pdf'")} AS name FROM n)"""


def placed_(spark, sf_dir) -> DataFrame:
    rows = canonicalise.with_singular(canonicalise.canonicalise(filings_(spark, sf_dir)))
    name = paths.filename(F.col("singular"), F.col("c_name"), F.col("subject"), F.col("day"), F.lit(".PDF"))
    return rows.select("o_orderkey", paths.folder(F.col("canon_domain"), F.col("canon_category"), F.col("canon_doctype")).alias("folder"), name.alias("name"))


@query(f"WITH {_dims()}, {PLACED} SELECT o_orderkey, name AS suggested_filename, folder || '/' || name AS suggested_path FROM p")
def q03_suggested_path(spark, sf_dir):
    return placed_(spark, sf_dir).select("o_orderkey", F.col("name").alias("suggested_filename"), F.concat_ws("/", "folder", "name").alias("suggested_path"))


@query(f"""WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '.pdf' WHEN p_partkey % 3 = 1 THEN ' x.pdf' ELSE repeat('y', 260) END AS name, {component_('p_name')} || '-' || p_size || '.txt' AS good FROM part)
SELECT p_partkey, CASE WHEN length(name) > 255 THEN 'Filename exceeds max length of 255: ' || length(name) || ' chars' WHEN NOT regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '^[a-z0-9_-]+$') THEN 'Filename contains disallowed characters' END AS error,
CASE WHEN NOT regexp_matches(regexp_replace(good, '\\.[^.]*$', ''), '^[a-z0-9_-]+$') THEN 'Filename contains disallowed characters' END AS good_error FROM n""")
def q04_filename_validation(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".pdf").when(F.col("p_partkey") % 3 == 1, " x.pdf").otherwise(F.repeat(F.lit("y"), F.lit(260))))
    good = F.concat(text.component(F.col("p_name")), F.lit("-"), F.col("p_size").cast("string"), F.lit(".txt"))
    return part.select("p_partkey", paths.filename_error(name).alias("error"), paths.filename_error(good).alias("good_error"))


VENDORS = ("Acme Inc.", "Test LLC", "Smith & Sons Co.", "Harvest Table Co-op", "  Tab\tCompany ", "A very long vendor name that goes on and on well past forty characters", "___", "", "Corp", "Ltd. Limited ltd")


@query(f"""WITH v AS (SELECT s_suppkey AS k, s_name || ' ' || x.suffix AS vendor FROM supplier JOIN (VALUES {values((n, s) for n, s in enumerate(VENDORS))}) x(n, suffix) ON x.n = s_suppkey % {len(VENDORS)}
UNION ALL SELECT c_custkey + 1000000, c_name || ', Inc' FROM customer)
SELECT k, {vendor_('vendor')} AS part, nullif(regexp_replace(regexp_replace({strip_('lower(vendor)')}, '{WS}+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '') AS slug, array_to_string(regexp_extract_all(lower(vendor), '[a-z0-9]+'), ' ') AS tokens FROM v""")
def q05_vendor_normalize(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, VENDORS)), (F.col("s_suppkey") % len(VENDORS) + 1).cast("int"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat_ws(" ", "s_name", suffix).alias("vendor"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("k"), F.concat("c_name", F.lit(", Inc")).alias("vendor"))
    v = F.col("vendor")
    return suppliers.unionByName(customers).select("k", text.vendor_component(v).alias("part"), text.vendor_slug(v).alias("slug"), text.vendor_tokens(v).alias("tokens"))


FORMATS = (("yyyyMMdd", "%Y%m%d"), ("yyMMdd", "%y%m%d"), ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("yyyy", "%Y"), ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"))


@query(f"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % {len(FORMATS)} {' '.join(f"WHEN {n} THEN strftime(o_orderdate, '{p}')" for n, (_, p) in enumerate(FORMATS))} END AS raw FROM orders)
SELECT o_orderkey, {date_('raw')} AS date, nullif(regexp_extract(raw, '(19|20)[0-9]{{2}}'), '') AS year, CASE WHEN length(raw) >= 4 THEN substr(raw, 1, 4) END AS tag FROM d""")
def q06_date_normalize(spark, sf_dir):
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % len(FORMATS)
    raw = reduce(lambda c, x: c.when(key == x[0], F.date_format(day, x[1][0])), list(enumerate(FORMATS))[1:], F.when(key == 0, F.date_format(day, FORMATS[0][0])))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", text.date_digits(F.col("raw")).alias("date"), text.year_bucket(F.col("raw")).alias("year"), F.when(F.length("raw") >= 4, F.substring("raw", 1, 4)).alias("tag"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 20000 THEN text ELSE substr(text, 1, 14000) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(text, 6000) END) AS full_cap,
CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 140) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(text, 60) END AS small_cap FROM documents""")
def q07_truncate_head_tail(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate(t)).alias("full_cap"), text.truncate(t, 200).alias("small_cap"))


PAGE, MOST = 500, 4


@query(f"""WITH p AS (SELECT doc_id, n AS page, ((length(text) + {PAGE - 1}) // {PAGE}) AS pages, substr(text, (n - 1) * {PAGE} + 1, {PAGE}) AS t FROM documents, unnest(range(1, (length(text) + {PAGE - 1}) // {PAGE} + 1)) u(n)),
s AS (SELECT x.strategy, p.* FROM p JOIN (VALUES ('full'), ('first_n'), ('bookends'), ('adaptive')) x(strategy) ON pages <= {MOST} OR strategy = 'full' OR (strategy = 'first_n' AND page <= {MOST}) OR (strategy = 'bookends' AND (page <= {MOST - MOST // 2} OR page > pages - {MOST // 2}))
OR (strategy = 'adaptive' AND (pages <= 5 OR (pages <= 20 AND page <= {MOST}) OR (pages > 20 AND (page <= {MOST - MOST // 2} OR page > pages - {MOST // 2})))))
SELECT doc_id, strategy, count(*) AS pages_sampled, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page) FILTER (regexp_matches(t, '[^\\s]')), '')) AS content FROM s GROUP BY ALL""")
def q08_page_sampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.ceil(F.length("text") / PAGE).cast("int").alias("pages"))
    cut = docs.where("pages > 0").select("doc_id", "text", "pages", F.explode(F.sequence(F.lit(1), "pages")).alias("page_no"))
    picks = F.array(*[F.when(sampling.sampled(F.col("page_no"), F.col("pages"), s, MOST), F.lit(s)) for s in sampling.STRATEGIES])
    some = cut.select("doc_id", "page_no", F.substring("text", (F.col("page_no") - 1) * PAGE + 1, F.lit(PAGE)).alias("content"), F.explode(F.array_compact(picks)).alias("strategy"))
    joined = sampling.joined_pages(some.withColumn("path", F.struct("doc_id", "strategy")))
    return joined.select("path.doc_id", "path.strategy", "pages_sampled", F.md5("content").alias("content"))


@query("SELECT md5(text) AS content, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def q09_ground_truth_dedupe(spark, sf_dir):
    """Documents as lines of a ground-truth file, comments, blank and bad lines among them, through its reader."""
    entry = F.to_json(F.struct(F.md5("text").alias("filename"), F.col("source").alias("domain"), F.lit("c").alias("category"), F.lit("t").alias("doctype")))
    raw = F.explode(F.array(F.lit(" # note"), entry, F.lit(""), F.regexp_replace(entry, "[}]$", ""), F.regexp_replace(entry, "doctype", "none")))
    found = lines.truth_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), raw.alias("raw")))
    return found.select(F.col("filename").alias("content"), F.col("line").alias("doc_id"), F.col("domain").alias("source"))


TRUTH = f"""t AS (SELECT doc_id AS filename, domain AS a_domain, category AS a_category, doctype AS a_doctype, CASE WHEN quality = 1 THEN vendor END AS a_vendor, CASE WHEN toxic = 0 THEN date END AS a_date FROM ({answers_sql('labels', 's.doc_id')})),
p AS (SELECT doc_id AS filename, upper(domain) AS p_domain, category AS p_category, doctype AS p_doctype, lower(vendor) AS p_vendor, date AS p_date FROM ({answers_sql('documents', "s.doc_id + CASE WHEN s.doc_id % 7 = 0 THEN 1 ELSE 0 END", keep='s.doc_id')})),
c AS (SELECT *, lower(p_domain) = lower(a_domain) AS domain_ok, lower(p_category) = lower(a_category) AS category_ok, lower(p_doctype) = lower(a_doctype) AS doctype_ok, CASE WHEN a_vendor IS NOT NULL THEN lower(p_vendor) = lower(a_vendor) END AS vendor_ok, CASE WHEN a_date IS NOT NULL THEN p_date = a_date END AS date_ok FROM p JOIN t USING (filename))"""


def predictions_(spark, sf_dir, every: int = 7) -> DataFrame:
    key = F.col("doc_id") + F.when(F.col("doc_id") % every == 0, 1).otherwise(0)
    rows = answered(table(spark, sf_dir, "documents").select("doc_id"), key)
    return rows.select(F.col("doc_id").alias("filename"), F.upper("domain").alias("domain"), "category", "doctype", F.lower("vendor").alias("vendor"), "date")


def truth_(spark, sf_dir) -> DataFrame:
    rows = answered(table(spark, sf_dir, "labels"), F.col("doc_id"))
    return rows.select(F.col("doc_id").alias("filename"), "domain", "category", "doctype", F.when(F.col("quality") == 1, F.col("vendor")).alias("vendor"), F.when(F.col("toxic") == 0, F.col("date")).alias("date"))


def compared_(spark, sf_dir) -> DataFrame:
    return evaluate.compared(predictions_(spark, sf_dir), truth_(spark, sf_dir))


@query(f"""WITH {TRUTH} SELECT count(*) AS total, coalesce(avg(domain_ok::INT), 0) AS domain_accuracy, coalesce(avg(category_ok::INT), 0) AS category_accuracy, coalesce(avg(doctype_ok::INT), 0) AS doctype_accuracy, avg(vendor_ok::INT) AS vendor_accuracy, avg(date_ok::INT) AS date_accuracy FROM c""")
def q10_eval_accuracy(spark, sf_dir):
    return evaluate.accuracy(compared_(spark, sf_dir)).drop("path_joint", "filename_joint")


@query(f"WITH {TRUTH} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, lower(a_{a}) AS actual, lower(p_{a}) AS predicted, count(*) AS n FROM c GROUP BY ALL" for a in canonicalise.AXES))
def q11_confusion_matrix(spark, sf_dir):
    return evaluate.confusion(compared_(spark, sf_dir))


@query("SELECT l.doc_id AS filename FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def q12_missing_ground_truth(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("filename"))
    return evaluate.unmatched(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filename")), files)


MODELS = (("ollama", "gemma4:latest"), ("openai", "gpt-4o-mini"), ("anthropic", "claude-3-5-haiku-latest"))


def records_(spark, sf_dir) -> DataFrame:
    """A run of every part with every model: some fail, some answer with a neighbour's terms."""
    runs = experiments.matrix(table(spark, sf_dir, "part").select("p_partkey", "p_size"), list(MODELS))
    key = F.col("p_partkey") + F.when((F.col("p_partkey") + F.length("model")) % 5 == 0, 1).otherwise(0)
    rows = answered(answered(runs, F.col("p_partkey"), prefix="e_"), key, prefix="r_")
    matches = evaluate.strict_matches({c: F.col(f"e_{c}") for c in COLUMNS}, {c: F.col(f"r_{c}") for c in COLUMNS})
    out = rows.select(
        F.col("p_partkey").alias("document"), "provider", "model", ((F.col("p_partkey") * 7 + F.length("model") * 13) % 997).alias("latency_ms"),
        ((F.col("p_partkey") + F.length("provider")) % 11 != 0).alias("success"), matches.alias("matches"),
    )
    return out.withColumn("matches", F.when(F.col("success"), F.col("matches"))).withColumn("all_match", experiments.all_match("matches"))


_E = answers_sql("r0", "s.p_partkey", prefix="e_")
RECORDS = f"""r0 AS (SELECT p_partkey, m.provider, m.model, p_partkey + CASE WHEN (p_partkey + length(m.model)) % 5 = 0 THEN 1 ELSE 0 END AS rk FROM part, (VALUES {values(MODELS)}) m(provider, model)), r1 AS ({_E}), r2 AS ({answers_sql('r1', 's.rk', prefix='r_')}),
r3 AS (SELECT *, (p_partkey * 7 + length(model) * 13) % 997 AS latency_ms, (p_partkey + length(provider)) % 11 <> 0 AS success, regexp_extract_all(lower(e_subject), '[a-z0-9]+') AS es, regexp_extract_all(lower(r_subject), '[a-z0-9]+') AS rs FROM r2),
rec AS (SELECT p_partkey AS document, provider, model, latency_ms, success, CASE WHEN success THEN e_domain = r_domain END AS m_domain, CASE WHEN success THEN e_category = r_category END AS m_category, CASE WHEN success THEN e_doctype = r_doctype END AS m_doctype, CASE WHEN success THEN e_date = r_date END AS m_date,
CASE WHEN success THEN array_to_string(regexp_extract_all(lower(e_vendor), '[a-z0-9]+'), ' ') = array_to_string(regexp_extract_all(lower(r_vendor), '[a-z0-9]+'), ' ') END AS m_vendor, CASE WHEN success THEN CASE WHEN len(es) = 0 THEN len(rs) = 0 ELSE len(list_filter(es, lambda x: NOT list_contains(rs, x))) = 0 END END AS m_subject FROM r3),
rr AS (SELECT *, coalesce(m_domain AND m_category AND m_doctype AND m_vendor AND m_date AND m_subject, false) AS all_match FROM rec)"""


@query(f"WITH {RECORDS} SELECT document, provider, model, latency_ms, success, {', '.join(f'm_{f} AS match_{f}' for f in experiments.FIELDS)}, all_match FROM rr")
def q13_experiment_matrix(spark, sf_dir):
    return records_(spark, sf_dir).select("document", "provider", "model", "latency_ms", "success", *[F.try_element_at("matches", F.lit(f)).alias(f"match_{f}") for f in experiments.FIELDS], "all_match")


@query(f"WITH {RECORDS} SELECT provider, model, count(*) AS n, {', '.join(f'avg(coalesce(m_{f}, false)::INT) AS {f}_accuracy' for f in experiments.FIELDS)}, avg(all_match::INT) AS all_accuracy FROM rr WHERE success GROUP BY ALL")
def q14_accuracy_by_model(spark, sf_dir):
    return experiments.accuracy_by_model(records_(spark, sf_dir))


@query(f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT '{n}' AS field, sum(({c})::INT)::BIGINT AS correct, count(*) AS total, avg(({c})::INT) AS accuracy FROM rr WHERE success" for n, c in [*((f, f"m_{f}") for f in experiments.FIELDS), ("ALL", "all_match")]))
def q15_accuracy_by_field(spark, sf_dir):
    return experiments.accuracy_by_field(records_(spark, sf_dir))


@query("""WITH e AS (SELECT user_id % 20 AS model, floor(value * 10)::BIGINT AS latency_ms FROM events WHERE event_type <> 'error'),
r AS (SELECT model, list_sort(list(latency_ms)) AS v, count(*) AS n, sum(latency_ms)::BIGINT // count(*) AS mean, max(latency_ms) AS max FROM e GROUP BY model)
SELECT model, n, v[n // 2 + 1] AS p50, v[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95, mean, max FROM r""")
def q16_latency_order_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select((F.col("user_id") % 20).alias("model"), F.floor(F.col("value") * 10).alias("latency_ms"), (F.col("event_type") != "error").alias("success"))
    return experiments.latency(rows, "model")


@query("""SELECT count(*) AS total, count_if(event_type <> 'error') AS successful, count_if(event_type = 'error') AS failed, count(DISTINCT event_id % 100) AS documents, count(DISTINCT user_id % 20) AS models,
CASE WHEN count_if(event_type = 'error') = 0 THEN 0 WHEN count_if(event_type <> 'error') > 0 THEN 1 ELSE 2 END AS exit_code FROM events""")
def q17_run_summary_exit_code(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select((F.col("event_id") % 100).alias("document"), F.lit("p").alias("provider"), (F.col("user_id") % 20).alias("model"), (F.col("event_type") != "error").alias("success"))
    return experiments.summary(rows)


HARVEST = f"""{_dims()}, {DOCS}, {canon_('a', 'x.*')}, h AS (SELECT *, nullif({norm_('domain')}, '') AS rd, nullif({norm_('category')}, '') AS rc, nullif({norm_('doctype')}, '') AS rt FROM k), g AS (SELECT * FROM h WHERE rd IS NOT NULL AND rc IS NOT NULL AND rt IS NOT NULL),
l AS (SELECT 'domain' AS field, rd AS raw, cd AS canonical, NULL::VARCHAR AS domain FROM g UNION ALL SELECT 'category', rc, cc, coalesce(cd, rd) FROM g UNION ALL SELECT 'doctype', rt, ct, NULL FROM g)"""


def harvest_(spark, sf_dir, shift: int = 0) -> DataFrame:
    return harvest.normalised(docs_(spark, sf_dir, shift))


@query(f"WITH {HARVEST} SELECT 'raw' AS kind, field AS axis, raw AS term, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'canonical', field, canonical, count(*) FROM l WHERE canonical IS NOT NULL GROUP BY ALL")
def q18_term_frequency(spark, sf_dir):
    return harvest.term_frequency(harvest_(spark, sf_dir))


@query(f"WITH {HARVEST} SELECT field, raw, canonical, domain, count(*) AS n FROM l WHERE raw IS DISTINCT FROM canonical GROUP BY ALL")
def q19_drift(spark, sf_dir):
    return harvest.drift(harvest_(spark, sf_dir))


@query(f"WITH {HARVEST} SELECT 'raw' AS kind, rd AS domain, rc AS category, rt AS doctype, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'canonical', cd, cc, ct, count(*) FROM g GROUP BY ALL")
def q20_tuple_counts(spark, sf_dir):
    return harvest.tuples(harvest_(spark, sf_dir))


@query("""SELECT 'vendor' AS kind, nullif(regexp_replace(regexp_replace(lower(c_name), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '') AS term, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT 'year', strftime(o_orderdate, '%Y'), count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def q21_vendor_year_freq(spark, sf_dir):
    rows = filings_(spark, sf_dir).select(F.col("c_name").alias("vendor"), F.col("day").alias("date"))
    one = lambda df, c: df.select(F.lit(c).alias("kind"), F.col(c).alias("term"), "n")
    return one(harvest.vendors(rows), "vendor").unionByName(one(harvest.years(rows), "year"))


@query(f"""WITH {DOCS}, n AS (SELECT translate({strip_('lower(domain)')}, ' -', '__') AS d, translate({strip_('lower(category)')}, ' -', '__') AS c, translate({strip_('lower(doctype)')}, ' -', '__') AS t FROM a),
l AS (SELECT DISTINCT 'domain' AS kind, NULL::VARCHAR AS domain, d AS term FROM n UNION SELECT 'category', d, c FROM n UNION SELECT 'doctype', NULL, t FROM n)
SELECT kind, domain, string_agg(term, ',' ORDER BY term) AS terms FROM l GROUP BY ALL""")
def q22_vocab_discovery(spark, sf_dir):
    return harvest.discovered(docs_(spark, sf_dir))


@query(f"""WITH {DOCS}, b AS ({answers_sql('documents', 's.doc_id', 3, keep='s.doc_id')}),
x AS (SELECT {norm_('doctype')} AS term, count(*) AS base FROM a GROUP BY ALL), y AS (SELECT CASE doctype WHEN 'order' THEN 'work_order' ELSE {norm_('doctype')} END AS term, count(*) AS new FROM b GROUP BY ALL)
SELECT term, coalesce(base, 0) AS base, coalesce(new, 0) AS new, coalesce(new, 0) - coalesce(base, 0) AS delta FROM x FULL JOIN y USING (term)""")
def q23_harvest_delta(spark, sf_dir):
    """Two harvests of all documents; what the first calls an order is a work order to the second, so each has a term of its own."""
    count = lambda df: df.groupBy(text.normalise(F.col("doctype")).alias("term")).agg(F.count("*").alias("n"))
    new = docs_(spark, sf_dir, 3).withColumn("doctype", F.when(F.col("doctype") == "order", "work order").otherwise(F.col("doctype")))
    return harvest.delta(count(docs_(spark, sf_dir)), count(new), "term")


@query(f"""WITH {_dims()}, {DOCS}, {canon_('a', 'x.doc_id')}, have AS (SELECT cd AS domain, count(*) AS documents, count(DISTINCT cc) AS categories, count(DISTINCT ct) AS doctypes FROM k GROUP BY 1),
lack AS (SELECT w.domain, count(*) AS missing_categories FROM dc w WHERE w.raw = w.canonical AND NOT EXISTS (SELECT 1 FROM k WHERE cd = w.domain AND cc = w.canonical) GROUP BY 1)
SELECT d.canonical AS domain, coalesce(documents, 0) AS documents, coalesce(categories, 0) AS categories, coalesce(doctypes, 0) AS doctypes, coalesce(missing_categories, 0) AS missing_categories, greatest(60 - coalesce(documents, 0), 0) AS deficit
FROM dd d LEFT JOIN have h ON h.domain = d.canonical LEFT JOIN lack l ON l.domain = d.canonical WHERE d.raw = d.canonical""")
def q24_coverage_deficit(spark, sf_dir):
    rows = canonicalise.canonicalise(docs_(spark, sf_dir), mode="null").select(F.col("canon_domain").alias("domain"), F.col("canon_category").alias("category"), F.col("canon_doctype").alias("doctype"))
    return coverage.state(rows, 60)


_TAGS = "list_filter([domain, category, CASE WHEN length(date) >= 4 THEN substr(date, 1, 4) END], lambda x: x IS NOT NULL AND x <> '')"
_FINAL = {
    "replace": "new",
    "add": "list_concat(old, list_filter(new, lambda x: NOT list_contains(old, x)))",
    "update": "CASE WHEN len(old) > 0 THEN new ELSE old END",
    "missing": "CASE WHEN len(old) > 0 THEN old ELSE new END",
}
_TAGGED = f"""{DOCS}, o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 1 THEN [domain, 'kept'] ELSE ['old', 'old', category] END AS old, {_TAGS} AS new FROM a)"""


@query(f"WITH {_TAGGED}, f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS mode, old, {e} AS final FROM o" for m, e in _FINAL.items()) + """), g AS (SELECT doc_id, mode, final, list_filter(final, lambda x: NOT list_contains(old, x)) AS added, list_filter(old, lambda x: NOT list_contains(final, x)) AS removed FROM f)
SELECT doc_id, mode, array_to_string(final, '|') AS final_tags, coalesce(nullif(concat_ws(', ', CASE WHEN len(added) > 0 THEN 'add: [' || array_to_string(added, ', ') || ']' END, CASE WHEN len(removed) > 0 THEN 'remove: [' || array_to_string(removed, ', ') || ']' END), ''), 'no changes') AS description FROM g""")
def q25_tag_plan(spark, sf_dir):
    rows = docs_(spark, sf_dir)
    k = F.col("doc_id") % 3
    rows = rows.withColumn("existing_tags", F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("domain", F.lit("kept"))).otherwise(F.array(F.lit("old"), F.lit("old"), "category")))
    plans = [actions.tag_plan(rows, m, ("domain", "category", "date")).select("doc_id", F.lit(m).alias("mode"), F.array_join("final_tags", "|").alias("final_tags"), "description") for m in tags.MODES]
    return reduce(DataFrame.unionByName, plans)


@query(f"WITH {_dims()}, {PLACED}, r AS (SELECT o_orderkey, folder, regexp_replace(name, '-[0-9]+\\.pdf$', '.pdf') AS target FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY folder, target ORDER BY o_orderkey) - 1 AS kk FROM r) SELECT o_orderkey, folder, CASE WHEN kk > 0 THEN regexp_replace(target, '\\.pdf$', '') || '-' || kk || '.pdf' ELSE target END AS new_name FROM w")
def q26_rename_collisions(spark, sf_dir):
    rows = placed_(spark, sf_dir).select("o_orderkey", "folder", F.regexp_replace("name", r"-[0-9]+\.pdf$", ".pdf").alias("target"))
    return actions.rename_all(rows, "folder", "target", "o_orderkey").select("o_orderkey", "folder", "new_name")


NAMES = ("openai/gpt-4o", "openai/gpt-4o-mini", "openai/gpt-4-turbo-2024", "ollama/gemma4:latest", "anthropic/claude-3-5-haiku-latest", "nobody/none", "gpt-4")
_PRICED = f"""pr(k, i, o, n) AS (VALUES {values((k, i, o, n) for n, (k, i, o) in enumerate(metrics.PRICES))}), nm(n, model) AS (VALUES {values(enumerate(NAMES))}),
best AS (SELECT model, i, o FROM (SELECT nm.model, pr.i, pr.o, row_number() OVER (PARTITION BY nm.model ORDER BY (nm.model <> pr.k), length(pr.k) DESC, pr.n) AS r FROM nm JOIN pr ON contains(nm.model, pr.k) OR contains(pr.k, nm.model)) WHERE r = 1),
ev AS (SELECT e.event_id, nm.model, (e.user_id % 5000 + 100) * 100 AS tin, e.event_id % 700 * 100 AS tout FROM events e JOIN nm ON nm.n = e.event_id % {len(NAMES)})"""


def spent_(spark, sf_dir) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", model.alias("model"), ((F.col("user_id") % 5000 + 100) * 100).alias("tin"), (F.col("event_id") % 700 * 100).alias("tout"))
    return metrics.priced(rows)


@query(f"WITH {_PRICED} SELECT event_id, ev.model, round_even(((tin / 1e6) * i + (tout / 1e6) * o)::DOUBLE, 6) AS cost_usd FROM ev LEFT JOIN best USING (model)")
def q27_cost_estimate(spark, sf_dir):
    return spent_(spark, sf_dir).select("event_id", "model", metrics.cost(F.col("tin"), F.col("tout"), F.col("price_in"), F.col("price_out")).alias("cost_usd"))


@query(f"""WITH {_PRICED}, c AS (SELECT event_id, model, (tin * coalesce(i, 0) * 100 + tout * coalesce(o, 0) * 100)::BIGINT AS cents FROM ev LEFT JOIN best USING (model)),
s AS (SELECT *, sum(cents) OVER (PARTITION BY model ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM c) SELECT event_id, model, cents, running FROM s WHERE running - cents <= 2000000000""")
def q28_running_cost_cutoff(spark, sf_dir):
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cents = (F.col("tin") * zero(F.col("price_in")) * 100 + F.col("tout") * zero(F.col("price_out")) * 100).cast("decimal(20, 0)").cast("long")
    rows = spent_(spark, sf_dir).select("event_id", "model", cents.alias("cents"))
    return metrics.running_cost(rows, "event_id", "cents", 2_000_000_000, "model")


#: Folder of a run, by the language of its documents; others are in the last one.
FOLDERS = {"en": "20260429-baseline", "fr": "2026-04-30-real-world", "de": "post-audit-20260501", "es": "20260503-picture-ocr-real-world", None: "undated-structured-real-world"}
_FOLDER = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FOLDERS.items() if k) + f" ELSE '{FOLDERS[None]}' END"
#: A run is a source's documents of one language: its accuracies stand for shares of texts by their length.
_RUNS = f"""g AS (SELECT coalesce(source, 'a source without any name') AS model, lang, {_FOLDER} AS folder, CASE WHEN count(*) % 2 = 0 THEN 'gemma4_docling.json' ELSE 'x.json' END AS file, count_if(length(text) % 3 = 0) / count(*)::DOUBLE AS d, count_if(length(text) % 2 = 0) / count(*)::DOUBLE AS c FROM documents GROUP BY ALL),
z AS (SELECT model || '-' || coalesce(lang, '') AS run_id, folder, file, model, d, c, CASE WHEN lang <> 'fr' THEN d END AS v, 1 AS run_order, 1 AS held FROM g UNION ALL SELECT model || '-' || coalesce(lang, ''), folder, file, model, c, d, c, 2, 0 FROM g WHERE lang IN ('en', 'de') UNION ALL SELECT 'new-' || model || '-' || coalesce(lang, ''), folder, file, model, c, c, NULL, 3, 0 FROM g),
runs AS (SELECT run_id, folder, file, model, d AS domain_accuracy, c AS category_accuracy, v AS vendor_accuracy, run_order, held,
CASE WHEN regexp_extract(file, '_([a-z]+)\\.json$', 1) IN ('docling', 'unstructured') THEN regexp_extract(file, '_([a-z]+)\\.json$', 1) ELSE 'unknown' END AS loader,
CASE WHEN contains(folder, 'real-world') OR contains(folder, 'post-audit') OR contains(folder, 'realworld') THEN 'real-world' ELSE 'synthetic' END AS corpus,
CASE WHEN regexp_matches(folder, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN regexp_extract(folder, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') WHEN regexp_matches(folder, '[0-9]{{8}}') THEN regexp_replace(regexp_extract(folder, '[0-9]{{8}}'), '(....)(..)(..)', '\\1-\\2-\\3') ELSE 'unknown' END AS date,
CASE WHEN contains(folder, 'picture-ocr') THEN 'picture-region-ocr' WHEN contains(folder, 'structured') AND contains(folder, 'real-world') THEN 'structured-regions' WHEN contains(folder, 'post-audit') THEN 'full-page-ocr' END AS loader_variant
FROM z), ok AS (SELECT * FROM runs WHERE coalesce(domain_accuracy, category_accuracy, vendor_accuracy) IS NOT NULL AND date <> 'unknown'),
merged AS (SELECT * FROM ok WHERE held = 1 UNION ALL SELECT * FROM ok WHERE held = 0 AND run_id NOT IN (SELECT run_id FROM runs WHERE held = 1))"""


def runs_(spark, sf_dir) -> DataFrame:
    """Held runs, as a dashboard keeps them, and found ones, written as the files of run folders and read from these."""
    docs, lang = table(spark, sf_dir, "documents"), F.col("lang")
    folder = reduce(lambda c, kv: c.when(lang == kv[0], kv[1]), [kv for kv in FOLDERS.items() if kv[0]][1:], F.when(lang == "en", FOLDERS["en"])).otherwise(FOLDERS[None])
    share = lambda k: (F.count_if(F.length("text") % k == 0) / F.count("*")).alias(f"of{k}")
    groups = docs.groupBy(F.coalesce("source", F.lit("a source without any name")).alias("model"), "lang").agg(F.count("*").alias("n"), share(3), share(2))
    groups = groups.withColumns({"folder": folder, "file": F.when(F.col("n") % 2 == 0, "gemma4_docling.json").otherwise("x.json"), "own": F.concat("model", F.lit("-"), F.coalesce("lang", F.lit("")))})
    none = F.lit(None).cast("double")
    run = lambda name, d, c, v, order: groups.select(name.alias("run_id"), "folder", "file", "model", "lang", d.alias("domain_accuracy"), c.alias("category_accuracy"), v.alias("vendor_accuracy"), F.lit(order).alias("run_order"))
    of2, of3 = F.col("of2"), F.col("of3")
    held = run(F.col("own"), of3, of2, F.when(lang != "fr", of3), 1).drop("lang").withColumns({c: none for c in ("doctype_accuracy", "date_accuracy", "runtime_seconds", "wallclock_s")})
    again = run(F.col("own"), of2, of3, of2, 2).where(lang.isin("en", "de")).unionByName(run(F.concat(F.lit("new-"), "own"), of2, of2, none, 3)).drop("lang")
    # a file for each run, of which there are as many as sources have languages
    root = f"{storage.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    body = F.to_json(F.struct(*[c for c in again.columns if c not in ("folder", "file")], F.array(F.struct(F.lit("private").alias("file"))).alias("documents")))
    for r in again.select("folder", "file", "run_id", body.alias("body")).toLocalIterator():
        storage.put(spark, f"{root}/{r['folder']}/{uuid.uuid5(uuid.NAMESPACE_URL, r['run_id']).hex}_{r['file']}", r["body"])
    found = dashboard.described(lines.run_folders(spark, root, f"run_id string, run_order int, {dashboard.RUN}"))
    return dashboard.merged(dashboard.described(held), found)


@query(f"WITH {_RUNS} SELECT run_id, date, corpus, model, loader, loader_variant, domain_accuracy FROM merged")
def q29_dashboard_merge(spark, sf_dir):
    return runs_(spark, sf_dir).select("run_id", "date", "corpus", "model", "loader", "loader_variant", "domain_accuracy")


DATES = ("2026-04-29", "2026-04-30", "2026-05-03")


@query(f"""WITH {_RUNS}, s AS (SELECT CASE WHEN length(model) > 22 THEN substr(model, 1, 20) || '…' ELSE model END || ' + ' || loader || CASE WHEN loader_variant IS NOT NULL THEN ' (' || loader_variant || ')' ELSE '' END AS series, date, domain_accuracy AS v, run_order FROM merged)
SELECT series, {', '.join(f"floor(max_by(v, run_order) FILTER (date = '{d}') * 1000 + 0.5) / 10 AS {quoted(d).replace(chr(39), chr(34))}" for d in DATES)} FROM s GROUP BY series""")
def q30_dashboard_series_pivot(spark, sf_dir):
    return dashboard.pivot(runs_(spark, sf_dir), "domain_accuracy", list(DATES))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"domain": "financial", "category": "banking", "doctype": "bill", "vendor": "V' || user_id || '", "date": "20240101", "subject": "s"}' WHEN 2 THEN '{"domain": "financial", "category": 5, "doctype": "bill", "vendor": "v", "date": "20240101", "subject": "s"}' ELSE 'not json' END AS response FROM events)
SELECT event_id, event_id % 4 = 1 AS parsed, CASE WHEN event_id % 4 = 1 THEN json_extract_string(response, '$.vendor') END AS vendor, CASE WHEN event_id % 4 <> 1 THEN 'LLM_PARSE_ERROR' END AS error_code FROM r""")
def q31_json_parse_required_fields(spark, sf_dir):
    k, good = F.col("event_id") % 4, '{"domain": "financial", "category": "banking", "doctype": "bill", "vendor": "V%s", "date": "20240101", "subject": "s"}'
    response = F.when(k == 0, F.col("props")).when(k == 1, F.format_string(good, F.col("user_id").cast("string"))).when(k == 2, F.lit('{"domain": "financial", "category": 5, "doctype": "bill", "vendor": "v", "date": "20240101", "subject": "s"}')).otherwise("not json")
    rows = json.parsed(table(spark, sf_dir, "events").select("event_id", response.alias("response")), "response")
    return rows.select("event_id", F.col("fields").isNotNull().alias("parsed"), F.col("fields.vendor").alias("vendor"), "error_code")


@query(f"""WITH a AS ({answers_sql('conversations', '(s.conv_id + s.turn)', keep='s.conv_id, s.turn')}) SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 < 5 THEN domain END AS domain, CASE WHEN (conv_id + turn) % 6 < 5 THEN doctype END AS doctype, CASE WHEN (conv_id + turn) % 6 = 5 OR domain IS NULL THEN 'LLM_PARSE_ERROR' END AS error_code FROM a""")
def q32_json_repair(spark, sf_dir):
    """Answers wrapped and bent in ways that only the repair can read, and one in six that is none; the SQL knows what was bent."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = answered(turns, F.col("conv_id") + F.col("turn"))
    body = F.to_json(F.struct(*COLUMNS))
    bent = F.element_at(F.array(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")), F.concat(F.lit("{"), body, F.lit("}")), F.regexp_replace(body, r"\}$", ",}"), F.translate(body, '"', "'"), F.concat(F.lit("<x>{}</classification_analysis> "), body), F.concat(F.lit("[1, 2] "), F.col("text"))), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    out = json.parsed(rows.select("conv_id", "turn", bent.alias("response")), "response")
    return out.select("conv_id", "turn", "fields.domain", "fields.doctype", "error_code")


_LOADED = references_(r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)', ' ', 'g'), '<[^<>]*>', chr(10), 'g')")


@query(f"""WITH t AS (SELECT page_id, {_LOADED} AS t FROM pages),
c AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip_('x')}), lambda x: x <> ''), chr(10)) AS c FROM t)
SELECT page_id, md5(c) AS content, 1 AS page_count, 'text/html' AS mime_type, CASE WHEN c = '' THEN 'no text in the document' END AS error_message FROM c""")
def q33_html_load(spark, sf_dir):
    """Every page as the bytes of an HTML file, through the loader."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".HTML")).alias("path"), F.encode("html", "utf-8").alias("content"))
    loaded = files.loaded(files.pages(pages))
    return loaded.select(F.regexp_extract("path", "^[^.]*", 0).cast("long").alias("page_id"), F.md5("content").alias("content"), "page_count", "mime_type", "error_message")


@query(f"""WITH {TRUTH}, q AS (SELECT doc_id AS filename, domain, category, doctype FROM ({answers_sql('documents', 's.doc_id + CASE WHEN s.doc_id % 3 = 0 THEN 1 ELSE 0 END', keep='s.doc_id')})),
b AS (SELECT filename, lower(domain) = lower(a_domain) AS domain_ok, lower(category) = lower(a_category) AS category_ok, lower(doctype) = lower(a_doctype) AS doctype_ok FROM q JOIN t USING (filename))
SELECT filename, {', '.join(f'c.{a}_ok AS {a}_a, b.{a}_ok AS {a}_b' for a in canonicalise.AXES)} FROM c FULL JOIN b USING (filename)""")
def q34_ab_compare(spark, sf_dir):
    one = evaluate.compared(predictions_(spark, sf_dir), truth_(spark, sf_dir))
    other = evaluate.compared(predictions_(spark, sf_dir, 3), truth_(spark, sf_dir))
    return evaluate.side_by_side(one, other)


@query(f"WITH {TRUTH} SELECT coalesce(avg((domain_ok AND category_ok AND doctype_ok)::INT), 0) AS path_joint, avg((vendor_ok AND date_ok)::INT) AS filename_joint FROM c")
def q35_path_joint(spark, sf_dir):
    return evaluate.accuracy(compared_(spark, sf_dir)).select("path_joint", "filename_joint")


@query(f"""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN role || ': System: ' || text WHEN conv_id % 5 = 1 THEN '  ```' || text WHEN conv_id % 5 = 2 THEN '  ' || text || ' ' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT ({' OR '.join(f"contains(lower(t), '{m}')" for m in text.MARKERS)}) AND NOT starts_with({strip_('t')}, '```') THEN md5({strip_('t')}) END AS clean FROM r""")
def q36_injection_filter(spark, sf_dir):
    k = F.col("conv_id") % 5
    t = F.when(k == 0, F.concat("role", F.lit(": System: "), "text")).when(k == 1, F.concat(F.lit("  ```"), "text")).when(k == 2, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.sanitised(t)).alias("clean"))


#: What is put around the k-th line of a document, so that lines of every kind occur.
DRESSES = (("", ""), ("# ", ""), ("## ", ""), ("###  ", ""), ("- ", ""), ("12. ", ""), ("| ", " |"), ("--- ", ""), ("#", ""), ("*", ""))
BARE = ("---", "| --- | :-: |", " \t ", "****", "a|b|")
_LINES = f"""l AS (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents),
l2 AS (SELECT CASE WHEN k < {len(DRESSES)} THEN d.before || z[1] || d.after ELSE b.bare END AS l FROM (SELECT z, (doc_id + z[2]) % {len(DRESSES) + len(BARE)} AS k FROM l) x LEFT JOIN (VALUES {values((n, *d) for n, d in enumerate(DRESSES))}) d(n, before, after) ON d.n = k LEFT JOIN (VALUES {values((n + len(DRESSES), b) for n, b in enumerate(BARE))}) b(n, bare) ON b.n = k)"""


@query(rf"""WITH {_LINES},
k AS (SELECT CASE WHEN regexp_replace(l, '\s', '', 'g') = '' THEN 'blank' WHEN regexp_matches(l, '^(-{{3,}}|_{{3,}}|\*{{3,}})$') THEN 'rule' WHEN regexp_matches(l, '^\s*\|?[\s:\-|]+\|[\s:\-|]+\|?\s*$') THEN 'separator' WHEN regexp_matches(l, '^\s*\|.*\|\s*$') THEN 'row'
WHEN regexp_matches(l, '^###\s+.+$') THEN 'h3' WHEN regexp_matches(l, '^##\s+.+$') THEN 'h2' WHEN regexp_matches(l, '^#\s+.+$') THEN 'h1' WHEN regexp_matches(l, '^[\-*]\s+.+$') THEN 'bullet' WHEN regexp_matches(l, '^[0-9]+\.\s+.+$') THEN 'numbered' ELSE 'text' END AS kind FROM l2) SELECT kind, count(*) AS n FROM k GROUP BY ALL""")
def q37_markdown_line_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    k = ((F.col("doc_id") + F.col("i")) % (len(DRESSES) + len(BARE))).cast("int")
    dressed = F.array(*[F.concat(F.lit(a), "l", F.lit(b)) for a, b in DRESSES], *map(F.lit, BARE))
    return rows.select(F.get(dressed, k).alias("l")).groupBy(text.line_kind(F.col("l")).alias("kind")).agg(F.count("*").alias("n"))


@query()
def q38_stream_classify(spark, sf_dir):
    from cartulary.streaming import landing

    return landing.drained(spark, f"{sf_dir}/documents.parquet")


def queries() -> dict:
    from cartulary import catalogue_more, catalogue_runs  # noqa: F401, their queries add themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
