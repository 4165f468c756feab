"""What a corpus lacks: documents, categories and doctypes of each domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.vocabulary import Vocabulary, get

# Triples of long documents, one triple a domain, and the doctypes that are plausible in a domain.
LONG_TRIPLES = (
    ("housing", "rental", "lease"),
    ("legal", "contract", "contract"),
    ("legal", "estate", "will"),
    ("insurance", "auto", "policy"),
    ("insurance", "home", "policy"),
    ("financial", "investment", "statement"),
    ("financial", "tax", "return"),
    ("property", "agreement", "agreement"),
    ("household", "documentation", "manual"),
    ("reference", "manual", "manual"),
    ("government", "federal", "form"),
    ("education", "agreement", "agreement"),
)
DEFAULT_TRIPLES = (
    ("career", "employer", "paystub"),
    ("education", "transcript", "report"),
    ("financial", "banking", "statement"),
    ("food", "recipe", "recipe"),
    ("government", "correspondence", "letter"),
    ("household", "expense", "receipt"),
    ("housing", "rental", "lease"),
    ("insurance", "auto", "policy"),
    ("legal", "correspondence", "letter"),
    ("lifestyle", "travel", "itinerary"),
    ("medical", "expense", "invoice"),
    ("personal", "membership", "certificate"),
    ("pets", "expense", "receipt"),
    ("property", "expense", "receipt"),
    ("reference", "manual", "manual"),
    ("utilities", "electric", "invoice"),
)
PLAUSIBLE = {
    "career": ["resume", "paystub", "letter", "report", "certificate", "agreement"],
    "education": ["report", "letter", "certificate", "agreement", "invoice", "receipt"],
    "financial": ["statement", "receipt", "invoice", "return", "letter", "report"],
    "food": ["recipe", "receipt", "guide", "manual"],
    "government": ["letter", "form", "notice", "certificate", "license", "permit"],
    "household": ["receipt", "manual", "warranty", "invoice", "guide", "policy"],
    "housing": ["lease", "listing", "offer", "agreement", "letter", "notice"],
    "insurance": ["policy", "statement", "letter", "notice", "form", "invoice"],
    "legal": ["contract", "letter", "will", "trust", "agreement", "form"],
    "lifestyle": ["itinerary", "receipt", "reservation", "confirmation", "plan"],
    "medical": ["invoice", "statement", "report", "record", "letter", "referral"],
    "personal": ["certificate", "letter", "passport", "identification", "license"],
    "pets": ["receipt", "record", "invoice", "agreement", "certificate"],
    "property": ["receipt", "deed", "estimate", "invoice", "report", "agreement"],
    "reference": ["manual", "guide", "reference"],
    "utilities": ["invoice", "statement", "notice", "letter", "agreement"],
}
LONG_WORDS, SHORT_WORDS = 1100, 320
TRIPLE = "domain string, category string, doctype string"


def state(rows: DataFrame, target: int, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Of every domain: documents, distinct categories and doctypes, missing documents, missing categories."""
    dims = (vocabulary or get()).tables(rows.sparkSession)
    domains = dims["domain"].where("raw = canonical").select(F.col("canonical").alias("domain"))
    wanted = dims["category"].where("raw = canonical").select("domain", F.col("canonical").alias("category"))
    have = rows.groupBy("domain").agg(F.count("*").alias("documents"), F.countDistinct("category").alias("categories"), F.countDistinct("doctype").alias("doctypes"))
    lack = wanted.join(rows.select("domain", "category").distinct(), ["domain", "category"], "left_anti").groupBy("domain").agg(F.count("*").alias("missing_categories"))
    out = domains.join(have, "domain", "left").join(lack, "domain", "left").fillna(0)
    return out.withColumn("deficit", F.greatest(F.lit(target) - F.col("documents"), F.lit(0)))


def candidates(vocabulary: Vocabulary, spark, doctypes_of: dict[str, list[str]]) -> DataFrame:
    """Every (domain, category, doctype) of a domain's categories and its plausible doctypes."""
    dims = vocabulary.tables(spark)
    plausible = spark.createDataFrame([(d, t) for d, ts in doctypes_of.items() for t in ts], "domain string, doctype string")
    return dims["category"].where("raw = canonical").select("domain", F.col("canonical").alias("category")).join(plausible, "domain")


def top_up(rows: DataFrame, target: int, seed: int, pool: DataFrame) -> DataFrame:
    """Triples to add: first missing categories, then missing doctypes, then a seeded order, until each domain has ``target``."""
    have = rows.groupBy("domain").agg(F.count("*").alias("n"))
    new_c = pool.join(rows.select("domain", "category").distinct(), ["domain", "category"], "left_anti").select("domain", "category", "doctype", F.lit(0).alias("stage"))
    new_t = pool.join(rows.select("domain", "doctype").distinct(), ["domain", "doctype"], "left_anti").select("domain", "category", "doctype", F.lit(1).alias("stage"))
    every = pool.select("domain", "category", "doctype", F.lit(2).alias("stage"))
    best = new_c.union(new_t).union(every).groupBy("domain", "category", "doctype").agg(F.min("stage").alias("stage"))
    ranked = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY domain ORDER BY stage, xxhash64(category, doctype, {int(seed)}), category, doctype)"))
    return ranked.join(have, "domain", "left").where(F.col("rank") <= target - F.coalesce("n", F.lit(0))).select("domain", "category", "doctype", "stage", "rank")


def _draw(seed: int, *columns: str):
    """A seeded order that does not depend on how rows are dealt."""
    return F.xxhash64(*columns, F.lit(int(seed)))


def checked(triples: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Triples with ``error``: the first axis that is not in the vocabulary, as strict classification would say it."""
    from cartulary.operators.canonicalise import canonicalise

    return canonicalise(triples, vocabulary, "strict").select(*triples.columns, F.col("error_message").alias("error"))


def asked(triples: DataFrame) -> DataFrame:
    """Triples with ``subject`` and ``words``: what a document of each is to be about, and how long."""
    long = F.broadcast(triples.sparkSession.createDataFrame(LONG_TRIPLES, TRIPLE).withColumn("_long", F.lit(True)))
    subject = F.replace(F.concat_ws(" ", "category", "doctype"), F.lit("_"), F.lit(" "))
    return triples.join(long, ["domain", "category", "doctype"], "left").withColumns({"subject": subject, "words": F.when(F.col("_long"), LONG_WORDS).otherwise(SHORT_WORDS)}).drop("_long")


def from_nothing(spark, count: int, long: int, seed: int, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(domain, category, doctype, stage): ``count`` triples: at most ``long`` of long documents, then each other domain's
    own triple, then seeded ones of the plausible pool."""
    v = vocabulary or get()
    known = lambda d, c, t: v.domain(d) == d and v.category(d, c) is not None and v.doctype(t) is not None
    make = lambda rows: spark.createDataFrame([r for r in rows if known(*r)], TRIPLE)
    draw, axes = _draw(seed, "domain", "category", "doctype"), ("domain", "category", "doctype")
    first = make(LONG_TRIPLES).orderBy(draw).limit(long)
    pool = candidates(v, spark, PLAUSIBLE)
    own = make(DEFAULT_TRIPLES)
    # a domain whose own triple the vocabulary lacks takes one of the pool
    other = pool.join(own, "domain", "left_anti").groupBy("domain").agg(F.min_by(F.struct("category", "doctype"), draw).alias("t")).select("domain", "t.*")
    second = own.unionByName(other).join(first.select("domain").distinct(), "domain", "left_anti").select(*axes)
    picks = first.withColumn("stage", F.lit(0)).unionByName(second.withColumn("stage", F.lit(1)))
    rest = pool.join(picks, list(axes), "left_anti").withColumn("stage", F.lit(2))
    return picks.unionByName(rest.select(*picks.columns)).orderBy("stage", draw).limit(count)


def three_stages(rows: DataFrame, documents: int, categories: int, doctypes: int, seed: int, vocabulary: Vocabulary | None = None, plausible: dict[str, list[str]] | None = None) -> DataFrame:
    """Triples to add to a corpus: (domain, category, doctype, stage, n).

    Stage 1 adds missing categories until a domain has ``categories`` of them, stage 2 missing doctypes until it has
    ``doctypes``, stage 3 pads it to ``documents``, every other one from the long triples where it has some.  The corpus
    is counted first, so all else is as large as the vocabulary, and a stage sees what those before it add.
    """
    v, spark = vocabulary or get(), rows.sparkSession
    dims, draw = v.tables(spark), lambda *c: _draw(seed, "domain", *c)
    domains = dims["domain"].where("raw = canonical").select(F.col("canonical").alias("domain"))
    own = dims["category"].where("raw = canonical").select("domain", F.col("canonical").alias("category"))
    fits = spark.createDataFrame([(d, t) for d, ts in (plausible or PLAUSIBLE).items() for t in ts], "domain string, doctype string")
    have = rows.groupBy("domain", "category", "doctype").agg(F.count("*").alias("n")).join(domains, "domain", "left_semi")

    def lacking(all_: DataFrame, axis: str, held: DataFrame, target: int) -> DataFrame:
        """The first missing terms of an axis, as many as a domain lacks."""
        seen = held.where(F.col(axis).isNotNull()).select("domain", axis).distinct()
        many = seen.groupBy("domain").agg(F.count("*").alias("seen"))
        missing = all_.join(seen, ["domain", axis], "left_anti").join(many, "domain", "left")
        return missing.withColumn("k", F.expr(f"row_number() OVER (PARTITION BY domain ORDER BY xxhash64(domain, {axis}, {int(seed)}), {axis})")).where(F.col("k") <= target - F.coalesce("seen", F.lit(0))).select("domain", axis)

    one_doctype = fits.groupBy("domain").agg(F.min_by("doctype", F.struct(draw("doctype"), "doctype")).alias("doctype"))
    first = lacking(own, "category", have, categories).join(one_doctype, "domain").select("domain", "category", "doctype")
    after = have.select("domain", "category", "doctype").unionByName(first)
    # a domain that has none yet takes any of its own categories
    options = after.where("category IS NOT NULL").select("domain", "category").distinct().join(own, ["domain", "category"], "left_semi")
    options = options.unionByName(own.join(options.select("domain").distinct(), "domain", "left_anti").select("domain", "category"))
    one_category = options.groupBy("domain").agg(F.min_by("category", F.struct(draw("category"), "category")).alias("category"))
    second = lacking(fits, "doctype", after, doctypes).join(one_category, "domain").select("domain", "category", "doctype")
    counted = have.groupBy("domain").agg(F.sum("n").alias("n"))
    added = first.unionByName(second).groupBy("domain").agg(F.count("*").alias("added"))
    short = domains.join(counted, "domain", "left").join(added, "domain", "left").select("domain", (F.lit(documents) - F.coalesce("n", F.lit(0)) - F.coalesce("added", F.lit(0))).alias("short")).where("short > 0")
    known = after.unionByName(second).where("doctype IS NOT NULL").select("domain", "doctype").distinct()
    known = known.unionByName(fits.join(known.select("domain").distinct(), "domain", "left_anti"))
    bag = lambda df, axis: df.groupBy("domain").agg(F.sort_array(F.collect_set(axis)).alias(f"{axis}s"))
    long = spark.createDataFrame(LONG_TRIPLES, TRIPLE).groupBy("domain").agg(F.sort_array(F.collect_set(F.struct("category", "doctype"))).alias("longs"))
    pads = short.join(bag(options, "category"), "domain").join(bag(known, "doctype"), "domain").join(long, "domain", "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("short").cast("int"))))
    pick = lambda array, salt: F.get(array, F.pmod(F.xxhash64("domain", "k", F.lit(f"{seed} {salt}")), F.size(array)).cast("int"))
    is_long = F.col("longs").isNotNull() & (F.pmod(F.xxhash64("domain", "k", F.lit(f"{seed} long")), F.lit(2)) == 0)
    chosen = F.when(is_long, pick(F.col("longs"), "l")).otherwise(F.struct(pick(F.col("categorys"), "c").alias("category"), pick(F.col("doctypes"), "d").alias("doctype")))
    third = pads.select("domain", chosen.alias("t")).select("domain", "t.category", "t.doctype")
    stages = [df.withColumn("stage", F.lit(k)) for k, df in enumerate((first, second, third), 1)]
    return stages[0].unionByName(stages[1]).unionByName(stages[2]).groupBy("domain", "category", "doctype", "stage").agg(F.count("*").alias("n"))


def taken_names(*names: DataFrame) -> DataFrame:
    """File names of several listings, each once."""
    out = names[0].select("filename")
    for df in names[1:]:
        out = out.unionByName(df.select("filename"))
    return out.where("filename IS NOT NULL").distinct()


def not_yet(planned: DataFrame, *names: DataFrame) -> DataFrame:
    """Planned documents whose ``filename`` is not taken."""
    return planned.join(taken_names(*names), "filename", "left_anti")


def shared_terms(vocabulary: Vocabulary, spark, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(term, domains): canonical doctypes, in their singular or plural, that are also categories, but for allowed ones."""
    dims = vocabulary.tables(spark)
    types = dims["singular"].select(F.explode(F.array("canonical", "one")).alias("term")).distinct()
    terms = dims["category"].where("raw = canonical").select("domain", F.col("canonical").alias("term"))
    return terms.join(types, "term", "left_semi").where(~F.col("term").isin(*allowed) if allowed else F.lit(True)).groupBy("term").agg(F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"))
