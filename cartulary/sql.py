"""The naming rules and the page sampling as SQL functions, for sessions that speak SQL only.

All but one are SQL functions: Spark puts their bodies in place of the call, so they cost what the Columns cost and stay in the JVM.
``file_component``, ``file_vendor``, ``file_date``, ``file_name``, ``folder_path``, ``filing_path`` and ``path_problem`` are scalar;
``sampled_pages(pages, strategy, most)`` is a table function, for a lateral join: the pages of a document that are read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartulary.functions.paths import LIMITS, Limits
from cartulary.functions.text import NO_DATE
from cartulary.operators.sampling import STRATEGIES


def _component(x: str, limit: int) -> str:
    stripped = rf"regexp_replace(lower({x}), r'(?U)^\s+|\s+$', '')"
    words = rf"regexp_replace(regexp_replace({stripped}, r'(?U)\s+', '_'), '[^a-z0-9_]', '')"
    joined = f"regexp_replace(regexp_replace({words}, '_+', '_'), '^_+|_+$', '')"
    return f"regexp_replace(substring({joined}, 1, {limit}), '_+$', '')"


def _vendor(x: str, limit: int) -> str:
    return _component(rf"regexp_replace({x}, r'(?iU)\b(inc|llc|ltd|corp|co|company)\b\.?', '')", limit)


def definitions(limits: Limits = LIMITS) -> list[str]:
    """The CREATE statements, each after those that it uses."""
    digits = "regexp_replace(x, '[^0-9]', '')"
    head, tail = "(most - most div 2)", "(most div 2)"
    rule = f"""CASE strategy WHEN 'full' THEN true WHEN 'first_n' THEN page <= most WHEN 'bookends' THEN page <= {head} OR page > pages - {tail}
WHEN 'adaptive' THEN CASE WHEN pages <= 5 THEN true WHEN pages <= 20 THEN page <= most ELSE page <= {head} OR page > pages - {tail} END
ELSE raise_error('strategy must be one of {", ".join(STRATEGIES)}') END"""
    folders = "slice(split(path, '/'), 1, size(split(path, '/')) - 1)"
    bad = f"get(filter({folders}, f -> NOT f RLIKE '^[{limits.folder_characters}]+$'), 0)"
    return [
        f"file_component(x STRING) RETURNS STRING RETURN {_component('x', limits.part)}",
        f"file_vendor(x STRING) RETURNS STRING RETURN {_vendor('x', 40)}",
        f"file_date(x STRING) RETURNS STRING RETURN CASE WHEN length({digits}) = 8 THEN {digits} WHEN length({digits}) = 6 THEN concat('20', {digits}) WHEN length({digits}) > 8 THEN substring({digits}, 1, 8) ELSE '{NO_DATE}' END",
        """file_name(doctype STRING, vendor STRING, subject STRING, date STRING, extension STRING) RETURNS STRING
RETURN concat(concat_ws('-', nullif(file_component(doctype), ''), nullif(file_vendor(vendor), ''), nullif(file_component(subject), ''), file_date(date)),
CASE WHEN lower(extension) = '' OR startswith(extension, '.') THEN lower(extension) ELSE concat('.', lower(extension)) END)""",
        f"folder_path(domain STRING, category STRING, doctype STRING) RETURNS STRING RETURN concat_ws('/', slice(array(domain, category, doctype), 1, {limits.depth}))",
        """filing_path(domain STRING, category STRING, plural STRING, singular STRING, vendor STRING, subject STRING, date STRING, extension STRING) RETURNS STRING
RETURN concat_ws('/', folder_path(domain, category, plural), file_name(singular, vendor, subject, date, extension))""",
        f"""path_problem(path STRING) RETURNS STRING RETURN CASE WHEN length(path) > {limits.path} THEN concat('Generated path exceeds max length of {limits.path}: ', length(path), ' chars')
WHEN size({folders}) > {limits.depth} THEN concat('Generated path exceeds max folder depth of {limits.depth}: ', size({folders}), ' levels')
WHEN {bad} IS NOT NULL THEN concat('Folder segment ''', {bad}, ''' contains disallowed characters (allowed: [{limits.folder_characters}])') END""",
        f"sampled_pages(pages INT, strategy STRING, most INT) RETURNS TABLE (page INT) RETURN SELECT page FROM (SELECT explode(sequence(1, greatest(pages, 1))) AS page) WHERE pages > 0 AND (pages <= most OR {rule})",
    ]


def register(spark: SparkSession, limits: Limits = LIMITS) -> None:
    """Define the functions in a session, in place of older ones of these names."""
    for body in definitions(limits):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
