"""Text functions over Columns: all of them stay in the JVM.

Python's str.strip and \\s know Unicode white space; (?U) gives Java's patterns the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATE = "00000000"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Lower case, stripped, spaces to underscores; tabs and hyphens inside stay."""
    return F.replace(strip(F.lower(c)), F.lit(" "), F.lit("_"))


def discovery_normalise(c: Column) -> Column:
    return F.translate(strip(F.lower(c)), " -", "__")


def harvest_normalise(c: Column) -> Column:
    return F.nullif(normalise(c), F.lit(""))


def vendor_slug(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", "-"), "[^a-z0-9-]", ""), F.lit(""))


def year_bucket(c: Column) -> Column:
    """The first year from 1900 to 2099 anywhere, else null."""
    return F.nullif(F.regexp_extract(c, r"(19|20)\d{2}", 0), F.lit(""))


def component(c: Column, limit: int = 40) -> Column:
    """A part of a file name: words joined by single underscores, at most ``limit`` characters."""
    words = F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", "_"), "[^a-z0-9_]", "")
    joined = F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(joined, 1, limit), "_+$", "")


def vendor_component(c: Column) -> Column:
    """Without company suffixes, then as any part."""
    return component(F.regexp_replace(c, r"(?iU)\b(inc|llc|ltd|corp|co|company)\b\.?", ""))


def date_digits(c: Column) -> Column:
    """Eight digits; six are of this century; more than eight are cut; anything else is no date.  No calendar is asked."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    return F.when(n == 8, digits).when(n == 6, F.concat(F.lit("20"), digits)).when(n > 8, F.substring(digits, 1, 8)).otherwise(F.lit(NO_DATE))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(c: Column) -> Column:
    """With its dot; a name that begins with its only dot has none."""
    return F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def vendor_tokens(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def subject_covers(expected: Column, predicted: Column) -> Column:
    """Every expected token occurs in the prediction; an empty subject is covered by an empty one only."""
    e, p = tokens(expected), tokens(predicted)
    return F.when(F.size(e) == 0, F.size(p) == 0).otherwise(F.size(F.array_except(e, p)) == 0)


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def synthetic_filename(vendor: Column, doctype: Column, iso: Column, limit: int = 50) -> Column:
    tail = F.concat(F.lit("_"), doctype, F.lit("_"), iso, F.lit(".pdf"))
    head, room = slug(vendor), F.lit(limit) - F.length(tail)
    short = F.regexp_replace(F.substring(head, F.lit(1), F.greatest(room, F.lit(0))), "-+$", "")
    return F.concat(F.when(F.length(head) > room, short).otherwise(head), tail)


#: What stands between head and tail of a cut text; it does not count.
CUT = "\n\n[... truncated ...]\n\n"


def truncate(c: Column, cap: int = 20_000) -> Column:
    """Head and tail, 14 : 6, of a text longer than ``cap``."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    head = cap * 14 // 20
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(CUT), F.right(c, F.lit(cap - head))))


# What a generated text may not hold.
MARKERS = ("ignore previous", "ignore the previous", "system:", "assistant:", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def sanitised(c: Column) -> Column:
    """The stripped text; null if it holds a marker or begins with a code fence."""
    marked = F.lower(c).contains(MARKERS[0])
    for m in MARKERS[1:]:
        marked = marked | F.lower(c).contains(m)
    return F.when(~marked & ~F.startswith(strip(c), F.lit("```")), strip(c))


# The kinds of Markdown lines, the first that fits counts.
LINE_KINDS = (
    ("rule", r"^(-{3,}|_{3,}|\*{3,})$"),
    ("separator", r"^\s*\|?[\s:\-|]+\|[\s:\-|]+\|?\s*$"),
    ("row", r"^\s*\|.*\|\s*$"),
    ("h3", r"^###\s+.+$"),
    ("h2", r"^##\s+.+$"),
    ("h1", r"^#\s+.+$"),
    ("bullet", r"^[\-*]\s+.+$"),
    ("numbered", r"^\d+\.\s+.+$"),
)


def line_kind(c: Column) -> Column:
    """What a Markdown line is: rule, separator, row, h1, h2, h3, bullet, numbered, blank or text."""
    kind = F.when(strip(c) == "", "blank")
    for name, pattern in LINE_KINDS:
        kind = kind.when(c.rlike(pattern), name)
    return kind.otherwise("text")


def valid_ground_truth_date(c: Column, strict: bool = True) -> Column:
    """Eight digits, or no date at all.  strict: a zero year, month or day among others is no date; else only the year is asked."""
    partial = F.substring(c, 1, 4) == "0000"
    if strict:
        partial = partial | (F.substring(c, 5, 2) == "00") | (F.substring(c, 7, 2) == "00")
    return (c == NO_DATE) | (c.rlike(r"^[0-9]{8}$") & ~partial)
