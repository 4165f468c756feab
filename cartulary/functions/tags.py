"""Tags of files: ordered lists, in which only what the mode says is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("replace", "add", "update", "missing")
FIELDS = ("domain", "category", "doctype", "vendor", "date", "subject")


def without(these: Column, others: Column) -> Column:
    """Of ``these`` those that ``others`` lack, repeats and order kept."""
    return F.filter(these, lambda x: ~F.array_contains(others, x))


def final_tags(existing: Column, new: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown tag mode {mode!r}")
    has = F.size(existing) > 0
    return {
        "replace": new,
        "add": F.concat(existing, without(new, existing)),
        "update": F.when(has, new).otherwise(existing),
        "missing": F.when(has, existing).otherwise(new),
    }[mode]


def tags_of(row: dict[str, Column], fields: tuple[str, ...] = FIELDS) -> Column:
    """The values of ``fields`` in that order, empty ones left out, of a date the year."""
    unknown = [f for f in fields if f not in FIELDS]
    if unknown:
        raise ValueError(f"unknown tag fields: {', '.join(unknown)}")
    year = F.when(F.length(row["date"]) >= 4, F.substring(row["date"], 1, 4)) if "date" in row else None
    return F.filter(F.array(*[year if f == "date" else row[f] for f in fields]), lambda x: x.isNotNull() & (x != ""))


def description(added: Column, removed: Column) -> Column:
    part = lambda name, tags: F.when(F.size(tags) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(tags, ", "), F.lit("]")))
    return F.coalesce(F.nullif(F.concat_ws(", ", part("add", added), part("remove", removed)), F.lit("")), F.lit("no changes"))
