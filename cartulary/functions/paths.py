"""File names and folder paths, and the checks they must pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions import text


@dataclass(frozen=True)
class Limits:
    path: int = 255
    depth: int = 4
    name: int = 255
    part: int = 40
    folder_characters: str = "a-z0-9_-"
    name_characters: str = "a-z0-9_-"


LIMITS = Limits()


def filename(doctype: Column, vendor: Column, subject: Column, date: Column, extension: Column, limits: Limits = LIMITS) -> Column:
    """doctype-vendor-subject-date.extension; empty parts are left out, a missing dot is added."""
    ext = F.lower(extension)
    dotted = F.when((ext == "") | F.startswith(ext, F.lit(".")), ext).otherwise(F.concat(F.lit("."), ext))
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.concat_ws("-", part(text.component(doctype, limits.part)), part(text.vendor_component(vendor)), part(text.component(subject, limits.part)), text.date_digits(date)), dotted)


def folder(domain: Column, category: Column, doctype: Column, limits: Limits = LIMITS) -> Column:
    return F.concat_ws("/", F.slice(F.array(domain, category, doctype), 1, limits.depth))


def filename_error(name: Column, limits: Limits = LIMITS) -> Column:
    """Why a name is not allowed, or null; the extension's characters are not asked."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(F.length(name) > limits.name, F.concat(F.lit(f"Filename exceeds max length of {limits.name}: "), F.length(name).cast("string"), F.lit(" chars"))).when(
        ~base.rlike(f"^[{limits.name_characters}]+$"), F.lit("Filename contains disallowed characters")
    )


def path_error(path: Column, limits: Limits = LIMITS) -> Column:
    """Why a path is not allowed, or null: its length, its depth, then the characters of its folders."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    bad = F.get(F.filter(folders, lambda f: ~f.rlike(f"^[{limits.folder_characters}]+$")), F.lit(0))
    return (
        F.when(F.length(path) > limits.path, F.concat(F.lit(f"Generated path exceeds max length of {limits.path}: "), F.length(path).cast("string"), F.lit(" chars")))
        .when(F.size(folders) > limits.depth, F.concat(F.lit(f"Generated path exceeds max folder depth of {limits.depth}: "), F.size(folders).cast("string"), F.lit(" levels")))
        .when(bad.isNotNull(), F.concat(F.lit("Folder segment '"), bad, F.lit(f"' contains disallowed characters (allowed: [{limits.folder_characters}])")))
    )


#: Naming policies by name: how a file name is built of doctype, vendor, subject, date and extension.
POLICIES = {"nara": filename}


def register(name: str, builder) -> None:
    """Make a naming policy known by name: Columns of doctype, vendor, subject, date and extension to one of the name."""
    POLICIES[name.lower()] = builder


def policy(name: str):
    if name.lower() not in POLICIES:
        raise ValueError(f"unknown naming policy {name!r}; available: {', '.join(sorted(POLICIES))}")
    return POLICIES[name.lower()]
