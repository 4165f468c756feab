"""Plans of what to do with files, tags and renames, and carrying them out.

A plan is a DataFrame.  An action carries out rows of it where the files are: renames on a file system that the driver
sees, tags through an adapter.  What fails is a row too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cartulary.functions import tags
from cartulary.operators import prefix
from cartulary.storage import held


def tag_plan(df: DataFrame, mode: str, fields: tuple[str, ...] = ("domain", "category", "doctype")) -> DataFrame:
    """existing_tags -> final_tags, tags_added, tags_removed, description."""
    new = tags.tags_of({f: F.col(f) for f in fields}, fields)
    out = df.withColumn("final_tags", tags.final_tags(F.coalesce("existing_tags", F.array().cast("array<string>")), new, mode))
    out = out.withColumns({"tags_added": tags.without(F.col("final_tags"), F.col("existing_tags")), "tags_removed": tags.without(F.col("existing_tags"), F.col("final_tags"))})
    return out.withColumn("description", tags.description(F.col("tags_added"), F.col("tags_removed")))


def rename_all(df: DataFrame, folder: str, target: str, order: str, existing: DataFrame | None = None, mark: str = "-", per_task: int = prefix.PER_TASK) -> DataFrame:
    """Add ``new_name``: the first of a folder's rows that want a name gets it, the others that name with the next free suffix.

    existing: (folder, name) of files that are there.  A suffix is taken where such a file, or another row's wish, bears
    it; no two rows and no file share a name.  A row whose file already bears its name, or that name with a suffix (column
    ``own``, if there is one), keeps it.  The k-th row that needs a suffix gets k plus as many as are taken below
    it: places among the rows, places among what is taken and the one between the other are running counts, so a name
    that very many rows want is many tasks' work.
    """
    base, ext = F.regexp_replace(target, r"(?<=.)\.[^.]+$", ""), F.regexp_extract(target, r"^.+(\.[^.]+)$", 1)
    own = F.col("own") if "own" in df.columns else F.lit(None).cast("string")
    # names may be costly to make, and are read several times
    rows = held(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(folder).alias("_folder"), F.col(target).alias("_target"), F.col(order).alias("_order"), base.alias("_base"), ext.alias("_ext"), own.alias("_own")))
    if existing is None:
        existing = df.sparkSession.createDataFrame([], f"folder {df.schema[folder].dataType.simpleString()}, name string")
    there = existing.select(F.col("folder").alias("_folder"), F.col("name").alias("_name")).distinct()
    wish = rows.select("_folder", F.col("_target").alias("_name"))
    suffix = rf"{re.escape(mark)}([1-9][0-9]{{0,8}})(\.[^.]+)?$"
    # its own name, or that with a suffix from an earlier time
    bare = F.regexp_replace("_own", suffix, "$2")
    stays = F.coalesce((F.col("_own") == F.col("_target")) | (bare == F.col("_target")), F.lit(False))
    rows = rows.join(there.withColumnsRenamed({"_folder": "_f", "_name": "_n"}).withColumn("_held", F.lit(True)), F.col("_folder").eqNullSafe(F.col("_f")) & (F.col("_target") == F.col("_n")), "left").drop("_f", "_n")
    rows = rows.withColumns({"_stays": stays, "_one": F.lit(1).cast("long")})
    rows = held(prefix.running(rows, "_order", "_one", ("_folder", "_target", "_stays"), "_seat", per_task))
    takes = F.col("_held").isNull() & (F.col("_seat") == 1)
    kept = rows.where(F.col("_stays") | takes).select("_row", F.when(F.col("_stays"), F.col("_own")).otherwise(F.col("_target")).alias("new_name"))
    keys = ("_folder", "_base", "_ext")
    # the seat among those that need a suffix; where the name was free, its first seat has it
    need = rows.where(~F.col("_stays") & ~takes).select("_row", *keys, (F.col("_seat") - F.col("_held").isNull().cast("int")).alias("_k"))
    # suffixes that are taken; below the j-th of them, n, stand n - j free ones
    names = there.unionByName(wish).distinct().where(F.col("_name").rlike(suffix))
    taken = names.select("_folder", F.regexp_replace("_name", suffix, "").alias("_base"), F.regexp_extract("_name", suffix, 2).alias("_ext"), F.regexp_extract("_name", suffix, 1).cast("long").alias("_n"), F.lit(1).cast("long").alias("_one"))
    free = prefix.running(taken, "_n", "_one", keys, "_j", per_task).select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *keys, (F.col("_n") - F.col("_j") + 1).alias("_k"), F.lit(1).cast("long").alias("_one"))
    both = free.unionByName(need.withColumn("_one", F.lit(0).cast("long"))).withColumn("_last", F.col("_one") == 0)
    met = prefix.running(both, ["_k", "_last"], "_one", keys, "_passed", per_task).where("_last")
    placed = met.select("_row", F.concat("_base", F.lit(mark), (F.col("_k") + F.col("_passed")).cast("string"), "_ext").alias("new_name"))
    return kept.unionByName(placed).select(*[F.col("_row").getField(c).alias(c) for c in df.columns], "new_name")


def first_match(results: DataFrame, paths: DataFrame, name: str = "original") -> DataFrame:
    """Each result with the first path of its base name."""
    first = paths.groupBy("name").agg(F.min("path").alias("path"))
    return results.join(first, results[name] == first["name"], "left").drop("name")


def by_rank(results: DataFrame, paths: DataFrame, name: str = "original", order: str = "seq") -> DataFrame:
    """The k-th result of a base name with its k-th path."""
    r = results.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY {name} ORDER BY {order})"))
    p = paths.withColumn("_k", F.expr("row_number() OVER (PARTITION BY name ORDER BY path)")).withColumnRenamed("name", name)
    return r.join(p, [name, "_k"], "left").drop("_k")


@dataclass(frozen=True)
class Done:
    """What became of one planned row."""

    file: str
    success: bool
    description: str
    error: str | None = None


class Action(Protocol):
    """plan: classified rows to rows with a ``description``; execute: carry out one of them."""

    def plan(self, results: DataFrame) -> DataFrame: ...

    def execute(self, row: Row) -> Done: ...


class TagStore(Protocol):
    """Where the tags of files are kept."""

    def read(self, path: str) -> list[str]: ...

    def write(self, path: str, tags: list[str]) -> None: ...


class AttributeTags:
    """Tags in a file's extended attribute, comma-separated, as desktops on Linux keep them."""

    NAME = "user.xdg.tags"

    def read(self, path: str) -> list[str]:
        try:
            held = os.getxattr(path.removeprefix("file:"), self.NAME).decode("utf-8", "replace")
        except OSError:  # none, or a file system without attributes
            return []
        return [t for t in held.split(",") if t]

    def write(self, path: str, tags: list[str]) -> None:
        path = path.removeprefix("file:")
        if tags:
            os.setxattr(path, self.NAME, ",".join(tags).encode())
        elif self.read(path):
            os.removexattr(path, self.NAME)


STORES: dict[str, type] = {"attributes": AttributeTags}


class Tagger:
    """Plans tags by mode, and writes them to a store; no tags are a cleared file."""

    def __init__(self, store: TagStore | None, mode: str = "add", fields: tuple[str, ...] = ("domain", "category", "doctype")):
        self.store, self.mode, self.fields = store, mode, fields

    def plan(self, results: DataFrame) -> DataFrame:
        """results: with ``path`` and, if the store was read, ``existing_tags``."""
        if "existing_tags" not in results.columns:
            results = results.withColumn("existing_tags", F.array().cast("array<string>"))
        return tag_plan(results, self.mode, self.fields)

    def execute(self, row: Row) -> Done:
        if row["tags_added"] or row["tags_removed"]:
            self.store.write(row["path"], list(row["final_tags"]))
        return Done(row["path"], True, row["description"])


class Renamer:
    """Renames in place to the suggested name, with a suffix where that is taken."""

    def plan(self, results: DataFrame, existing: DataFrame | None = None) -> DataFrame:
        parts = F.split("path", "/")
        rows = results.withColumns({"folder": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), "own": F.element_at(parts, -1)})
        existing = rows.select("folder", F.col("own").alias("name")) if existing is None else existing
        out = rename_all(rows, "folder", "suggested_filename", "path", existing)
        said = F.when(F.col("new_name") == F.col("own"), "already named").otherwise(F.concat(F.lit("rename to "), F.col("new_name")))
        return out.withColumn("description", said)

    def execute(self, row: Row) -> Done:
        source = row["path"].removeprefix("file:")
        target = os.path.join(os.path.dirname(source), row["new_name"])
        if source == target:
            return Done(row["path"], True, "already named")
        if os.path.exists(target):
            raise FileExistsError(target)
        os.rename(source, target)
        return Done(row["path"], True, row["description"])


ACTIONS: dict[str, type] = {"tag": Tagger, "rename": Renamer}


def register(name: str, action: type) -> None:
    """Make an action known by name."""
    ACTIONS[name.lower()] = action


def one(row: Row, action: Action, dry_run: bool = False) -> Done:
    """A planned row, carried out; a dry run only says what would be done.  A failure is what became of it."""
    try:
        return Done(row["path"], True, row["description"]) if dry_run else action.execute(row)
    except Exception as e:
        return Done(row["path"], False, row["description"], f"{type(e).__name__}: {e}")


def moved(row: Row) -> Row:
    """The row of a file under the name that it has been given."""
    folder, slash, _ = row["path"].rpartition("/")
    return Row(**(row.asDict(False) | {"path": f"{folder}{slash}{row['new_name']}"}))


def carry_out(plan: DataFrame, action: Action, dry_run: bool = False) -> Iterator[Done]:
    """Each row of a plan, carried out as it comes.  A failure ends nothing."""
    for row in plan.toLocalIterator():
        yield one(row, action, dry_run)


def totals(results: int, failed: int, action_errors: int) -> int:
    """0, 1 or 2: of ``results`` documents none, some or all failed, in classification or in the action."""
    lost = failed + action_errors
    return 0 if not lost else (1 if lost < results else 2)
