"""Incremental maintenance as joins between the recorded and the present state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import settled


def removed(records: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded paths that are gone."""
    return records.select("path").join(current.select("path"), "path", "left_anti")


def changed(records: DataFrame, current: DataFrame) -> DataFrame:
    """Present files that are new or whose time differs: ``path, mtime_ns``. Repeats in ``current`` stay."""
    known = records.select("path", F.col("mtime_ns").alias("known_ns"))
    return current.join(known, "path", "left").where(~F.col("mtime_ns").eqNullSafe(F.col("known_ns"))).select("path", "mtime_ns")


def evicted(records: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose declarations must go: removed or changed, each once."""
    return removed(records, current).union(changed(records, current).select("path")).distinct()


def without(declarations: DataFrame, paths: DataFrame) -> DataFrame:
    """Declarations of no evicted file. Spark broadcasts the paths while they are small, and shuffles both sides beyond."""
    return declarations.join(paths.select(F.col("path").alias("file")), "file", "left_anti").select(*declarations.columns)


def upserted(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """``records`` with the rows of ``fresh`` in place of those with the same path."""
    new = fresh.select("path", "mtime_ns").dropDuplicates(["path"])
    return records.join(new.select("path"), "path", "left_anti").unionByName(new)


def largest(declarations: DataFrame) -> int:
    """The largest order number in use, -1 if there is none."""
    top = declarations.agg(F.max("ord")).first()[0]
    return -1 if top is None else top


def appended(declarations: DataFrame, fresh: DataFrame, top: int) -> DataFrame:
    """UNION ALL; what is new comes after what was there: its order numbers go on from ``top``."""
    return declarations.unionByName(fresh.withColumn("ord", F.col("ord") + top + 1).select(*declarations.columns))


def states(records: DataFrame, current: DataFrame) -> DataFrame:
    """``path, old_ns, mtime_ns, state`` for every path on either side, ``state`` one of removed, new, changed, same: one join for all that a refresh asks."""
    both = records.select("path", F.col("mtime_ns").alias("old_ns"), F.lit(True).alias("known")).join(current.select("path", "mtime_ns", F.lit(True).alias("here")).dropDuplicates(["path"]), "path", "full")
    state = F.when(F.col("here").isNull(), "removed").when(F.col("known").isNull(), "new").when(F.col("mtime_ns").eqNullSafe(F.col("old_ns")), "same").otherwise("changed")
    return both.select("path", "old_ns", "mtime_ns", state.alias("state"))


@dataclass
class Delta:
    """A refresh: the new tables and what it did."""

    declarations: DataFrame
    records: DataFrame
    n_removed: int
    n_changed: int

    @property
    def dirty(self) -> bool:
        return bool(self.n_removed or self.n_changed)


def apply_delta(declarations: DataFrame, records: DataFrame, current: DataFrame, extract, top: int | None = None) -> Delta:
    """Refresh from the present files. ``extract(paths)`` gives ``(declarations, parsed)`` for files to read; ``top`` is the largest
    order number in use, if it is known.

    Both sides are read once, into the table of states, which is settled; all else reads that. A file that cannot be read loses its
    declarations and keeps its old record, so the next refresh tries it again.
    """
    both = settled(states(records, current))
    n = {r["state"]: r["count"] for r in both.groupBy("state").count().collect()}
    n_gone, n_touched = n.get("removed", 0), n.get("new", 0) + n.get("changed", 0)
    if not n_gone and not n_touched:
        return Delta(declarations, records, 0, 0)
    fresh, parsed = extract(both.where("state in ('new', 'changed')").select("path", "mtime_ns"))
    kept = without(declarations, both.where("state in ('removed', 'changed')").select("path"))
    left = both.where("state in ('same', 'changed')").select("path", F.col("old_ns").alias("mtime_ns"))
    return Delta(appended(kept, fresh, largest(declarations) if top is None else top), upserted(left, parsed), n_gone, n_touched)


def touched(records: DataFrame, current: DataFrame, extract) -> tuple[DataFrame, DataFrame] | None:
    """A refresh from the present files as a delta: ``(stamps, declarations)`` of the files that are gone, changed or new, None if there are none.

    ``extract`` as in ``apply_delta``. A file that cannot be read has no declarations and keeps its old record, so the next refresh tries it again.
    """
    both = settled(states(records, current).where("state <> 'same'"))
    if not both.head(1):
        return None
    fresh, parsed = extract(both.where("state <> 'removed'").select("path", "mtime_ns"))
    good = parsed.select("path", F.col("mtime_ns").alias("good_ns"))
    stamp = F.when(F.col("state") != "removed", F.coalesce("good_ns", "old_ns"))
    return both.join(good, "path", "left").select("path", stamp.alias("mtime_ns")), fresh


def pruned(declarations: DataFrame, records: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(declarations, records, pruned paths) after dropping files that no longer exist."""
    gone = removed(records, present)
    return without(declarations, gone), records.join(gone, "path", "left_anti"), gone


def delta_counts(records: DataFrame, current: DataFrame) -> DataFrame:
    """One row: removed, changed (new ones included), evicted, unchanged."""
    touched = F.col("state").isin("new", "changed")
    return states(records, current).agg(
        F.count_if(F.col("state") == "removed").alias("removed"), F.count_if(touched).alias("changed"), F.count_if(touched | (F.col("state") == "removed")).alias("evicted"), F.count_if(F.col("state") == "same").alias("unchanged")
    )
