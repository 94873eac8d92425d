"""Snapshots: the log of an index, and the JSON form (versions 1 and 2) for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.model import DECLARATIONS, FILES
from brindle.sources.json_snapshot import export_json, import_json, join_parts  # noqa: F401 - the JSON form belongs to the snapshots
from brindle.sources.log import MANIFEST, Log, LogError
from brindle.sources.shared import Store

SnapshotError = LogError


def exists(spark: SparkSession, folder: str) -> bool:
    return Store(spark, folder).is_file(MANIFEST)


def save(folder: str, declarations: DataFrame, records: DataFrame) -> str:
    """Write a new log, then move the manifest: readers see the old or the new state whole. The one before stays until the next save."""
    return Log.create(declarations, records, folder).commit()


def save_delta(spark: SparkSession, folder: str, version: str, delta: dict[str, tuple[int | None, list]]) -> None:
    """Files that were read or lost singly since ``version`` was written, ``{path: (time or None, rows)}``: a part of the manifest, replaced as a whole."""
    log = Log.open(spark, folder)
    if log.state.version != version:
        raise SnapshotError(f"{folder} holds another version")
    log.commit(delta)


def composed(declarations: DataFrame, records: DataFrame, delta: dict[str, tuple[int | None, list]]) -> tuple[DataFrame, DataFrame]:
    """Both tables with the delta in place of what they had of its files."""
    if not delta:
        return declarations, records
    spark, paths = declarations.sparkSession, list(delta)
    rows = spark.createDataFrame([r for _, found in delta.values() for r in found], DECLARATIONS)
    files = spark.createDataFrame([(p, ns) for p, (ns, _) in delta.items() if ns is not None], FILES)
    return declarations.where(~F.col("file").isin(paths)).unionByName(rows), records.where(~F.col("path").isin(paths)).unionByName(files)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Declarations and files, with all deltas."""
    log = Log.open(spark, folder)
    return composed(*log.merged(*log.base()), log.singles())


def delete(spark: SparkSession, folder: str) -> bool:
    """Whether there was one. The folder goes if nothing else is in it."""
    store = Store(spark, folder)
    if not store.is_file(MANIFEST):
        return False
    store.delete(MANIFEST)
    for name in store.folders():
        store.delete(name)
    store.delete_if_empty()
    return True
