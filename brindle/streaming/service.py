"""The index as a service: state, request loop, and a feed of file events."""

from __future__ import annotations

import logging
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.model import DECLARATIONS, FILES
from brindle.operators import extract, maintain, stats
from brindle.plans import search
from brindle.sources import shared, snapshot, tree, tree_stream
from brindle.sources.log import Log
from brindle.sources.shared import settled
from brindle.streaming import protocol

#: So many single files are kept beside the index before they are merged into it.
MERGE = 128


class Index:
    """The declarations and files of one project: a log in the shared or the snapshot's folder, and beside it the few files that were refreshed singly since.

    ``rows_key`` names the result list and the count in responses, ``query_timeout`` is in seconds.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        dirs: list[str] | None = None,
        cache: bool = True,
        cache_dir: str | None = None,
        ignore_name: str = ".declarations-ignore",
        extensions: str | None = None,
        rows_key: str = "declarations",
        query_timeout: float | None = None,
        strict_compat: bool = False,
    ):
        self.spark, self.root, self.dirs, self.cache = spark, os.path.abspath(root), dirs or [], cache
        self.cache_dir = cache_dir or os.path.join(self.root, ".cache", "declarations")
        self.ignore_name, self.options = ignore_name, {"extensions": extensions} if extensions else {}
        self.rows_key, self.query_timeout, self.strict_compat = rows_key, query_timeout, strict_compat
        self.ready, self.dirty, self.seconds = False, False, 0.0
        self.folder = self.cache_dir if cache else None
        self.log: Log | None = None
        self.base = (spark.createDataFrame([], DECLARATIONS), spark.createDataFrame([], FILES))
        self.delta: dict[str, tuple[int | None, list]] = {}
        self.saved: str | None = None
        self.declarations, self.records = self.base
        self.slow: list[dict] = []
        self._counted: tuple[DataFrame, int] | None = None
        self._files, self._unsure, self._held = 0, set(), False
        self._logged, self._memory = self.base, []

    @property
    def n_declarations(self) -> int:
        """Counted once for each state of the index, not for each request."""
        if self._counted is None or self._counted[0] is not self.declarations:
            self._counted = (self.declarations, self.declarations.count())
        return self._counted[1]

    @property
    def n_files(self) -> int:
        """Files present when they were last looked at; whether singly refreshed ones are new is asked of the records when it matters."""
        if self._unsure:
            logged = self._logged[1]
            self._files += len(self._unsure) - logged.where(F.col("path").isin(sorted(self._unsure))).count()
            self._unsure = set()
        return self._files

    def _present(self, content: bool) -> DataFrame:
        return tree.read_tree(self.spark, self.root, self.dirs, tree.load_ignore(self.root, self.ignore_name), content, **self.options)

    def _open(self, log: Log) -> None:
        """Search ``log`` from now on; its base is kept in memory."""
        old, self.log = self.base, log
        self.base = tuple(t.cache() for t in log.base())
        self._view()
        for t in old:
            t.unpersist()

    def _view(self, logged: bool = True) -> None:
        """``logged``: the log has changed, and not only the files beside it."""
        if logged:
            old, self._memory = self._memory, []
            self._logged = self.log.merged(*self.base, held=self._memory)
            for t in old:
                t.unpersist()
        self.declarations, self.records = snapshot.composed(*self._logged, self.delta)

    def _flush(self) -> None:
        """Singly refreshed files become a delta of the log."""
        if self.delta:
            n, rows = self.n_files, [r for _, found in self.delta.values() for r in found]
            self.log.append(self.spark.createDataFrame([(p, ns) for p, (ns, _) in self.delta.items()], FILES), self.spark.createDataFrame(rows, DECLARATIONS))
            self.delta, self._files = {}, n

    def _append(self, stamps: DataFrame, fresh: DataFrame) -> None:
        """Only what has changed is written; buckets in which much has changed are folded."""
        self._flush()
        self.log.append(stamps, fresh.withColumn("ord", F.col("ord") + self.log.state.top + 1))
        self._settle()

    def _settle(self) -> None:
        self._open(self.log) if not self._held and self.log.tidy() else self._view()
        self.dirty = True

    @contextmanager
    def held(self):
        """No folding inside, so that the tables from before stay readable."""
        self._held = True
        try:
            yield
        finally:
            self._held = False
        if self.log.due():
            self._settle()

    def force(self) -> None:
        """Forget the snapshot and build anew."""
        if self.cache:
            snapshot.delete(self.spark, self.cache_dir)
        self.build()

    def _read(self, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Declarations and records of files that can be read."""
        parsed = settled(extract.parse_sources(tree.read_files(self.spark, self.root, paths)))
        good = parsed.where("error is null").select(F.col("file").alias("path"), "mtime_ns")
        return extract.declarations_of(parsed, settle=False), good

    def build(self) -> None:
        """Scan, extract and replace everything. A file that cannot be read has no record and is tried again by the next refresh."""
        began = time.monotonic()
        if self.folder is None:
            self.folder = f"{shared.shared_base(self.spark)}/brindle-index-{uuid.uuid4().hex}"
        with shared.scratch():
            parsed = settled(extract.parse_sources(self._present(True)))
            records = parsed.where("error is null").select(F.col("file").alias("path"), "mtime_ns").dropDuplicates(["path"])
            self.delta, self._unsure = {}, set()
            self._open(Log.create(extract.declarations_of(parsed, settle=False), records, self.folder))
            self._files = parsed.count()
            self.slow = [r.asDict() for r in stats.slowest(parsed.select(F.col("file").alias("path"), "seconds")).collect()]
        if not self.cache:
            self.log.commit()
        self.ready, self.dirty, self.saved, self.seconds = True, True, None, time.monotonic() - began

    def refresh(self) -> None:
        """Only removed, changed and new files; a full build if nothing is recorded."""
        if self.log is None or not self.records.head(1):
            self.build()
            return
        with shared.scratch():
            present = settled(self._present(False).select("path", "mtime_ns").dropDuplicates(["path"]))
            n = present.count()
            found = maintain.touched(self.records, present, self._read)
            if found:
                self._append(*found)
            self._files, self._unsure, self.ready = n, set(), True

    def _relative(self, path: str) -> str:
        return os.path.relpath(os.path.join(self.root, path), self.root).replace(os.sep, "/")

    def refresh_file(self, path: str) -> bool:
        """One file, by path from the root or absolute: read again, or forgotten if it is gone. Whether it was read.

        Nothing is written and no job runs: the file goes into the delta beside the log, which becomes a delta of the log when it holds ``MERGE`` files.
        """
        if not self.ready:
            return False
        rel = self._relative(path)
        full, found, stamp = os.path.join(self.root, rel), [], None
        top = max([self.log.state.top, *(r[-1] for _, rows in self.delta.values() for r in rows)])
        if os.path.isfile(full):
            if rel not in self.delta:
                self._unsure.add(rel)
            elif self.delta[rel][0] is None:
                self._files += 1
            try:
                with open(full, "rb") as f:
                    found = [(name, kind, rel, line, top + 1 + i) for i, (name, kind, line, _, _) in enumerate(extract.scan(f.read()))]
                stamp = tree.mtime_ns(full)
            except (OSError, RecursionError) as e:
                tree.log.warning("%s cannot be read: %s", rel, e)
        self.delta[rel] = (stamp, found)
        self.dirty = True
        if len(self.delta) >= MERGE:
            self._flush()
            self._settle()
        else:
            self._view(logged=False)
        return stamp is not None

    def refresh_files(self, paths: DataFrame) -> None:
        """Any number of files ``path`` at once, in one pass: read again where they are, forgotten where they are gone. Only they are written."""
        if not self.ready:
            return
        root = self.root

        def stamp(batches):
            import pandas as pd

            for pdf in batches:
                rel = [os.path.relpath(os.path.join(root, p), root).replace(os.sep, "/") for p in pdf["path"]]
                ns = [tree.mtime_ns(os.path.join(root, p)) if os.path.isfile(os.path.join(root, p)) else None for p in rel]
                yield pd.DataFrame({"path": pd.Series(rel, dtype=str), "mtime_ns": pd.Series(ns, dtype="Int64")})

        with shared.scratch():
            stamps = settled(paths.select("path").mapInPandas(stamp, FILES).dropDuplicates(["path"]))
            there = stamps.where("mtime_ns is not null")
            n = self.n_files + there.join(self.records.select("path"), "path", "left_anti").count()
            fresh, parsed = self._read(there)
            good = parsed.select("path", F.col("mtime_ns").alias("good_ns"))
            self._append(stamps.join(good, "path", "left").select("path", F.col("good_ns").alias("mtime_ns")), fresh)
            self._files = n

    def prune(self) -> int:
        """Forget files that no longer exist; how many."""
        root = self.root

        def gone(batches):
            for pdf in batches:
                yield pdf[[not os.path.exists(os.path.join(root, p)) for p in pdf["path"]]]

        with shared.scratch():
            lost = settled(self.records.mapInPandas(gone, FILES))
            n = lost.count()
            if n:
                self._append(lost.select("path", F.lit(None).cast("long").alias("mtime_ns")), self.spark.createDataFrame([], DECLARATIONS))
                self._files, self._unsure = self.records.count(), set()
        return n

    def save(self) -> None:
        """Move the manifest: the tables are there already."""
        self.saved = self.log.commit(self.delta)
        self.dirty = False

    def load(self) -> None:
        log = Log.open(self.spark, self.cache_dir)
        self.delta = log.singles()
        self._open(log)
        self._files, self._unsure = self.declarations.select("file").distinct().count(), set()
        self.saved, self.dirty, self.ready = log.state.version, False, True

    def start(self) -> None:
        """From the snapshot if there is one and it can be read, pruned; else a build."""
        if self.cache and snapshot.exists(self.spark, self.cache_dir):
            try:
                self.load()
                if self.prune():
                    self.save()
                return
            except Exception as e:  # noqa: BLE001 - any unreadable snapshot is rebuilt
                tree.log.warning("snapshot not used: %s", e)
                self.delta = {}
        self.build()
        if self.cache:
            self.save()

    def search(self, text: str, limit: int = 200) -> list[dict]:
        if not self.ready:
            return []
        return within(self.spark, self.query_timeout, lambda: [r.asDict() for r in search(self.declarations, text, limit).collect()])

    def slowest(self) -> list[dict]:
        """Of the last build."""
        return self.slow


def within(spark: SparkSession, seconds: float | None, call: Callable):
    """The result of ``call``; its Spark jobs are cancelled when the time is over."""
    if not seconds:
        return call()
    sc, group, done, late = spark.sparkContext, f"request-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            late.set()
            sc.cancelJobGroup(group)
            wait = 0.1

    sc.setJobGroup(group, "request", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        out = call()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds:g} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeoutError(f"no answer within {seconds:g} s")
    return out


def status(index: Index, rid: int) -> str:
    return protocol.dump(**{"id": rid, "status": "ready" if index.ready else "building", "files": index.n_files, index.rows_key: index.n_declarations})


def handle(index: Index, r: protocol.Request) -> str:
    """One response. A single-file refresh is acknowledged even if the file could not be read; a forced rebuild drops the snapshot in any case."""
    if r.method == "query":
        return protocol.dump(**{"id": r.id, index.rows_key: index.search(r.pattern, r.limit)})
    if r.method == "status":
        return status(index, r.id)
    if r.method == "rebuild":
        index.refresh()
        return protocol.dump(id=r.id, status="rebuilt")
    if r.method == "forceRebuild":
        index.force()
        return protocol.dump(id=r.id, status="rebuilt")
    if r.method == "rebuildFile":
        if not r.file:
            return protocol.dump(id=r.id, error="no file given")
        index.refresh_file(r.file)
        return protocol.dump(id=r.id, status="rebuilt")
    if r.method == "shutdown":
        return protocol.dump(id=r.id, status="shutdown")
    return protocol.dump(id=r.id, error="unknown method")


def answer(index: Index, r: protocol.Request) -> str:
    """``handle``, but whatever fails or takes too long is answered with an error, and the loop goes on."""
    try:
        return handle(index, r)
    except Exception as e:  # noqa: BLE001 - one request must not end the service
        tree.log.warning("request %s failed: %s", r.id, e, exc_info=tree.log.isEnabledFor(logging.DEBUG))
        return protocol.dump(id=r.id, error=(str(e) or type(e).__name__).splitlines()[0])


def serve(index: Index, lines: Iterable[str]) -> Iterator[str]:
    """Responses in order, until a shutdown or the end; what changed is saved after the response has gone out."""
    for line in lines:
        line = line.removesuffix("\n").removesuffix("\r")
        if not line:
            continue
        r = protocol.parse_request(line, index.strict_compat)
        if r is None:
            yield protocol.dump(id=0, error="bad JSON")
            continue
        yield answer(index, r)
        if index.cache and index.dirty:
            index.save()
        if r.method == "shutdown":
            return


def newest_events(events: DataFrame) -> DataFrame:
    """Of a batch of file events ``path, at``, the newest for each path."""
    return events.groupBy("path").agg(F.max("at").alias("at"))


def follow(index: Index, events_dir: str, checkpoint: str) -> None:
    """A feed of JSON lines ``{"path","at"}``: each micro-batch refreshes every named file once, all in one pass."""
    source = index.spark.readStream.schema("path string, at long").json(events_dir)

    def apply(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            index.refresh_files(newest_events(batch))
            if index.cache:
                index.save()

    source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def watch(index: Index, state: str, checkpoint: str) -> None:
    """The tree itself as the feed: each trigger refreshes the files that have changed, appeared or gone since the last one. ``state`` is a shared folder."""
    ignored = tree.load_ignore(index.root, index.ignore_name)
    options = {"extensions": ";".join(index.options["extensions"].split(";"))} if index.options else {}
    source = tree_stream.changes(index.spark, index.root, state, index.dirs, ignored, **options)

    def apply(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            index.refresh_files(batch.select("path"))
            if index.cache:
                index.save()

    source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
