"""``spark.read.format("source_tree")``: the sources under one or more roots.

Options: ``root``; ``dirs`` (``;``-separated, relative to the root, none for the root itself); ``extensions``
(``;``-separated, the usual C and C++ ones by default); ``ignore`` (text of an ignore file); ``ignore_from`` (``root`` or ``scan``: which
folder the rules' paths are relative to); ``content`` (``false`` lists only); ``batch`` (entries of a folder that make one more partition, up to
``SHARES`` of them); ``fan`` (folders that are handed to tasks, which list what is below them). The driver opens what lies above and counts entries; names of
files are listed by tasks only, each of which takes its share of a folder by the names' CRC.

Names that begin with a dot or an underscore count, times are exact to the nanosecond, links to folders are not followed, and folders that
cannot be read are passed over; a missing root gives no rows. Overlapping folders give their files once for each.
"""

from __future__ import annotations

import logging
import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.model import EXTENSIONS, SOURCES
from brindle.operators.ignore import normalised, parse_rules
from brindle.sources.shared import settled

log = logging.getLogger("brindle")


def file_extension(name: str) -> str:
    """'' where there is no dot after the first character."""
    dot = name.rfind(".")
    return name[dot + 1 :] if dot > 0 else ""


def mtime_ns(path: str) -> int:
    try:
        return os.stat(path).st_mtime_ns
    except OSError:
        return -1


def list_tree(root: str, extensions: tuple[str, ...] = EXTENSIONS, ignore: str = "", base: str | None = None, deep: bool = True, share: tuple[int, int] = (0, 1)) -> list[str]:
    """Absolute paths of the files under ``root`` (``deep``) or in it that qualify, of which ``share`` takes one part of so many. Rules apply to paths relative to ``base``."""
    if not os.path.isdir(root):
        log.warning("no folder %s", root)
        return []
    rules = parse_rules(ignore)
    exact, prefixes = {r.pattern for r in rules if not r.is_glob}, tuple(r.pattern for r in rules if r.is_glob)
    (own, of), out = share, []
    left = [root]
    while left:
        folder, names, subs = left.pop(), [], []
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    if of > 1 and zlib.crc32(os.fsencode(e.name)) % of != own:
                        continue
                    if e.is_dir(follow_symlinks=False):
                        subs.append(e.path)
                    elif file_extension(e.name) in extensions and e.is_file():
                        names.append(e.name)
        except OSError:
            log.warning("folder %s cannot be read", folder)
        if deep:
            left += sorted(subs, reverse=True)
        beside = os.path.relpath(folder, base or root)
        for name in sorted(names):
            rel = normalised(name if beside == "." else f"{beside}/{name}")
            if rel not in exact and not rel.startswith(prefixes):
                out.append(os.path.join(folder, name))
    return out


def relative(paths: Iterable[str], root: str) -> Iterator[str]:
    """The paths from ``root``, with slashes; the folder of the file before is remembered."""
    last, beside = None, ""
    for path in paths:
        folder, name = os.path.split(path)
        if folder != last:
            last, rel = folder, os.path.relpath(folder, root).replace(os.sep, "/")
            beside = "" if rel == "." else f"{rel}/"
        yield beside + name


def scan_roots(root: str, dirs: list[str]) -> list[str]:
    return [os.path.join(root, d) for d in dirs] if dirs else [root]


#: The most tasks that list one folder, each of them whole, and the files and bytes that are handed on at once.
SHARES, FILES_AT_ONCE, BYTES_AT_ONCE = 64, 1024, 16 << 20


class Files(InputPartition):
    """A folder whose files the task lists itself: all below it, or in it a share of them."""

    def __init__(self, root: str = "", folder: str | None = None, deep: bool = True, share: int = 0, of: int = 1):
        self.root, self.folder, self.deep, self.share, self.of = root, folder, deep, share, of


def top_folders(root: str, fan: int) -> tuple[list[tuple[str, int]], list[str]]:
    """``(folders opened here with their number of entries, folders left to tasks)``: level by level, until there are ``fan`` to hand out."""
    opened, left = [], [root] if os.path.isdir(root) else []
    while left and len(left) < fan:
        folder, n, subs = left.pop(0), 0, []
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    n += 1
                    if e.is_dir(follow_symlinks=False):
                        subs.append(e.path)
        except OSError:
            log.warning("folder %s cannot be read", folder)
        opened.append((folder, n))
        left += sorted(subs)
    return opened, left


def with_contents(files: Iterable[tuple[str, int, str]], content: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of ``SOURCES`` for ``(path, mtime_ns, full path)``; a file that cannot be read has null content."""
    rows: tuple[list, list, list] = ([], [], [])
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "mtime_ns", "content"])

    for path, ns, full in files:
        data = None
        if content:
            try:
                with open(full, "rb", buffering=0) as f:
                    data = f.read()
            except OSError:
                data = None
        for column, value in zip(rows, (path, ns, data), strict=True):
            column.append(value)
        size += len(data or b"")
        if len(rows[0]) >= FILES_AT_ONCE or size >= BYTES_AT_ONCE:
            yield batch()
            rows, size = ([], [], []), 0
    if rows[0]:
        yield batch()


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["root"])
        self.dirs = [d for d in options.get("dirs", "").split(";") if d]
        self.extensions = tuple(e for e in options.get("extensions", ";".join(EXTENSIONS)).split(";") if e)
        self.ignore, self.per_root = options.get("ignore", ""), options.get("ignore_from", "root") == "root"
        self.content = options.get("content", "true").lower() == "true"
        self.batch, self.fan = int(options.get("batch", "4096")), int(options.get("fan", "256"))

    def partitions(self):
        out = []
        for root in scan_roots(self.root, self.dirs):
            if not os.path.isdir(root):
                log.warning("no folder %s", root)
            opened, left = top_folders(root, self.fan)
            for folder, n in opened:
                of = max(1, min(SHARES, -(-n // self.batch)))
                out += [Files(root, folder, False, share, of) for share in range(of)]
            out += [Files(root, folder) for folder in left]
        return out or [Files()]

    def read(self, partition):
        if partition.folder is None:
            return iter(())
        found = list_tree(partition.folder, self.extensions, self.ignore, self.root if self.per_root else partition.root, partition.deep, (partition.share, partition.of))
        return with_contents(((rel, mtime_ns(path), path) for rel, path in zip(relative(found, self.root), found, strict=True)), self.content)


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SOURCES

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, dirs: list[str] | None = None, ignore: str = "", content: bool = True, **options: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(root=root, dirs=";".join(dirs or []), ignore=ignore, content=str(content).lower(), **options).load()


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """Content of the listed files, read on the executors; a file that cannot be read has null content."""

    def body(batches):
        for b in batches:
            paths, times = b.column("path").to_pylist(), b.column("mtime_ns").to_pylist()
            yield from with_contents((p, ns, os.path.join(root, p)) for p, ns in zip(paths, times, strict=True))

    return paths.select("path", "mtime_ns").mapInArrow(body, SOURCES)


#: Entries that a task looks at before it hands folders on, and files that a task reads.
LOOKS, READS = 4096, 4096


def spread_tree(spark: SparkSession, root: str, dirs: list[str] | None = None, ignore: str = "", content: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """What ``read_tree`` gives, for trees of any shape: listed by rounds of tasks, read in even shares.

    A task goes through folders until it has seen ``LOOKS`` entries; folders that are left go to the next round, in which they are dealt anew. Times and contents
    are read by as many tasks as there are ``READS`` files, even if all lie in one folder. Folders and names are written tables; the driver knows their number only.
    """
    root = os.path.abspath(root)
    rules = parse_rules(ignore)
    exact, prefixes = {r.pattern for r in rules if not r.is_glob}, tuple(r.pattern for r in rules if r.is_glob)

    def look(batches):
        seen = 0
        for b in batches:
            left, files = b.column("path").to_pylist(), []
            while left and seen < LOOKS:
                folder = left.pop()
                beside = os.path.relpath(folder, root).replace(os.sep, "/")
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            seen += 1
                            if e.is_dir(follow_symlinks=False):
                                left.append(e.path)
                            elif file_extension(e.name) in extensions and e.is_file():
                                rel = e.name if beside == "." else f"{beside}/{e.name}"
                                ruled = normalised(rel)
                                if ruled not in exact and not ruled.startswith(prefixes):
                                    files.append(rel)
                except OSError:
                    log.warning("folder %s cannot be read", folder)
            yield pa.RecordBatch.from_arrays([pa.array(left + files, pa.string()), pa.array([True] * len(left) + [False] * len(files), pa.bool_())], ["path", "open"])

    found, folders = [], [f for f in scan_roots(root, dirs or []) if os.path.isdir(f)]
    front = spark.createDataFrame([(f,) for f in folders], "path string")
    n = len(folders)
    while n:
        seen = settled(front.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(look, "path string, open boolean"))
        found.append(seen.where("not open").select("path"))
        front = seen.where("open").select("path")
        n = front.count()
    names = found[0] if found else front
    for more in found[1:]:
        names = names.unionByName(more)
    names = names.repartition(max(1, -(-names.count() // READS)))

    def stamp(batches):
        for b in batches:
            times = [mtime_ns(os.path.join(root, p)) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(times, pa.int64())], ["path", "mtime_ns"])

    stamped = names.mapInArrow(stamp, "path string, mtime_ns long")
    return read_files(spark, root, stamped) if content else stamped.withColumn("content", F.lit(None).cast("binary"))


def load_ignore(root: str, name: str = ".declarations-ignore") -> str:
    """Text of the ignore file of a project, '' if there is none. The name is a parameter: other tools' files work as they are."""
    try:
        with open(os.path.join(root, name), encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except OSError:
        return ""
