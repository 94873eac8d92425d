"""``spark.readStream.format("source_tree_changes")``: the files of a tree that are new, changed or removed since the last trigger.

Options: those of ``source_tree`` that choose files (``root``, ``dirs``, ``extensions``, ``ignore``), and ``state``, a folder that driver and tasks share. An offset is the
digest of a listing; listings are kept under their digests, some for each folder and one that names them, so a trigger that is repeated after a failure
finds both of its ends. Files of a folder are dealt over ``SHARES`` listings by the CRC of their names if there are more than ``LISTED``, which are as many tasks; listings
whose digest is the same are not compared. Rows: ``path, mtime_ns`` (null: removed), ``state`` (new, changed, removed).
The first trigger gives every file as new.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brindle.model import EXTENSIONS
from brindle.sources.tree import list_tree, mtime_ns, relative, scan_roots

EMPTY = ""
CHANGES = "path string, mtime_ns long, state string"


#: Files of one listing, about, and the listings of a folder that has more.
LISTED, SHARES, ALL = 4096, 64, "all"


def share_of(path: str) -> str:
    return str(zlib.crc32(path.encode("utf-8", "surrogateescape")) % SHARES)


def dealt(files: dict[str, int]) -> Iterator[tuple[str, dict[str, int]]]:
    """The files of a folder by shares, or all at once if they are few."""
    if len(files) <= LISTED:
        yield ALL, files
        return
    shares: dict[str, dict[str, int]] = {}
    while files:
        path, ns = files.popitem()
        shares.setdefault(share_of(path), {})[path] = ns
    yield from shares.items()


class Folder(InputPartition):
    """Listings of a folder, or of a share of it, before and after, by digest; '' for none."""

    def __init__(self, before: str, after: str, share: str = ALL):
        self.before, self.after, self.share = before, after, share


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["root"])
        self.dirs = [d for d in options.get("dirs", "").split(";") if d]
        self.extensions = tuple(e for e in options.get("extensions", ";".join(EXTENSIONS)).split(";") if e)
        self.ignore, self.state = options.get("ignore", ""), options["state"].removeprefix("file://")

    def _kept(self, listing: dict) -> str:
        """Digest of a listing, which is written under it: whole or not at all."""
        text = json.dumps(listing, sort_keys=True, separators=(",", ":"))
        digest = hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()
        path = os.path.join(self.state, f"{digest}.json")
        if os.path.exists(path):
            os.utime(path)  # in use again, whatever commit() thinks of older ones
        else:
            os.makedirs(self.state, exist_ok=True)
            beside = f"{path}.{uuid.uuid4().hex}"
            with open(beside, "w", encoding="utf-8", errors="surrogateescape") as f:
                f.write(text)
            os.replace(beside, path)
        return digest

    def _listing(self, digest: str) -> dict:
        if digest == EMPTY:
            return {}
        with open(os.path.join(self.state, f"{digest}.json"), encoding="utf-8", errors="surrogateescape") as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {"listing": EMPTY}

    def latestOffset(self) -> dict:  # noqa: N802
        folders: dict[str, dict[str, int]] = {}
        for root in scan_roots(self.root, self.dirs):
            found = list_tree(root, self.extensions, self.ignore, self.root)
            for path, rel in zip(found, relative(found, self.root), strict=True):
                folders.setdefault(rel.rpartition("/")[0], {})[rel] = mtime_ns(path)
        kept = {}
        while folders:
            name, files = folders.popitem()
            for share, some in dealt(files):
                kept[f"{name}/{share}"] = self._kept(some)
        return {"listing": self._kept(kept) if kept else EMPTY}

    def partitions(self, start: dict, end: dict):
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        out = []
        for f in sorted({n.rpartition("/")[0] for n in (*old, *new)}):
            before, after = ([(s, t[f"{f}/{s}"]) for s in (ALL, *map(str, range(SHARES))) if f"{f}/{s}" in t] for t in (old, new))
            if any(s != ALL for s, _ in (*before, *after)):
                # one side or both are dealt: share by share, of an undealt one its part
                shares = [(s, dict(before).get(s, dict(before).get(ALL, EMPTY)), dict(after).get(s, dict(after).get(ALL, EMPTY))) for s in map(str, range(SHARES))]
                out += [Folder(x, y, s) for s, x, y in shares if x != y]
            elif before != after:
                out.append(Folder(dict(before).get(ALL, EMPTY), dict(after).get(ALL, EMPTY)))
        return out

    def read(self, partition):
        old, new = ({p: ns for p, ns in self._listing(x).items() if partition.share in (ALL, share_of(p))} for x in (partition.before, partition.after))
        for path in sorted({*old, *new}):
            if path not in new:
                yield path, None, "removed"
            elif old.get(path) != new[path]:
                yield path, new[path], "changed" if path in old else "new"

    def commit(self, end: dict) -> None:
        """Listings that are older than the end and not part of it go; a newer one may have been made already."""
        if end["listing"] == EMPTY:
            return
        keep = {end["listing"], *self._listing(end["listing"]).values()}
        upto = os.stat(os.path.join(self.state, f"{end['listing']}.json")).st_mtime_ns
        for e in list(os.scandir(self.state)):
            if e.name.endswith(".json") and e.name.removesuffix(".json") not in keep and e.stat().st_mtime_ns < upto:
                os.remove(e.path)


class TreeChanges(DataSource):
    @classmethod
    def name(cls):
        return "source_tree_changes"

    def schema(self):
        return CHANGES

    def streamReader(self, schema):  # noqa: N802
        return ChangeReader(self.options)


def changes(spark, root: str, state: str, dirs: list[str] | None = None, ignore: str = "", **options: str):
    """The stream of changes of a tree."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("source_tree_changes").options(root=root, state=state, dirs=";".join(dirs or []), ignore=ignore, **options).load()
