"""The index on disk as a log: buckets of base rows, small deltas beside them, merged when read and folded in bucket by bucket.

Every folder is written once and never changed; one manifest file names those that count, so readers see a state whole, and what a lost
attempt has left is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.model import DECLARATIONS, FILES
from brindle.sources.shared import Store

#: Buckets by hash of the file, the most deltas that a reader merges, and the share of a bucket's rows (one in so many) at which it is folded.
BUCKETS, DELTAS, SHARE = 16, 16, 8
MANIFEST = "_CURRENT"


class LogError(ValueError):
    """What was found is not the manifest of a log."""


@dataclass
class State:
    """What the manifest holds: for each bucket the version it is in, its rows, the last delta folded into it and rows of later ones; the deltas by number; files that were refreshed singly."""

    version: str
    buckets: int
    base: dict[int, str]
    rows: dict[int, int]
    done: dict[int, int] = field(default_factory=dict)
    waiting: dict[int, int] = field(default_factory=dict)
    deltas: dict[int, str] = field(default_factory=dict)
    last: int = 0
    top: int = -1
    singles: dict[str, list] = field(default_factory=dict)
    garbage: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, text: str) -> State:
        try:
            found = json.loads(text)
            for name in ("base", "rows", "done", "waiting", "deltas"):
                found[name] = {int(k): v for k, v in found[name].items()}
            return cls(**found)
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise LogError(f"no manifest of a log: {e}") from e


class Log:
    """Declarations and records (``path, mtime_ns``) of files in ``folder``. Changes are in memory until ``commit`` moves the manifest."""

    def __init__(self, spark: SparkSession, folder: str, state: State):
        self.spark, self.folder, self.state = spark, folder, state
        self.dropped: list[str] = []

    @classmethod
    def create(cls, declarations: DataFrame, records: DataFrame, folder: str, buckets: int = BUCKETS) -> Log:
        spark = declarations.sparkSession
        old = Store(spark, folder).folders()
        log = cls(spark, folder, State(uuid.uuid4().hex, buckets, {}, {}))
        log._write(declarations, records, set(range(buckets)))
        log.dropped += old
        return log

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Log:
        store = Store(spark, folder)
        if not store.is_file(MANIFEST):
            raise LogError(f"no log in {folder}")
        return cls(spark, folder, State.read(store.read(MANIFEST)))

    def commit(self, singles: dict[str, tuple[int | None, list]] | None = None) -> str:
        """Move the manifest. Folders that it no longer names go with the next commit, so that readers of the state before can end."""
        s, store = self.state, Store(self.spark, self.folder)
        gone, s.garbage = s.garbage, self.dropped
        self.dropped = []
        s.singles = {} if singles is None else {p: list(x) for p, x in singles.items()}
        store.write(MANIFEST, json.dumps(asdict(s)))
        for name in gone:
            store.delete(name)
        return s.version

    def singles(self) -> dict[str, tuple[int | None, list]]:
        return {p: (ns, [tuple(r) for r in rows]) for p, (ns, rows) in self.state.singles.items()}

    def bucket(self, path: str) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.state.buckets)).cast("int").alias("bucket")

    def _write(self, declarations: DataFrame, records: DataFrame, buckets: set[int]) -> None:
        """A new version of some buckets."""
        s, name = self.state, uuid.uuid4().hex
        for table, rows, path, cols in (("declarations", declarations, "file", DECLARATIONS.names), ("files", records, "path", FILES.names)):
            rows = rows.select(*cols, self.bucket(path)).repartition(s.buckets, "bucket")
            rows.write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{table}")
        found = self._version(name, "declarations", buckets).groupBy("bucket").agg(F.count("*").alias("n"), F.max("ord").alias("top")).collect()
        s.top = max([s.top, *(r["top"] for r in found if r["top"] is not None)])
        s.base |= dict.fromkeys(buckets, name)
        s.rows |= dict.fromkeys(buckets, 0) | {r["bucket"]: r["n"] for r in found}
        s.done |= dict.fromkeys(buckets, s.last)
        s.waiting |= dict.fromkeys(buckets, 0)

    def _version(self, name: str, table: str, buckets: set[int]) -> DataFrame:
        schema = (DECLARATIONS if table == "declarations" else FILES).simpleString()[7:-1].replace(":", " ").replace(",", ", ")
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{name}/{table}").where(F.col("bucket").isin(sorted(buckets)))

    def base(self, buckets: set[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """Both base tables, with ``bucket``; one scan for each version that is in use."""
        by: dict[str, set[int]] = {}
        for b, name in self.state.base.items():
            if buckets is None or b in buckets:
                by.setdefault(name, set()).add(b)
        out = []
        for table in ("declarations", "files"):
            parts = [self._version(name, table, own) for name, own in sorted(by.items())]
            rows = parts[0]
            for more in parts[1:]:
                rows = rows.unionByName(more)
            out.append(rows)
        return out[0], out[1]

    def _deltas(self, table: str, columns: str, buckets: set[int] | None) -> DataFrame:
        s = self.state
        rows = self.spark.read.schema(f"{columns}, bucket int, seq int").parquet(*[f"{self.folder}/{d}/{table}" for d in s.deltas.values()])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(sorted(buckets)))
        done = F.array(*[F.lit(s.done.get(b, 0)) for b in range(s.buckets)])
        return rows.where(F.col("seq") > F.get(done, F.col("bucket"))) if any(s.done.values()) else rows

    def merged(self, declarations: DataFrame, records: DataFrame, buckets: set[int] | None = None, held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Base tables with the deltas in place of what they had of the deltas' files; of several deltas with a file the last counts. ``held`` gets the delta's own tables,
        which are small beside the base and are kept in memory for it."""
        if not self.state.deltas:
            return declarations.select(*DECLARATIONS.names), records.select(*FILES.names)
        stamps = self._deltas("stamps", "path string, mtime_ns long", buckets)
        newest = stamps.groupBy("path").agg(F.max(F.struct("seq", "mtime_ns")).alias("n")).select("path", "n.seq", "n.mtime_ns")
        fresh = self._deltas("declarations", "name string, kind string, file string, line int, ord long", buckets)
        fresh = fresh.join(newest.select(F.col("path").alias("file"), "seq"), ["file", "seq"])
        if held is not None:
            newest, fresh = newest.cache(), fresh.cache()
            held += [newest, fresh]
        kept = declarations.join(newest.select(F.col("path").alias("file")), "file", "left_anti")
        left = records.join(newest.select("path"), "path", "left_anti")
        return kept.select(*DECLARATIONS.names).unionByName(fresh.select(*DECLARATIONS.names)), left.select(*FILES.names).unionByName(newest.where("mtime_ns is not null").select(*FILES.names))

    def touched_since(self, seq: int) -> DataFrame:
        """``(path, mtime_ns)`` of the files in deltas after ``seq``, each once."""
        names = [d for k, d in self.state.deltas.items() if k > seq]
        if not names:
            return self.spark.createDataFrame([], FILES)
        rows = self.spark.read.schema("path string, mtime_ns long, seq int").parquet(*[f"{self.folder}/{d}/stamps" for d in names])
        return rows.groupBy("path").agg(F.max(F.struct("seq", "mtime_ns")).alias("n")).select("path", "n.mtime_ns")

    def append(self, stamps: DataFrame, fresh: DataFrame) -> None:
        """A delta: files ``stamps(path, mtime_ns)``, each once, null for those without a record, and all their declarations. Nothing else is written."""
        s = self.state
        s.last += 1
        name = f"d{s.last}-{uuid.uuid4().hex}"
        for table, rows, path, cols in (("stamps", stamps, "path", FILES.names), ("declarations", fresh, "file", DECLARATIONS.names)):
            rows.select(*cols, self.bucket(path), F.lit(s.last).alias("seq")).hint("rebalance").write.parquet(f"{self.folder}/{name}/{table}")
        s.deltas[s.last] = name
        rows = self._one(name, "declarations", "ord long").unionByName(self._one(name, "stamps", "ord long"))
        for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("ord").alias("top")).collect():
            s.waiting[r["bucket"]] = s.waiting.get(r["bucket"], 0) + r["n"]
            s.top = max(s.top, -1 if r["top"] is None else r["top"])

    def _one(self, delta: str, table: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.folder}/{delta}/{table}")

    def due(self, share: int = SHARE) -> set[int]:
        """Buckets whose deltas have grown to one in ``share`` of their rows."""
        s = self.state
        return {b for b, n in s.waiting.items() if n and n * share >= s.rows.get(b, 0)}

    def fold(self, buckets: set[int]) -> None:
        """Rewrite some buckets with their deltas; others are not read. Deltas that no bucket waits for any more go."""
        s = self.state
        self._write(*self.merged(*self.base(buckets), buckets), buckets)
        s.done |= {b: s.last for b in range(s.buckets) if not s.waiting.get(b)}
        old = min(s.done.get(b, 0) for b in range(s.buckets))
        self.dropped += [d for k, d in s.deltas.items() if k <= old]
        s.deltas = {k: d for k, d in s.deltas.items() if k > old}
        named = {*s.base.values(), *s.deltas.values(), *self.dropped}
        self.dropped += [f for f in Store(self.spark, self.folder).folders() if f not in named and f not in s.garbage]

    def unite(self) -> None:
        """One delta in place of all: the last state of each of their files. As much is written as the deltas hold."""
        s = self.state
        stamps = self._deltas("stamps", "path string, mtime_ns long", None)
        newest = stamps.groupBy("path").agg(F.max(F.struct("seq", "mtime_ns")).alias("n")).select("path", "n.seq", "n.mtime_ns")
        fresh = self._deltas("declarations", "name string, kind string, file string, line int, ord long", None).join(newest.select(F.col("path").alias("file"), "seq"), ["file", "seq"])
        before, s.waiting = s.deltas, {}
        self.append(newest, fresh)
        s.deltas = {s.last: s.deltas[s.last]}
        self.dropped += [d for k, d in before.items() if k != s.last]

    def tidy(self) -> bool:
        """Fold what is due, and unite deltas if there are too many; whether the base has changed."""
        due = self.due()
        if due:
            self.fold(due)
        if len(self.state.deltas) > DELTAS:
            self.unite()
        return bool(due)
