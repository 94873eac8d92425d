"""Requests answered as tables: a whole batch in one plan over the versions of the index that its refreshes make."""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.model import DECLARATIONS
from brindle.plans.search import versions_search
from brindle.sources import shared
from brindle.sources.shared import settled
from brindle.streaming import protocol

#: Beyond every request's number.
NEVER = (1 << 62) - 1


def running(rows: DataFrame, order: list[str], value: str | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``value`` (None: the number) of all rows that come before in ``order``.

    Rows are dealt by ranges; each range has its own running sum, and the sums of the ranges before are added, of which there are as many as partitions. The
    result is a written table, as ranges may differ when they are made again.
    """
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    parts = settled(rows.withColumn("__v", amount).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    first, sums = 0, []
    for r in parts.groupBy("__part").agg(F.sum("__v").alias("n")).orderBy("__part").collect():
        sums.append((r["__part"], first))
        first += r["n"] or 0
    ranges = rows.sparkSession.createDataFrame(sums, "__part int, __first long")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("__own", F.coalesce(F.sum("__v").over(w), F.lit(0))).join(F.broadcast(ranges), "__part")
    return settled(out.select(*rows.columns, (F.col("__first") + F.col("__own")).alias("before")))


def numbered(lines: DataFrame, order: list[str], strict_compat: bool = False) -> DataFrame:
    """Parsed requests with ``nth``, their number from 0 in ``order``; empty lines have none."""
    return running(protocol.parse_requests(lines, strict_compat=strict_compat), order).drop("line", *order).withColumnRenamed("before", "nth")


def answered(index, requests: DataFrame) -> DataFrame:
    """``(nth, response)`` for requests ``nth, id, method, pattern, limit, file, bad``: what the loop would answer to them one by one in order, up to a shutdown.

    Refreshes within a batch see the files as they are now, so each file changes once at most, with its own ``rebuildFile`` or with the first ``rebuild``: the
    files are refreshed together, and a row of the index is there from or until the turn at which a request changed its file. All queries are one batch of searches over
    rows with such an interval, one search for each pattern and turn; counters are running sums. Only a forced rebuild, which numbers everything anew, divides a batch.
    """
    stop = requests.where("method = 'shutdown' and not bad").agg(F.min("nth")).first()[0]
    if stop is not None:
        requests = requests.where(F.col("nth") <= stop)
    cuts = [r["nth"] for r in requests.where("method = 'forceRebuild' and not bad").select("nth").orderBy("nth").collect()]
    found, begin = [], -1
    for cut in [*cuts, NEVER]:
        part = requests.where(F.col("nth").between(begin, cut - 1))
        if begin >= 0:
            index.force()
        found.append(_segment(index, part))
        begin = cut
    return reduce(DataFrame.unionByName, found)


def _segment(index, requests: DataFrame) -> DataFrame:
    """The responses to requests between two forced rebuilds; a written table."""
    root = index.root

    @F.arrow_udf("string")
    def relative(paths: pa.Array) -> pa.Array:
        return pa.array([os.path.relpath(os.path.join(root, p), root).replace(os.sep, "/") for p in paths.to_pylist()], pa.string())

    good = requests.where("not bad")
    named = good.where("method = 'rebuildFile' and file <> ''").select("nth", relative("file").alias("path")).groupBy("path").agg(F.min("nth").alias("own"))
    named = settled(named)
    whole = good.where("method = 'rebuild'").agg(F.min("nth")).first()[0]
    rebuilt = NEVER if whole is None else whole
    old, known = index.declarations, index.records
    n_files, n_rows, since = index.n_files, index.n_declarations, index.log.state.last
    with index.held():
        if named.head(1):
            index.refresh_files(named.select("path"))
        n_named = index.n_files
        if whole is not None:
            index.refresh()
        files = settled(index.log.touched_since(since).join(named, "path", "left").select("path", F.least(F.coalesce("own", F.lit(NEVER)), F.lit(rebuilt)).alias("at"), "mtime_ns").where(F.col("at") < NEVER))
        asked = good.where("method = 'query'").select("nth", "pattern", F.col("limit").cast("int").alias("qlimit"))
        turns, timed = _turns(files.select(F.col("at").alias("nth")).distinct(), asked)
        times = turns.count() + 1
        at = files.join(turns, "at").select(F.col("path").alias("file"), "at", "turn")
        before = old.join(at, "file", "left").select(*DECLARATIONS.names, F.lit(0).cast("long").alias("since"), F.coalesce("turn", F.lit(times)).alias("until"))
        after = index.declarations.join(at, "file").select(*DECLARATIONS.names, F.col("turn").alias("since"), F.lit(times).cast("long").alias("until"), "at")
        found = versions_search(before.unionByName(after.drop("at")), timed.withColumnRenamed("turn", "at"), times).withColumnRenamed("at", "turn")
        lists = timed.join(found, ["pattern", "turn"]).select("nth", F.slice("rows", F.lit(1), F.col("qlimit")).alias("rows"))
        # what each change adds to the counters, in the order of the requests
        grown = after.groupBy("file", "at").agg(F.count("*").alias("n")).select(F.col("at").alias("nth"), "n")
        lost = old.join(at, "file").groupBy("file", "at").agg((-F.count("*")).alias("n")).select(F.col("at").alias("nth"), "n")
        new = files.where(F.col("mtime_ns").isNotNull() & (F.col("at") < rebuilt)).join(known.select("path"), "path", "left_anti").select(F.col("at").alias("nth"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("f"))
        events = grown.unionByName(lost).withColumn("f", F.lit(0).cast("long")).unionByName(new).groupBy("nth").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).withColumn("change", F.lit(0))
        marks = events.unionByName(good.where("method = 'status'").select("nth", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("f"), F.lit(1).alias("change")))
        rows_at = running(marks, ["nth", "change"], "n").where("change = 1").select("nth", (F.col("before") + n_rows).alias("n_rows"))
        files_at = running(marks, ["nth", "change"], "f").where("change = 1").select("nth", F.when(F.col("nth") < rebuilt, F.col("before") + n_files).otherwise(index.n_files if whole is not None else n_named).alias("n_files"))
        told = requests.join(lists, "nth", "left").join(rows_at, "nth", "left").join(files_at, "nth", "left")
        return settled(told.select("nth", _response(index).alias("response")))


def _turns(changes: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests ``nth`` that change files, numbered from 1, ``(at, turn)``; and queries with the ``turn`` of the last one before them, 0 for none."""
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("pattern", "string"), ("qlimit", "int"))]
    marks = changes.select("nth", *blank, F.lit(1).cast("long").alias("v"), F.lit(0).alias("change"))
    marks = running(marks.unionByName(asked.select("nth", "pattern", "qlimit", F.lit(0).cast("long").alias("v"), F.lit(1).alias("change"))), ["nth", "change"], "v")
    return marks.where("change = 0").select(F.col("nth").alias("at"), (F.col("before") + 1).alias("turn")), marks.where("change = 1").select("nth", "pattern", "qlimit", F.col("before").alias("turn"))


def _response(index) -> Column:
    rid = F.col("id")
    rows = F.coalesce("rows", F.expr("cast(array() as array<struct<name:string,kind:string,file:string,line:int,score:int>>)"))
    return (
        F.when(F.col("bad"), protocol.error_response(F.lit(0).cast("long"), F.lit("bad JSON")))
        .when(F.col("method") == "query", protocol.query_response(rid, rows, index.rows_key))
        .when(F.col("method") == "status", protocol.status_response(rid, F.lit(index.ready), F.col("n_files"), F.col("n_rows"), index.rows_key))
        .when((F.col("method") == "rebuildFile") & (F.col("file") == ""), protocol.error_response(rid, F.lit("no file given")))
        .when(F.col("method").isin("rebuild", "forceRebuild", "rebuildFile"), protocol.ack_response(rid, F.lit("rebuilt")))
        .when(F.col("method") == "shutdown", protocol.ack_response(rid, F.lit("shutdown")))
        .otherwise(protocol.error_response(rid, F.lit("unknown method")))
    )


def replay(index, requests_dir: str, responses_dir: str, checkpoint: str) -> None:
    """Structured Streaming over folders of request lines: each micro-batch is numbered in order of arrival and answered as one table. Responses are written
    per batch, so a repeated batch replaces its own."""
    meta = {"at": "file_modification_time", "path": "file_path", "block": "file_block_start"}
    source = index.spark.readStream.text(requests_dir).select(F.col("value").alias("line"), *[F.col(f"_metadata.{m}").alias(f"__{c}") for c, m in meta.items()])

    def apply(batch: DataFrame, number: int) -> None:
        with shared.scratch():
            lines = batch.withColumn("__row", F.monotonically_increasing_id())
            told = answered(index, numbered(lines, ["__at", "__path", "__block", "__row"], index.strict_compat))
            told.write.mode("overwrite").parquet(os.path.join(responses_dir, f"batch={number}"))
        if index.cache and index.dirty:
            index.save()

    source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
