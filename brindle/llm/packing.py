"""Best-fit-decreasing packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, saved, slices
from brindle.llm.tokens import ByteBpe


class SegmentTree:
    """Which remaining capacities have an open bin; finds the tightest that fits in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaf = 1
        while self.leaf <= capacity:
            self.leaf *= 2
        self.any = bytearray(2 * self.leaf)

    def set(self, capacity: int, present: bool) -> None:
        i = capacity + self.leaf
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int:
        """Least capacity >= need with an open bin, or -1."""
        i = need + self.leaf
        if i >= 2 * self.leaf:
            return -1
        while not self.any[i]:
            while i > 1 and i & 1:
                i //= 2
            if i <= 1:
                return -1
            i += 1
            if not i & (i - 1):
                return -1
        while i < self.leaf:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaf


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over item sizes with multiplicities.

    Items of one size are alike, and so are open bins of one remaining capacity; runs of consecutive bins are filled
    together. The result is that of taking the items one by one. Returns runs ``(size, first item, first bin, number,
    offset)``: items first..first+number-1 of that size go to bins first bin.. in order, at ``offset``. There are at most
    a few runs for each pair of sizes, however many items.
    """
    tree, open_bins, runs, bins = SegmentTree(capacity), defaultdict(deque), [], 0
    for size in sorted(counts, reverse=True):
        left, item = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                # new bins for the rest: each takes as many as fit, as the bin just opened is the tightest
                per = capacity // size
                n = max(1, left // per)
                per = min(per, left)
                for j in range(per):
                    runs.append((size, item, bins, n, j * size))
                    item += n
                left -= n * per
                open_bins[capacity - per * size].append((bins, n))
                tree.set(capacity - per * size, True)
                bins += n
                continue
            start, n = open_bins[room].popleft()
            take = min(n, left)
            runs.append((size, item, start, take, capacity - room))
            if take < n:
                open_bins[room].appendleft((start + take, n - take))
            elif not open_bins[room]:
                tree.set(room, False)
            open_bins[room - size].append((start, take))
            tree.set(room - size, True)
            left, item = left - take, item + take
    return runs


def tokenized_pieces(docs: DataFrame, tokenizer: str, eos: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32, pid, nth`` : nth is a running number within (pid, length)."""

    def body(batches):
        from pyspark import TaskContext

        pid, seen, bpe = TaskContext.get().partitionId(), defaultdict(int), ByteBpe.shared(tokenizer)
        end = np.array([eos], "<u4").tobytes()
        for b in slices(batches, "t"):
            out = [[], [], [], [], [], []]
            of, ids = b.column("id").to_pylist(), bpe.encode_bytes(b.column("t").to_pylist())
            for doc, raw in zip(of, ids, strict=True):
                raw += end
                total, start, piece = len(raw) // 4, 0, 0
                while start < total:
                    n = (total - start - 1) % capacity + 1
                    for x, v in zip(out, (doc, piece, start, n, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + n)]), seen[n]), strict=True):
                        x.append(v)
                    seen[n] += 1
                    start, piece = start + n, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), pa.array(np.full(len(out[0]), pid, np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "pid"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(body, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, pid long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", eos: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``capacity`` tokens.

    A document is its ids and ``eos``; null text counts as empty (one token). Longer documents are cut into pieces of
    ``capacity``, the first taking the remainder. Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. Ids may repeat or be null: each row is a document. An empty table gives an empty result.

    Best-fit decreasing needs only how many pieces there are of each length, which is at most ``capacity`` numbers:
    these go to the driver, which returns runs of bins. The pieces, written once, are numbered within their length by a
    running number in each task plus a prefix sum over tasks (a sort-merge join, dealt by length and task), and look their run up.
    """
    pieces = saved(tokenized_pieces(docs, tokenizer, eos, capacity, id_col, text_col))
    per_task = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = defaultdict(list)
    for size, item, first, n, offset in best_fit_decreasing(sizes, capacity):
        runs[size].append((item, first, offset))
    lookup = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in runs.items()}
    ref = docs.sparkSession.sparkContext.broadcast(lookup)
    before = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    before = saved(before.select("length", "pid", F.coalesce("base", F.lit(0)).alias("base")))
    # as many rows as lengths and tasks, which grows with the input: never broadcast
    placed = pieces.join(before.hint("merge"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("item"))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length, item = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "item"))
            seq, off = np.empty(len(item), np.int64), np.empty(len(item), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                first_item, first_bin, offset = ref.value[size]
                j = np.searchsorted(first_item, item[at], side="right") - 1
                seq[at], off[at] = first_bin[j] + item[at] - first_item[j], offset[j]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*b.schema.names[:-1], "sequence_id", "offset"])

    out = saved(placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    discard(pieces, before)
    return out


def pack_one_by_one(lengths: list[int], capacity: int) -> int:
    """Number of bins of plain best-fit decreasing: the yardstick of the tests."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect_right(rooms, n - 1)
        room = rooms.pop(i) if i < len(rooms) else capacity
        j = bisect_right(rooms, room - n)
        rooms.insert(j, room - n)
    return len(rooms)
