"""Exact top-k inner products over norm-sorted vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, saved

#: Queries that are sent along at once, vectors in a block, and rotated coordinates in a partial sum.
QUERIES, BLOCK, HEAD = 8192, 8192, 16
#: Doubles hold integers exactly up to here; larger products are taken in Python integers.
EXACT = float(1 << 53)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of integer-valued doubles, as int64; beyond the long range they saturate."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    a, b = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in c]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    return np.array([[clip(sum(x * y for x, y in zip(r, s, strict=True))) for s in b] for r in a], np.int64)


class Search:
    """A slice of queries with what they have so far: the k-th best score is each query's bar."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, bar: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.vec, self.bar, self.k, self.turn = ids, vec, bar, k, turn
        rot = vec @ turn
        self.head = rot[:, :HEAD]
        self.rest = np.sqrt((rot[:, HEAD:] ** 2).sum(axis=1))
        self.norm = np.sqrt((vec * vec).sum(axis=1))

    def block(self, ids: np.ndarray, vec: np.ndarray, tile: int = 512):
        """Candidates of one block, longest first, that reach the bar: ``(query row, candidate row, score)``.

        Bounds: |q||c| for the tile, then the rotated partial sum plus the product of the residual lengths. Both are
        raised by a relative 1e-9 of |q||c|, far above rounding, so nothing within the bar is lost.
        """
        norm = np.sqrt((vec * vec).sum(axis=1))
        rot = vec @ self.turn
        rest = np.sqrt((rot[:, HEAD:] ** 2).sum(axis=1))
        bar = self.bar.copy()
        keep: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.ids]
        for i in range(0, len(vec), tile):
            at = slice(i, i + tile)
            longest = norm[at].max()
            live = np.flatnonzero(self.norm * longest * (1 + 1e-9) + 1e-9 >= bar)
            if not len(live):
                continue
            scale = self.norm[live][:, None] * norm[at][None, :]
            maybe = self.head[live] @ rot[at, :HEAD].T + self.rest[live][:, None] * rest[at][None, :] + scale * 1e-9 + 1e-9 >= bar[live][:, None]
            rows = np.flatnonzero(maybe.any(axis=1))
            if not len(rows):
                continue
            cols = np.flatnonzero(maybe[rows].any(axis=0))
            score = exact_scores(self.vec[live[rows]], vec[at][cols])
            ok = maybe[np.ix_(rows, cols)] & (score >= bar[live[rows]][:, None]) & (self.ids[live[rows]][:, None] != ids[at][cols][None, :])
            for r in np.flatnonzero(ok.any(axis=1)).tolist():
                c = np.flatnonzero(ok[r])
                q = int(live[rows[r]])
                keep[q].append((ids[at][cols[c]], score[r, c]))
                have = np.concatenate([s for _, s in keep[q]])
                if len(have) >= self.k:
                    cid = np.concatenate([x for x, _ in keep[q]])
                    order = np.lexsort((cid, -have))[: self.k]
                    keep[q] = [(cid[order], have[order])]
                    bar[q] = max(bar[q], have[order[-1]])
        for q, parts in enumerate(keep):
            for cid, s in parts:
                yield q, cid, s


def top_inner_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` best other rows.

    Components become floor(``scale`` * x). Ties go to the smaller id. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without an id. Rows that repeat an id, with the same vector or
    another, are candidates each, but never of a query with that id; the query is asked once, with the least of its vectors
    (for each length). Vectors of another length than a query's are no candidates of it.

    All vectors are sorted by descending length and cut into blocks of ``BLOCK``. Queries go in slices of ``QUERIES``,
    a bounded broadcast, over the blocks in waves: first the longest, then eight times as many each time; after each wave
    the slice's k-th best scores are the new bars, and the waves end when no vector left is long enough for any of them. Coordinates are rotated by the eigenvectors of the second-moment
    matrix of all vectors, so that a few carry most of an inner product.
    """
    spark = vectors.sparkSession
    good = F.expr("vec_id is not null and v is not null and size(v) > 0 and coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)

    def integers(batches):
        for b in batches:
            if b.num_rows:
                rows = [np.floor(np.array(x, float) * scale) for x in b.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([len(x) for x in rows], pa.int32()), pa.array([float(np.sqrt((x * x).sum())) for x in rows]), pa.array([x.tobytes() for x in rows], pa.binary())], ["vec_id", "dim", "norm", "vec"])

    whole = saved(plain.mapInArrow(integers, "vec_id long, dim int, norm double, vec binary"))
    # of rows that repeat a query's id the least vector asks
    asking = plain.where(F.col("vec_id") % every == 0).groupBy("vec_id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    asking = saved(asking.mapInArrow(integers, "vec_id long, dim int, norm double, vec binary"))
    out = None
    for dim in [r["dim"] for r in whole.select("dim").distinct().orderBy("dim").collect()]:
        found = _one_length(spark, whole.where(F.col("dim") == dim), asking.where(F.col("dim") == dim), dim, k)
        out = found if out is None else out if found is None else out.unionByName(found)
    discard(whole, asking)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _one_length(spark, table: DataFrame, asking: DataFrame, dim: int, k: int) -> DataFrame | None:
    def moments(batches):
        m = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("vec").to_pylist()), float).reshape(-1, dim)
                big = max(1.0, float(np.abs(x).max()))
                m += (x / big).T @ (x / big)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(m.ravel())], ["cell", "s"])

    m = np.zeros(dim * dim)
    for r in table.select("vec").mapInArrow(moments, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        m[r["cell"]] = r["s"]
    turn = np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1]
    n = table.count()
    blocks = max(1, math.ceil(n / BLOCK))
    ordered = table.repartitionByRange(blocks, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    ordered = saved(ordered.select("vec_id", "vec", "norm", F.spark_partition_id().alias("blk")))
    # the longest vector of each block, one number for BLOCK rows: beyond the last block that can reach a bar nothing is read
    norms = {r["blk"]: r["m"] for r in ordered.groupBy("blk").agg(F.max("norm").alias("m")).collect()}
    blocks = max(norms, default=-1) + 1
    longest = np.zeros(blocks + 1)
    longest[list(norms)] = list(norms.values())
    longest = np.maximum.accumulate(longest[::-1])[::-1]
    slices = max(1, math.ceil(asking.count() * 1.25 / QUERIES))
    results = None
    for s in range(slices):
        rows = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).select("vec_id", "vec").collect()
        if not rows:
            continue
        rows.sort(key=lambda r: r["vec_id"])
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        vec = np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), float).reshape(-1, dim)
        bar = np.full(len(ids), -np.inf)
        length = np.sqrt((vec * vec).sum(axis=1))
        best, first, width = None, 0, 1
        while first < blocks and (length * longest[first] * (1 + 1e-9) + 1e-9 >= bar).any():
            ref = spark.sparkContext.broadcast(Search(ids, vec, bar, turn, k))

            def scan(batches, ref=ref):
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = np.frombuffer(b"".join(b.column("vec").to_pylist()), float).reshape(-1, dim)
                    own = ref.value.ids
                    got = list(ref.value.block(b.column("vec_id").to_numpy(), x))
                    if got:
                        q = np.repeat(own[[g[0] for g in got]], [len(g[1]) for g in got])
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

            wave = ordered.where(F.col("blk").between(first, first + width - 1)).select("vec_id", "vec").mapInArrow(scan, "query_id long, vec_id long, score long")
            every_one = wave if best is None else best.unionByName(wave)
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            last, best = best, saved(every_one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"))
            ref.unpersist()
            if last is not None:
                discard(last)
            first, width = first + width, width * 8
            if first < blocks:
                kth = {r["query_id"]: r["s"] for r in best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}
                bar = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
        results = best if results is None else results.unionByName(best)
    discard(ordered)
    if results is None:
        return None
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return results.select("query_id", F.row_number().over(w).cast("int").alias("rank"), "vec_id", "score")
