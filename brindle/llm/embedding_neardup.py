"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import discard, saved
from brindle.llm.components import connected_components

#: Trees, vectors in a leaf, overlap on either side of a split (in units of unit vectors), rows the trees are fitted on.
TREES, LEAF, MARGIN, FIT_ROWS = 3, 2048, 0.02, 40_000
#: A leaf with more vectors is compared block against block; tiles bound the memory of a comparison.
BLOCK, TILE = 4096, 512
#: Bytes of vectors in a task that refines leaves, and of the sample that it fits a tree on.
PART, SAMPLE = 16 << 20, 64 << 20
#: The size of a group of which the sample holds too little for any split.
UNKNOWN = -1.0


def unit(v: np.ndarray) -> np.ndarray:
    """Rows in double precision with length 1; scaled first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_tree(sample: np.ndarray, size: float, rng: np.random.Generator, leaf: int, margin: float):
    """Nested ``(direction, split, left, right)``, or a leaf's estimated size. Both sides of a split hold what lies within ``margin`` of it.

    Of six random directions the one with the widest spread is taken. A node is left whole when it is small
    enough, or when the overlap would hold nearly all of it: a dense group is never cut. One that is too large, but of
    which the sample holds too little to go on, has its size negated; ``refine`` splits it by its own rows.
    """
    if size <= leaf or len(sample) < 8:
        return -float(size) if size > leaf and size > 1.5 * len(sample) else float(size)
    dirs = rng.normal(size=(6, sample.shape[1]))
    dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
    p = sample @ dirs.T
    best = int(p.std(axis=0).argmax())
    w, p = dirs[best], p[:, best]
    split = float(np.median(p))
    left, right = p <= split + margin, p >= split - margin
    if max(left.sum(), right.sum()) > 0.9 * len(p):
        return float(size)
    return w, split, fit_tree(sample[left], size * left.mean(), rng, leaf, margin), fit_tree(sample[right], size * right.mean(), rng, leaf, margin)


def leaves(tree, v: np.ndarray, margin: float) -> list[tuple[np.ndarray, float]]:
    """Row numbers in each leaf and its estimated size, leaves in a fixed order; a row is in one or more."""
    out: list[tuple[np.ndarray, float]] = []

    def go(node, at):
        if isinstance(node, float):
            out.append((at, node))
            return
        p = v[at] @ node[0]
        go(node[2], at[p <= node[1] + margin])
        go(node[3], at[p >= node[1] - margin])

    go(tree, np.arange(len(v)))
    return out


def has_thin(tree) -> bool:
    """Whether a leaf is left for ``refine``."""
    return tree < 0 if isinstance(tree, float) else has_thin(tree[2]) or has_thin(tree[3])


def refine(placed: DataFrame, item: str, leaf: int, margin: float, trees: int, fit_rows: int, seed: int) -> DataFrame:
    """``placed`` with every leaf of negative size split by trees fitted on its own rows, until none is left.

    A round counts those leaves, draws from each a sample of about ``fit_rows``, fits its tree in one task, and puts
    the rows through it in parts of bounded bytes: neither leaves nor trees come to the driver. A round makes leaves
    smaller by the ratio of its sample to eight, so rounds are logarithmic in the table.
    """
    schema = "g string, leaf string, size double, cid long, n long, vec binary"

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        g, at, size, rows = (t.column(c)[0].as_py() for c in ("g", "leaf", "size", "rows"))
        sample = unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), item).reshape(t.num_rows, -1).astype(float))
        rng = np.random.default_rng([seed, zlib.crc32(f"{g} {at}".encode())])
        grown = [fit_tree(sample, rows, rng, leaf, margin) for _ in range(trees if size == UNKNOWN and rows > leaf else 1)]
        return pa.table({"g": [g], "leaf": [at], "parts": pa.array([t.column("parts")[0].as_py()], pa.int64()), "trees": pa.array([pickle.dumps(grown)], pa.binary())})

    def put(rows: pa.Table, grown: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["g", "leaf", "size", "cid", "n", "vec"])
        at = rows.column("leaf")[0].as_py()
        # a leaf that gave no sample row is tried again under another name
        forest = pickle.loads(grown.column("trees")[0].as_py()) if grown.num_rows else [rows.column("size")[0].as_py()]
        vec = unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), item).reshape(rows.num_rows, -1).astype(float))
        take, names, sizes = [], [], []
        for t, tree in enumerate(forest):
            for number, (inside, size) in enumerate(leaves(tree, vec, margin)):
                take.append(inside)
                names += [f"{at}.{t}.{number}"] * len(inside)
                sizes += [size] * len(inside)
        kept = rows.select(["g", "cid", "n", "vec"]).take(pa.array(np.concatenate(take)))
        return pa.table({"g": kept.column("g"), "leaf": pa.array(names, pa.string()), "size": pa.array(sizes, pa.float64()), "cid": kept.column("cid"), "n": kept.column("n"), "vec": kept.column("vec")})

    now, done, level = saved(placed.select("g", F.col("leaf").cast("string").alias("leaf"), "size", "cid", "n", "vec")), [], 0
    while True:
        done.append(now.where("size >= 0"))
        thin = now.where("size < 0")
        if thin.isEmpty():
            break
        level += 1
        share = F.lit(float(fit_rows)) / F.count("*")
        of = saved(thin.groupBy("g", "leaf").agg(F.count("*").alias("rows"), F.ceil(F.sum(F.length("vec")) / PART).alias("parts"), share.alias("share")))
        known = thin.join(of, ["g", "leaf"])
        drawn = known.where(F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        grown = saved(drawn.groupBy("g", "leaf").applyInArrow(fit, "g string, leaf string, parts long, trees binary"))
        sent = grown.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        parted = known.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(0)), F.col("parts")))
        now = saved(parted.groupBy("g", "leaf", "part").cogroup(sent.groupBy("g", "leaf", "part")).applyInArrow(put, schema))
        discard(of, grown)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # a class lies in few leaves, as the overlap is thin
    return out.join(out.groupBy("cid").agg(F.collect_list("leaf").alias("member")), "cid")


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest label along links (a, b), in place."""
    while True:
        m = np.minimum(label[a], label[b])
        if np.array_equal(m, label[a]) and np.array_equal(m, label[b]):
            return
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label[:] = label[label]


def neighbours(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, leaf: int = LEAF, margin: float = MARGIN, fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links are pairs of one label with cosine >= ``threshold``.

    Equal vectors of one label are one class that counts for all its rows. Trees are fitted on at most about
    ``fit_rows`` classes (fewer, where these would take over 64 MB); leaves that this sample is too thin for are split by trees fitted on their own rows
    (``refine``), so leaves do not grow with the table. Every class is put through the trees and compared, in double
    precision, with all classes in its leaves. A pair that meets in several leaves is counted in the first. No pair leaves its task: a leaf yields a
    number of links for each class and a spanning forest.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
    nothing (n_links 0, component_id their own id). So do vectors of different lengths with each other. A null id counts as a row; its
    component_id is the smallest id in its component, if any. Rows are never dropped.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    # stored singles stay singles on their way; all arithmetic is in doubles
    own_type, item = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(own_type).alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"))
    good = F.expr("label is not null and v is not null and coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false) and exists(v, x -> x <> 0)")
    v = v.withColumn("k1", F.when(good, F.xxhash64("label", "v"))).withColumn("k2", F.when(good, F.xxhash64("v", F.lit(1), "label")))
    classes = saved(v.where("k1 is not null").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("len", F.size("v")).withColumn("cid", F.monotonically_increasing_id()))
    total, width = classes.agg(F.count("*"), F.max("len")).first()
    fit_rows = min(fit_rows, max(256, SAMPLE // (8 * (width or 1))))
    share = min(1.0, fit_rows / max(1, total))
    pick = classes.select("label", "v") if share == 1.0 else classes.select("label", "v").sample(share, seed=seed).limit(2 * fit_rows)
    got = pick.toArrow().combine_chunks()
    values, ends = got.column("v").combine_chunks(), np.cumsum(pc.list_value_length(got.column("v")).to_numpy())
    flat, at = values.flatten().to_numpy(), np.concatenate(([0], ends)).astype(np.int64)
    groups: dict[tuple[str, int], list[np.ndarray]] = {}
    for i, label in enumerate(got.column("label").to_pylist()):
        groups.setdefault((label, int(at[i + 1] - at[i])), []).append(flat[at[i] : at[i + 1]])
    rng = np.random.default_rng(seed)
    forest = {}
    # a group without a sample row may yet be larger than a leaf (else the chance is below e^-20)
    unsure = share < 1.0 and 20 / share > leaf
    for key in sorted(groups):
        rows = unit(np.array(groups[key], float))
        if unsure and len(rows) < 8:
            forest[key] = [UNKNOWN]
        elif len(rows) / share > leaf:
            forest[key] = [fit_tree(rows, len(rows) / share, rng, leaf, margin) for _ in range(trees)]
        else:
            forest[key] = [len(rows) / share]
    ref = spark.sparkContext.broadcast(forest)
    block = BLOCK
    thin = any(has_thin(tree) for grown in forest.values() for tree in grown)
    if unsure and not thin:  # groups that the sample has not met
        met = spark.createDataFrame(sorted(forest), "label string, len int")
        thin = not classes.select("label", "len").distinct().join(met, ["label", "len"], "left_anti").isEmpty()

    def place(batches):
        """One row per (class, leaf), with the leaf's size; all leaves of the class go along."""
        for b in batches:
            label, raw = b.column("label").to_pylist(), b.column("v").to_pylist()
            by: dict[tuple[str, int], list[int]] = {}
            for i, x in enumerate(label):
                by.setdefault((x, len(raw[i])), []).append(i)
            for key, at in by.items():
                stored = np.array([raw[i] for i in at], item)
                vec = unit(stored.astype(float))
                member: list[list[int]] = [[] for _ in at]
                sizes: list[list[float]] = [[] for _ in at]
                for t, tree in enumerate(ref.value.get(key, [UNKNOWN if unsure else 1.0])):
                    for number, (rows, size) in enumerate(leaves(tree, vec, margin)):
                        for r in rows.tolist():
                            member[r].append((t << 24) | number)
                            sizes[r].append(size)
                src = np.repeat(np.arange(len(at)), [len(m) for m in member])
                take = pa.array(np.array(at)[src])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{key[0]}|{key[1]}"] * len(src)),
                        pa.array([x for m in member for x in m], pa.int32()),
                        pa.array([x for m in sizes for x in m], pa.float64()),
                        b.column("cid").take(take),
                        b.column("n").take(take),
                        pa.array([stored[s].tobytes() for s in src], pa.binary()),
                        pa.array([member[s] for s in src], pa.list_(pa.int32())),
                    ],
                    ["g", "leaf", "size", "cid", "n", "vec", "member"],
                )

    placed = classes.select("label", "v", "cid", "n").mapInArrow(place, "g string, leaf int, size double, cid long, n long, vec binary, member array<int>")
    if thin:
        placed = refine(placed, item, leaf, margin, trees, fit_rows, seed)
    sized = placed.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("g", "leaf", "cid", "n", "vec", "member", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        cid, n, own = (t.column(c).to_numpy() for c in ("cid", "n", "own"))
        lo, hi, here = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("leaf")[0].as_py()
        vec = unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), item).reshape(len(cid), -1).astype(float))
        member, many = t.column("member").to_pylist(), n.astype(float)
        seen = Counter(x for m in member for x in m if x < here)
        before = [x for x, times in seen.items() if times > 1]
        shared = np.zeros((len(cid), len(before)), np.float32)
        col = {x: i for i, x in enumerate(before)}
        for i, m in enumerate(member):
            shared[i, [col[x] for x in m if x in col]] = 1
        left = np.flatnonzero(own == lo)
        right = np.flatnonzero(own == hi)
        links, label = np.zeros(len(cid)), np.arange(len(cid))
        for i in range(0, len(left), TILE):
            a = left[i : i + TILE]
            hit = vec[a] @ vec[right].T >= threshold
            if lo == hi:
                hit &= a[:, None] < right[None, :]
            x, y = np.nonzero(hit)
            if not len(x):
                continue
            merge_labels(label, a[x], right[y])
            if before:
                hit &= ~(shared[a] @ shared[right].T > 0)
            weigh = hit.astype(float)
            links[a] += weigh @ many[right]
            links[right] += many[a] @ weigh
        c, e = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(cid)))
        return pa.table({"edge": np.repeat([False, True], [len(c), len(e)]), "a": np.concatenate([cid[c], cid[e]]), "b": np.concatenate([links[c].astype(np.int64), cid[label[e]]])})

    found = saved(dealt.groupBy("g", "leaf", "lo", "hi").applyInArrow(compare, "edge boolean, a long, b long"))
    counts = found.where("not edge").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    comp = connected_components(found.where("edge").select("a", "b"))
    named = classes.select("k1", "k2", "cid", "rep", "n").join(counts, "cid", "left").join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("c", F.coalesce("component", "cid"))
    first = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    known = named.join(first, "c").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    ids = v.select("vec_id", "k1", "k2")
    linked = ids.where("k1 is not null").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = ids.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = saved(linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    discard(classes, found, comp)
    return out
