"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import buffers, discard, per_slice, saved
from brindle.llm.components import connected_components

#: Two fingerprints link when at most so many bits differ.
RADIUS = 2
#: Buckets of up to so many distinct fingerprints are compared pair by pair; larger ones are split by their other bits.
BUCKET = 48
#: With so few bits left open a bucket is not split any more.
OPEN = 5


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks such that any two words within ``radius`` bits agree on one of them entirely.

    Bit i carries a non-zero vector m(i) of radius+1 bits; the mask of v keeps the bits with odd <m(i), v>. For any
    ``radius`` differing bits there is a non-zero v orthogonal to all their vectors (fewer equations than unknowns),
    and its mask keeps none of them.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of one text: majority of the XXH64 (seed 42) bits of its word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and white space is exactly 20, 09-0D
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(norm, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate(([0], ends[:-width])).tolist()
    stop = (ends[width - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(norm[a:b], 42) for a, b in zip(start, stop, strict=True)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _hashable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns that can be hashed; maps and variants are left out."""
    return F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in docs.dtypes if _hashable(kind)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp, row_hash)`` for every row. Null, empty or blank text: fp 0. Column names do not matter."""

    def body(b):
        fp = np.array([fingerprint(t, width) for t in buffers(b, "t")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp, pa.int64()), b.column("h")], ["doc_id", "fp", "row_hash"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), row_hash(docs).alias("h"))
    return plain.mapInArrow(per_slice(body, "t"), "doc_id long, fp long, row_hash long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def refined(kept: int) -> list[int]:
    """Seven masks that keep what ``kept`` keeps and, of the other bits, what a covering family over those keeps: words that agree on ``kept`` and lie within two bits
    agree on one of them entirely. Six other bits or more, so that each keeps more."""
    free = [i for i in range(64) if not kept >> i & 1]
    return [kept | sum(1 << free[i] for i in range(len(free)) if m >> i & 1) for m in covering_masks(bits=len(free))]


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct ``fp`` longs -> edges ``(a, b)``: all pairs that differ in at most two bits.

    Each fingerprint enters the seven covering tables and is compared within its buckets. A bucket with more than ``bucket`` fingerprints is
    split by a second covering family over the bits that its mask leaves out, bucket by bucket, and so on: of 64 bits about 28, 12 and 5 are left open, and with
    ``OPEN`` there are no more than 32 fingerprints. No group larger than ``bucket`` (or 32) is ever gathered.
    """
    spark = fps.sparkSession
    masks, found = covering_masks(), []
    entries = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("kept"))
    done = []
    while True:
        entries = entries.withColumn("key", F.col("fp").bitwiseAND(F.col("kept")))
        sized = entries.groupBy("kept", "key").agg(F.count("*").alias("n")).where("n > 1")
        few = (F.col("n") <= bucket) | (F.bit_count(F.bitwise_not("kept")) <= OPEN)
        groups = entries.join(sized.where(few).select("kept", "key"), ["kept", "key"]).groupBy("kept", "key").agg(F.sort_array(F.collect_list("fp")).alias("g"))
        near = "flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> bit_count(x ^ y) <= 2), y -> named_struct('a', x, 'b', y))))"
        found.append(groups.select(F.explode(F.expr(near)).alias("p")).select("p.a", "p.b"))
        hot = saved(sized.where(~few).select("kept", "key"))
        done.append(hot)
        if not hot.head(1):
            break
        finer = {m: refined(m) for m in masks if 64 - m.bit_count() > OPEN}
        children = spark.createDataFrame([(_signed(m), _signed(c)) for m, cs in finer.items() for c in cs], "kept long, child long")
        masks = sorted({c for cs in finer.values() for c in cs})
        entries = saved(entries.join(hot, ["kept", "key"]).join(F.broadcast(children), "kept").select("fp", F.col("child").alias("kept")).distinct())
        done.append(entries)
    out = saved(reduce(DataFrame.union, found).distinct())
    discard(*done)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, row_hash, component_id)`` for every row of ``docs``.

    component_id is the smallest id among all rows whose fingerprints are reachable by links of at most two
    differing bits. Copies share a fingerprint and are one class from the start, however many there are. Null ids
    stay rows and get the component of their class, which is null only if the whole component has no id. Rows are
    never dropped; an empty table gives an empty result.
    """
    prints = saved(fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = saved(classes.select("fp"))
    links = fingerprint_links(distinct)
    comp = connected_components(links)
    discard(distinct, links)
    named = classes.join(comp, classes.fp == comp.id, "left").select(classes.fp, "rep", F.coalesce("component", classes.fp).alias("c"))
    first = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    labels = saved(named.join(first, "c").select("fp", "component_id"))
    discard(comp)
    return prints.join(labels, "fp").select("doc_id", "fp", "row_hash", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows that repeat that id are told apart by the hash of all their columns (smallest wins); full repeats, compared
    column by column, are reduced to one. Columns and their order stay, whatever their names; a group without any id keeps its
    row of smallest hash. Rows with one id and one hash that differ nevertheless all stay.
    """
    rows = simhash_components(docs, id_col, text_col)
    win = rows.groupBy(F.when(F.col("component_id").isNull(), F.col("fp")).alias("f"), "component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("w"))
    win = win.select(F.col("w.doc_id").alias("wid"), F.col("w.row_hash").alias("wh")).distinct()
    # columns in two structs, as the optimizer's inference is exponential in the number of renamed columns beside a hash of them
    named = [(f"c{i}", c, _hashable(kind)) for i, (c, kind) in enumerate(docs.dtypes)]
    fields = lambda which: F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(n) for n, c, ok in named if ok == which))
    doc = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_hash(docs).alias("h"), fields(True).alias("own"), fields(False).alias("rest"))
    # the ids are compared beside the join's key, so that rows lie by h alone, as the removal of repeats wants them
    same = F.coalesce(F.col("id") == F.col("wid"), F.col("id").isNull() & F.col("wid").isNull())
    hit = doc.join(win.hint("merge"), (F.col("h") == F.col("wh")) & same, "left_semi")
    return hit.dropDuplicates(["h", "id", "own"]).select(*(F.col(f"{'own' if ok else 'rest'}.{n}").alias(c) for n, c, ok in named))
