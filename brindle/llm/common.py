"""What the operators share: shared-folder tables, tokenizer files, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import shared_base


#: Bytes of a row group in tables between steps: what a writer of whole texts holds in memory.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly(index: str) -> Column:
    """A key that ``repartition(n, key)`` deals to partition ``index`` modulo n, for an SQL expression from 0 to 2^31 - 1.

    Hashing few large groups into about as many partitions puts several into some. Spark's hash of an int (Murmur3, seed 42) is one to one,
    so there is an int for every hash: this runs its steps backwards, in 32 bits.
    """
    word = (1 << 32) - 1

    def times(b: int) -> str:
        b = pow(b, -1, 1 << 32)
        return f"(x * {b & 0xFFFF}L + ((x * {b >> 16}L) & 65535L) * 65536L) & {word}L"

    def turned_back(k: int) -> str:
        return f"shiftright(x, {k}) | ((x & {(1 << k) - 1}L) * {1 << (32 - k)}L)"

    steps = ["x ^ shiftright(x, 16)", times(0xC2B2AE35), "x ^ shiftright(x, 13) ^ shiftright(x, 26)", times(0x85EBCA6B), "x ^ shiftright(x, 16)", "x ^ 4L"]
    steps += [f"(x - {0xE6546B64}L) & {word}L", times(5), turned_back(13), "x ^ 42L", times(0x1B873593), turned_back(15), times(0xCC9E2D51), "if(x >= 2147483648L, x - 4294967296L, x)"]
    out = f"array(cast({index} as bigint))"
    for s in steps:
        out = f"transform({out}, x -> {s})"
    return F.expr(f"cast({out}[0] as int)")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it, so that no column of ``df`` has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def kept_columns(df: DataFrame, results: tuple[str, ...]) -> list[Column]:
    """All columns but those named like a result, which takes their place."""
    out = {r.lower() for r in results}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The row as one struct, out of reach of an operator's own names. The first field only makes sure that there is one."""
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in without))


def unpacked(df: DataFrame, struct: str, without: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``df`` out of what ``packed`` made; those named in ``without`` are given."""
    new = without or {}
    return [(new[c] if c in new else F.col(f"{struct}.c{i}")).alias(c) for i, c in enumerate(df.columns)]


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs no more than the tasks it was running, and rows that depend on how
    tasks were dealt (ids, order) are fixed once.
    """
    spark = df.sparkSession
    path = f"{shared_base(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote. Only for tables that nothing lazy still reads."""
    for df in tables:
        path = getattr(df, "_brindle_path", None)
        if not path:
            continue
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def tokenizer_path(name_or_path: str) -> str:
    """A path is taken as it is; a bare name is looked up among the public tokenizers, on the machine that asks."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def ascii_lower(col):
    """A-Z only, as the contracts have it; not Unicode lower-casing."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 22, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (string) holds about ``max_bytes`` in each: bounded memory in Python.

    A single text larger than that is a slice of its own.
    """
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.asarray(pc.binary_length(b.column(column)).fill_null(0), dtype=np.int64)
        total, start = np.cumsum(size), 0
        while start < n:
            base = total[start - 1] if start else 0
            end = int(np.searchsorted(total, base + max_bytes, side="right"))
            end = min(max(end, start + 1), start + max_rows, n)
            yield b.slice(start, end - start)
            start = end


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, **limits) -> Callable:
    """``mapInArrow`` body that applies ``fn`` to bounded slices."""

    def body(batches):
        for b in slices(batches, column, **limits):
            yield fn(b)

    return body


def buffers(b: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    col = b.column(column).fill_null("")
    return col.cast(pa.large_binary()).to_pylist()
