"""Keys of names and paths: what a pattern must find in them, so that patterns meet rows by a hash join instead of one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import LOWER, UPPER
from brindle.model import KINDS

_LOWER = str.maketrans(UPPER, LOWER)
_FOLDED = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Numbers of keys: two bytes, the first anywhere before the second; one byte; the same of the file; a kind; and what every row has.
PAIR, BYTE, FILE, KIND, EVERY = 0, 1 << 16, 1 << 17, 1 << 18, (1 << 18) + len(KINDS)


def pattern_keys(kind: str | None, file: str, name: str) -> list[int]:
    """Keys that every row which the query finds has: the kind, and each two neighbours, or the only byte, of the parts."""
    out = [KIND + KINDS.index(kind)] if kind else []
    for base, part in ((PAIR, name), (FILE, file)):
        raw = part.translate(_LOWER).encode()
        out += [base + BYTE + raw[0]] if len(raw) == 1 else [base + PAIR + a * 256 + b for a, b in zip(raw, raw[1:], strict=False)]
    return out or [EVERY]


def _found(texts: pa.Array, keys: list[int]) -> list[np.ndarray]:
    """For each key (of names) the texts that have it: a byte stands before another if its first place is before the other's last."""
    raw, n = texts.fill_null("").cast(pa.large_binary()), len(texts)
    offset = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
    size = np.diff(offset)
    place = np.arange(len(data)) - np.repeat(offset[:-1] - offset[0], size)
    at = _FOLDED[data].astype(np.int64) * n + np.repeat(np.arange(n), size)
    first, last = np.full(256 * n, np.iinfo(np.int64).max), np.full(256 * n, -1)
    first[at[::-1]] = place[::-1]
    last[at] = place
    first, last = first.reshape(256, n), last.reshape(256, n)
    return [np.flatnonzero(last[k - BYTE] >= 0 if k >= BYTE else first[k >> 8] < last[k & 255]) for k in keys]


def with_keys(rows: DataFrame, keys: list[int], out: str) -> DataFrame:
    """``rows(name, kind, file)`` with the array ``out`` of those of ``keys`` that they have. Names and files alone go through Arrow."""
    names, files = [k for k in keys if k < FILE], [k for k in keys if FILE <= k < KIND]

    def has(texts: pa.Array, own: list[int], base: int) -> pa.Array:
        hits = _found(texts, [k - base for k in own])
        row, key = np.concatenate(hits), np.repeat(np.array(own, np.int32), [len(h) for h in hits])
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order]))

    @F.arrow_udf("array<int>")
    def in_name(texts: pa.Array) -> pa.Array:
        return has(texts, names, 0)

    @F.arrow_udf("array<int>")
    def in_file(texts: pa.Array) -> pa.Array:
        return has(texts, files, FILE)

    parts = [F.array(F.lit(EVERY))] if EVERY in keys else []
    kinds = [k - KIND for k in keys if KIND <= k < EVERY]
    parts += [F.when(F.col("kind") == KINDS[i], F.array(F.lit(KIND + i))).otherwise(F.array().cast("array<int>")) for i in kinds]
    parts += ([in_name("name")] if names else []) + ([in_file("file")] if files else [])
    return rows.select(*rows.columns, F.concat(*parts).alias(out))


def key_counts(sample: pa.Table, keys: list[int]) -> dict[int, int]:
    """In how many rows of a bounded ``sample(name, kind, file)`` each of ``keys`` is."""
    names, files = [k for k in keys if k < FILE], [k for k in keys if FILE <= k < KIND]
    out = dict.fromkeys(keys, sample.num_rows)
    for own, base, column in ((names, 0, "name"), (files, FILE, "file")):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in sample.column(column).chunks]) if sample.num_rows else pa.array([], pa.large_string())
        out |= {k: len(hit) for k, hit in zip(own, _found(texts, [k - base for k in own]), strict=True)}
    kinds = sample.column("kind").to_pylist()
    return out | {k: kinds.count(KINDS[k - KIND]) for k in keys if KIND <= k < EVERY}
