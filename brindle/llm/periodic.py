"""Periodic runs of words: names of power-of-two blocks (Karp, Miller and Rosenberg 1972) and the common extensions read off them."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import buffers, free_name, kept_columns, per_slice

#: A run has at least so many words, and its period at least so many times.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of text that are named together; about a hundred bytes of arrays go with each word.
SLICE_BYTES = 4 << 20
RESULTS = ("n_words", "runs", "collapsed")


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place one place with an equal key, the same for all of them; whether there is another than itself."""
    order = np.argsort(key)
    by = key[order]
    new = np.ones(len(key), bool)
    new[1:] = by[1:] != by[:-1]
    group = np.cumsum(new) - 1
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    name, many = np.empty(len(key), np.int64), np.empty(len(key), bool)
    name[order] = order[new][group]
    many[order] = size[group] > 1
    return name, many


def block_names(words: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Level k: for each place a place at which an equal block of 2^k words of the same text begins; itself, if there is no other.

    ``words`` holds a number for each word of each text, different ones for different texts; ``end`` the end of the text around each place. The
    name of a block is that of its two halves as a pair, so only pairs of names that occur twice are sorted again, and the levels end
    where no block occurs twice.
    """
    n = len(words)
    name, many = _named(words)
    levels, half = [], 1
    while many.any():
        levels.append(name.astype(np.int32 if n < 1 << 31 else np.int64))
        at = np.flatnonzero(many)
        at = at[at + 2 * half <= end[at]]
        at = at[many[at + half]]
        got, twice = _named(name[at] * n + name[at + half])
        name, many = np.arange(n), np.zeros(n, bool)
        name[at[twice]], many[at[twice]] = at[got[twice]], True
        half *= 2
    return levels


def common_ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree from i and j > i on: a level's block fits once at most, as no block above the top level occurs twice."""
    a, b = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        there = np.flatnonzero(b < len(levels[k]))
        same = there[levels[k][a[there]] == levels[k][b[there]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - i


def common_behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree before i and before j > i."""
    a, b = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        there = np.flatnonzero(a >= 1 << k)
        same = there[levels[k][a[there] - (1 << k)] == levels[k][b[there] - (1 << k)]]
        a[same] -= 1 << k
        b[same] -= 1 << k
    return i - a


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number within its owner, for ``count`` items of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def periodic_runs(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and period, in texts at ``begin`` with ``size`` words each.

    A run of period q holds 4 q words or more, so the first multiple of q in it, counted from the text's begin, agrees with the next for 2 q + 1
    words or more, hence at the level k with 2^k <= 2 q + 1 < 2^(k+1). Such pairs on the grid are the candidates, of neighbours only the
    first; the texts without a repeated block at that level have none. Candidates are extended both ways. Where two periods give the same
    stretch, the smaller is the run's, and the others are its multiples.
    """
    end = np.repeat(begin + size, size)
    levels = block_names(words, end)
    found = []
    for k in range(1, len(levels)):
        name, low = levels[k], 1 << (k - 1)
        repeated = np.flatnonzero(name != np.arange(len(name)))
        texts = np.unique(np.searchsorted(begin, repeated, side="right") - 1)
        texts = texts[size[texts] >= MIN_EXPONENT * low]
        if not len(texts):
            continue
        pair, q = _spread(np.minimum(2 * low - 1, size[texts] // MIN_EXPONENT) - low + 1)
        q += low
        grid, m = _spread((size[texts[pair]] - 1) // q)
        i = begin[texts[pair[grid]]] + q[grid] * m
        hit = name[i] == name[i + q[grid]]
        first = hit.copy()
        first[1:] &= ~(hit[:-1] & (m[1:] > 0))
        found.append((i[first], q[grid[first]]))
    none = np.empty(0, np.int64)
    i, q = (np.concatenate([f[x] for f in found]) for x in (0, 1)) if found else (none, none)
    s, e = i - common_behind(levels, i, i + q), i + q + common_ahead(levels, i, i + q)
    long = e - s >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
    s, e, q = s[long], e[long], q[long]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _runs_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Words of each text, its runs, and the text of the words that stay."""
    split = [t.split() for t in texts]  # bytes: white space is exactly 20 and 09-0D
    size = np.fromiter(map(len, split), np.int64, len(split))
    begin = np.cumsum(size) - size
    every = [w for words in split for w in words]
    number = {w: i for i, w in enumerate(dict.fromkeys(every))}
    words = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    words += np.repeat(np.arange(len(split)), size) * len(number)
    s, e, q = periodic_runs(words, begin, size)
    edge = np.zeros(len(every) + 1, np.int64)
    np.add.at(edge, s + q, 1)
    np.add.at(edge, e, -1)
    stays = np.cumsum(edge[:-1]) == 0
    text = np.searchsorted(begin, s, side="right") - 1 if len(s) else s
    n_runs = np.bincount(text, minlength=len(split)) if len(s) else np.zeros(len(split), np.int64)
    fields = [pa.array(x, pa.int64()) for x in (s - begin[text], e - s, q)]
    runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_runs)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    kept = [b" ".join(compress(w, stays[b : b + len(w)].tolist()) if r else w) for w, b, r in zip(split, begin.tolist(), n_runs.tolist(), strict=True)]
    return size, runs, kept


def find_runs(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Adds ``n_words``, ``runs`` (array of start, length and period, by start and period) and ``collapsed`` to each row.

    Words are the stretches between ASCII white space. A run is a stretch of at least ``MIN_LENGTH`` words with smallest period q that holds its
    period ``MIN_EXPONENT`` times or more and that no neighbour extends. ``collapsed`` holds the words outside of runs and the first period of
    each run (a word that one run repeats goes, whatever another says), joined by single blanks.

    Every row is worked on by itself, so repeated rows and ids get equal results. A null or empty text has no words, no runs and an empty
    ``collapsed``. All columns pass through whatever their names, but for those named like a result, or are those of ``keep``; an empty table gives an empty result.
    A text of n words takes n log n steps at each level at which a block of it occurs twice, and is held by one task.
    """
    t = free_name(docs, "_text")
    cols = kept_columns(docs, RESULTS) if keep is None else keep
    plain = docs.select(*cols, F.col(f"`{text_col}`").alias(t))
    names = plain.columns[:-1]

    def body(b: pa.RecordBatch) -> pa.RecordBatch:
        size, runs, kept = _runs_of(buffers(b, t))
        more = [pa.array(size, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + more, [*names, *RESULTS])

    schema = plain.select(*[F.col(f"`{c}`") for c in names]).schema
    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    for name, kind in zip(RESULTS, (T.LongType(), T.ArrayType(run), T.StringType()), strict=True):
        schema = schema.add(name, kind)
    return plain.mapInArrow(per_slice(body, t, max_bytes=SLICE_BYTES), schema)


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where the texts of a tenth of the ids end in a repeated stretch: a known case for every kind of run.

    With h = CRC-32 of the id in decimal and g = h div 10, rows with h mod 10 = 0 and n > 0 words have each word i >= a = g mod n replaced by word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8); their words are joined by single blanks. Other rows, null ids and texts among them, stay.
    """
    h, g, w, n, a, p = (free_name(docs, f"_{x}") for x in ("h", "g", "words", "n", "a", "p"))
    df = docs.withColumn(h, F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))).withColumn(g, F.expr(f"`{h}` div 10"))
    df = df.withColumn(w, F.when(F.col(h) % 10 == 0, F.array_remove(F.split(F.col(f"`{text_col}`"), r"[\x20\x09-\x0D]+"), "")))
    df = df.withColumn(n, F.size(w)).withColumn(a, F.when(F.col(n) > 0, (F.col(g) % F.col(n)).cast("int")))
    df = df.withColumn(p, F.expr(f"cast(1 + (`{n}` - `{a}`) div (3 + `{g}` % 8) as int)"))
    tail = f"slice(flatten(array_repeat(slice(`{w}`, `{a}` + 1, `{p}`), cast(ceil((`{n}` - `{a}`) / `{p}`) as int))), 1, `{n}` - `{a}`)"
    new = F.expr(f"array_join(concat(slice(`{w}`, 1, `{a}`), {tail}), ' ')")
    return df.withColumn(text_col, F.when(F.col(n) > 0, new).otherwise(F.col(f"`{text_col}`"))).drop(h, g, w, n, a, p)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each of ``find_runs``: number of runs, the longest (ties: smallest start, then period) and SHA-256 of runs and collapsed text."""
    longest = "array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) when x.period <> y.period then if(x.period < y.period, -1, 1) else 0 end)"
    best = F.expr(f"get({longest}, 0)")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    df = found.select(F.col(f"`{id_col}`").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    cols = [F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return df.select("doc_id", "n_runs", *cols, exponent, F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
