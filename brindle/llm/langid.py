"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, free_name, kept_columns, saved, slices

#: Lengths of the n-grams, and the number of hash buckets that all of them share.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: A broadcast matrix has at most so many cells; more languages are taken in several blocks.
MAX_CELLS = 1 << 23
RESULTS = ("lang_pred", "score")
#: Bytes of text that are taken at a time; about sixty bytes of arrays go with each.
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    global _letters
    if _letters is None:
        t = np.full(0x110000, 32, np.uint32)
        every = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.uint32)
        t[every] = every
        _letters = t
    return _letters


def normal_form(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, runs of non-letters as one blank, a blank at both ends of each text.

    Returns the code points, the text index of each, and whether each text has a letter.
    """
    parts = [(t or "").lower() for t in texts]
    n = np.fromiter((len(t) + 2 for t in parts), np.int64, len(parts))
    raw = np.frombuffer("".join(f" {t} " for t in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), n)
    code = letter_table()[raw]
    blank = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    has = np.zeros(len(parts), bool)
    has[owner[~blank]] = True
    return code[keep].astype(np.uint64), owner[keep], has


def hashed_ngrams(code: np.ndarray, owner: np.ndarray, buckets: int, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram within a text, and the text it is in."""
    h = np.zeros(len(code), np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for k in range(1, max(orders) + 1):
        m = len(code) - k + 1
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x100000001B3) + code[k - 1 :]
        if k in orders:
            inside = owner[:m] == owner[k - 1 :]
            if k == 1:
                inside = inside & (code[:m] != 32)
            yield (((h[inside] ^ np.uint64(k)) * _MIX) >> shift).astype(np.int64), owner[:m][inside]


class Model:
    """Languages in order, their priors, and float32 log-probabilities: one matrix for each block of languages, one row for each bucket."""

    def __init__(self, langs: list[str], prior: np.ndarray, blocks: list[np.ndarray], orders: tuple[int, ...]):
        self.langs, self.prior, self.blocks, self.orders = langs, prior, blocks, orders

    def part(self, i: int) -> Model:
        """Of the block alone."""
        first = sum(b.shape[1] for b in self.blocks[:i])
        own = slice(first, first + self.blocks[i].shape[1])
        return Model(self.langs[own], self.prior[own], [self.blocks[i]], self.orders)

    def logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log P(language, text) for every language, and whether each text has a letter."""
        code, owner, has = normal_form(texts)
        total = np.tile(self.prior, (len(texts), 1))
        if self.langs:
            for bucket, of in hashed_ngrams(code, owner, len(self.blocks[0]), self.orders):
                if len(of):
                    at = np.flatnonzero(np.diff(of, prepend=-1))
                    total[of[at]] += np.hstack([np.add.reduceat(logp[bucket], at, axis=0, dtype=np.float64) for logp in self.blocks])
        return total, has

    def best(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Best language (null without a letter), its log, and the log of the sum over languages."""
        total, has = self.logs(texts)
        if not self.langs:
            return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        top = total.max(axis=1)
        return [self.langs[i] if ok else None for i, ok in zip(total.argmax(axis=1), has, strict=True)], top, top + np.log(np.exp(total - top[:, None]).sum(axis=1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, top, every = self.best(texts)
        return [x or "und" for x in lang], np.array([float(np.exp(t - e)) if x else 0.0 for x, t, e in zip(lang, top, every, strict=True)])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, alpha: float = 0.5, max_cells: int = MAX_CELLS) -> Model:
    """Counts over every row with a text and a language.

    Languages are taken in blocks of ``max_cells / buckets``, one pass for each. Each task adds its rows into one dense table for the
    block and hands on the non-zero cells; what reaches the driver at a time is the summed table, at most ``max_cells`` cells. The model
    itself is 4 bytes for each bucket and language, whatever the size of the table.
    """
    known = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).where("t is not null and l is not null")
    size = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    langs, blocks = sorted(size), []
    per = max(1, max_cells // buckets)
    for first in range(0, len(langs), per):
        own = langs[first : first + per]
        rows = {x: i for i, x in enumerate(own)}

        def count(batches, rows=rows):
            sums = np.zeros(buckets * len(rows), np.int64)
            for b in slices(batches, "t", max_bytes=SLICE_BYTES):
                code, owner, _ = normal_form(b.column("t").to_pylist())
                row = np.fromiter((rows[x] for x in b.column("l").to_pylist()), np.int64, b.num_rows)
                for bucket, of in hashed_ngrams(code, owner, buckets, orders):
                    sums += np.bincount(row[of] * buckets + bucket, minlength=len(sums))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

        mine = known if len(langs) <= per else known.where(F.col("l").isin(own))
        cells = mine.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros((len(own), buckets))
        sums.reshape(-1)[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
        logp = np.log(sums + alpha) - np.log(sums.sum(axis=1, keepdims=True) + alpha * buckets)
        blocks.append(np.ascontiguousarray(logp.T, dtype=np.float32))
    prior = np.log(np.array([size[x] for x in langs], float) / sum(size.values())) if langs else np.zeros(0)
    return Model(langs, prior, blocks, orders)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus ``lang_pred`` and ``score`` (the posterior of ``lang_pred``).

    A null text, or one without a letter, gets ``und`` and score 0, as does every text if nothing was learned. Ties go
    to the language that sorts first. Only the text enters the prediction. A column of ``docs`` named like a result gives way to it.

    Each block of languages is broadcast for itself, at most ``MAX_CELLS`` cells. With one block, as a rule, that is one pass; with
    more, each pass writes the best language so far and the sum, and the next one reads them.
    """
    sc, text = docs.sparkSession.sparkContext, free_name(docs, "text")
    lang, top, every = (free_name(docs, x) for x in ("lang_best", "lang_log", "lang_sum"))
    src = docs.select(*(keep if keep is not None else kept_columns(docs, RESULTS)), F.col(f"`{text_col}`").alias(text))
    if len(model.blocks) <= 1:
        ref = sc.broadcast(model)

        def body(batches):
            for b in slices(batches, text, max_bytes=SLICE_BYTES):
                names, score = ref.value.predict(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], *RESULTS])

        return src.mapInArrow(body, type(src.schema)(src.schema.fields[:-1]).add("lang_pred", "string").add("score", "double"))
    state = src.select("*", F.lit(None).cast("string").alias(lang), F.lit(float("-inf")).alias(top), F.lit(float("-inf")).alias(every))
    for i in range(len(model.blocks)):
        ref = sc.broadcast(model.part(i))

        def one(batches, ref=ref):
            for b in slices(batches, text, max_bytes=SLICE_BYTES):
                names, best, total = ref.value.best(b.column(b.num_columns - 4).to_pylist())
                before = b.column(b.num_columns - 2).to_numpy()
                names = [n if x > y else o for n, x, y, o in zip(names, best, before, b.column(b.num_columns - 3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(names, pa.string()), pa.array(np.maximum(best, before)), pa.array(np.logaddexp(total, b.column(b.num_columns - 1).to_numpy()))], b.schema.names)

        last, state = state, saved(state.mapInArrow(one, state.schema))
        discard(last)
        ref.unpersist()
    score = F.when(F.col(lang).isNull(), 0.0).otherwise(F.exp(F.col(top) - F.col(every)))
    return state.select(*(F.col(f"`{f.name}`") for f in src.schema.fields[:-1]), F.coalesce(F.col(lang), F.lit("und")).alias("lang_pred"), score.alias("score"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")
