"""Phrase collocations: frequent words get numbers, n-grams of numbers are fixed-width binary keys, sorted by range and counted by runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import buffers, discard, saved, slices

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A phrase goes if a longer candidate around it has this many hundredths of its occurrences.
COVER = 80
#: Bytes of text of one language that share a dictionary and are counted together.
BLOCK_BYTES = 16 << 20
#: Rows that one range of keys holds, about.
RANGE_ROWS = 2 << 20
#: Shares into which a language is dealt before its first phrases are taken.
SALTS = 256
BREAK = b"\xff"  # no byte of UTF-8
#: A-Z become small, the ends of pieces the break, and a tab a blank.
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")


def _tokens(raw: bytes) -> list[bytes]:
    return raw.replace(BREAK, b" " + BREAK + b" ").split()


def _cut(raw: bytes, at: int) -> int:
    """First blank or break from ``at`` on; the end, if there is none."""
    found = [x for x in (raw.find(b" ", at), raw.find(BREAK, at)) if x >= 0]
    return min(found, default=len(raw))


def _blocks(batches: Iterable[pa.RecordBatch], context: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, tokens, own) of each block; texts are parted by breaks. A huge text is cut between words, and behind its ``own`` tokens a block has up
    to ``context`` tokens of the next, so that every n-gram lies in the block in which it begins."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def out(lang):
        size.pop(lang)
        tokens = _tokens(BREAK.join(held.pop(lang)))
        return lang, tokens, len(tokens)

    for b in slices(batches, "t"):
        for lang, raw in zip(b.column("lang").to_pylist(), buffers(b, "t"), strict=True):
            raw = raw.translate(_LETTERS)
            if len(raw) > BLOCK_BYTES:
                begin = 0
                while begin < len(raw):
                    end = p = _cut(raw, begin + BLOCK_BYTES)
                    tokens, more = _tokens(raw[begin:end]), []
                    while len(more) < context and p < len(raw):
                        p, q = _cut(raw, p + 1), p
                        more += _tokens(raw[q:p])
                    yield lang, tokens + more[:context], len(tokens)
                    begin = end
                continue
            held.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw)
            if size[lang] >= BLOCK_BYTES:
                yield out(lang)
            elif sum(size.values()) >= 2 * BLOCK_BYTES:
                yield from map(out, list(size))
    yield from map(out, list(size))


PARTS = "block long, lang string, own int, ids binary, word string, at int, n long"


def encoded(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS) -> DataFrame:
    """Blocks of texts as numbers of their own dictionaries (0 is a break), one row each, and a row for each word of each dictionary with its count."""
    null = {"block": pa.int64(), "lang": pa.string(), "own": pa.int32(), "ids": pa.binary(), "word": pa.string(), "at": pa.int32(), "n": pa.int64()}

    def rows(size, **cols):
        return pa.RecordBatch.from_arrays([cols[c].cast(k) if c in cols else pa.nulls(size, k) for c, k in null.items()], list(null))

    def body(batches):
        block = TaskContext.get().partitionId() << 32
        for lang, tokens, own in _blocks(batches, max_words - 1):
            number = dict.fromkeys([BREAK])
            number.update(dict.fromkeys(tokens))
            number = {w: i for i, w in enumerate(number)}
            ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            words = list(number)[1:]
            if not words:
                continue
            yield rows(1, block=pa.array([block]), lang=pa.array([lang]), own=pa.array([own]), ids=pa.array([ids.tobytes()], pa.binary()))
            count = np.bincount(ids[:own], minlength=len(number))[1:]
            for i in range(0, len(words), 1 << 16):
                some = words[i : i + (1 << 16)]
                at = np.arange(i + 1, i + 1 + len(some), dtype=np.int32)
                yield rows(len(some), block=pa.array(np.full(len(some), block)), lang=pa.array([lang] * len(some), pa.string()), word=pa.array(some, pa.binary()), at=pa.array(at), n=pa.array(count[i : i + (1 << 16)]))
            block += 1

    plain = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("t"))
    return plain.mapInArrow(body, PARTS)


def windows(ids: np.ndarray, own: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of up to ``width`` numbers, as keys, and their counts: from each of the first ``own`` places on, up to the next break, two words or more.

    A key holds ``width`` numbers of four bytes, the first first and zeros behind the last. All n-grams are the beginnings of windows. A window is named
    word by word, by the name so far and the next word, so only whole numbers are sorted.
    """
    padded = np.concatenate((ids, np.zeros(width, ids.dtype)))
    at = np.flatnonzero((padded[:own] > 0) & (padded[1 : own + 1] > 0))
    words = [padded[at]]
    for k in range(1, width):
        words.append(np.where(words[-1] > 0, padded[at + k], 0))
    known, name = np.unique(words[0], return_inverse=True)
    order, new = np.arange(len(at)), np.ones(len(at), bool)
    for word in words[1:]:
        key = name * (int(ids.max(initial=0)) + 1) + word
        order = np.argsort(key)
        new = np.ones(len(at), bool)
        new[1:] = np.diff(key[order]) != 0
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(new) - 1
    first = order[new]
    keys = np.zeros((len(first), width), ">u4")
    for k, word in enumerate(words):
        keys[:, k] = word[first]
    return keys, np.diff(np.append(np.flatnonzero(new), len(at)))


def _binary(keys: np.ndarray) -> pa.Array:
    size = keys.shape[1] * keys.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, size * len(keys) + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a binary column of ``size`` bytes each."""
    if not len(column):
        return np.empty((0, size), np.uint8)
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + size * len(column)].reshape(-1, size)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of bytes, by their digits of two bytes from the last to the first; digits that are the same in all rows are skipped."""
    digits = keys.view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for d in range(digits.shape[1] - 1, -1, -1):
        col = digits[:, d]
        if len(col) and (col != col[0]).any():
            order = order[np.argsort(col[order], kind="stable")]  # numpy sorts numbers of 16 bits by radix
    return order


def prefix_counts(keys: np.ndarray, n: np.ndarray, width: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows (rows of bytes) with counts: every beginning of two words or more that occurs ``min_count`` times, as a key, and its count. Those that may go
    on in the range before or behind, the first and the last of each length, are there however few they are."""
    word = keys.view(">u4").astype(np.int64)
    new = np.zeros(len(keys), bool)
    new[0] = True
    out, counts = [], []
    for k in range(width):
        new[1:] |= word[1:, k] != word[:-1, k]
        if not k:
            continue
        begin = np.flatnonzero(new)
        f = np.add.reduceat(n, begin)
        keep = f >= min_count
        keep[[0, -1]] = True
        keep &= word[begin, k] > 0
        got = np.zeros((int(keep.sum()), width), ">u4")
        got[:, : k + 1] = word[begin[keep], : k + 1]
        out.append(got)
        counts.append(f[keep])
    return np.concatenate(out).astype(">u4"), np.concatenate(counts)  # joined arrays are in the machine's order


def counted(rows: DataFrame, width: int, min_count: int) -> DataFrame:
    """``rows(key, n)`` of windows -> ``(key, f)`` of their beginnings that occur ``min_count`` times.

    Keys are dealt by range; a task sorts its range by radix and counts the runs of each length. A frequent phrase is many windows, which may lie in many ranges:
    only the runs at the ends of ranges, two for each length, meet again. A window is there once for each block at most, so a range stays near ``RANGE_ROWS`` rows.
    """
    size = 4 * width

    def body(batches):
        got = [(_bytes(b.column("key"), size), np.asarray(b.column("n"))) for b in batches if b.num_rows]
        if not got:
            return
        keys, n = (np.concatenate([g[x] for g in got]) for x in range(2))
        got.clear()
        order = radix_order(keys)
        keys, f = prefix_counts(keys[order], n[order], width, min_count)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([_binary(keys[i : i + (1 << 16)]), pa.array(f[i : i + (1 << 16)])], ["key", "f"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranges = rows.select("key", "n").repartitionByRange(parts, "key").mapInArrow(body, "key binary, f long")
    return ranges.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def numbered(kept: DataFrame) -> DataFrame:
    """``(lang, word, f)`` -> with ``id`` from 1 on, without gaps. Only the number of rows of each partition reaches the driver."""
    parts = saved(kept.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted(tuple(r) for r in parts.groupBy("part").count().collect())
    base, rows = 1, []
    for part, n in sizes:
        rows.append((part, base))
        base += n
    if base > 1 << 32:
        raise ValueError("more frequent words than numbers of four bytes")
    first = kept.sparkSession.createDataFrame(rows, "part int, base long")
    out = saved(parts.join(F.broadcast(first), "part").select("lang", "word", "f", (F.col("base") + F.col("seq")).alias("id")))
    discard(parts)
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: ``(key, f)`` of every phrase of up to ``max_words`` words with ``min_count`` occurrences, the words ``(id, lang, word, f)`` that
    keys are made of, and ``(lang, n)``, the words of each language.

    The words of each block's dictionary are summed over all blocks; frequent ones get numbers, and each block gets those of its own words. Pieces
    break at all other words. What leaves a block is a count for each distinct window of ``max_words`` words; one sort of these counts the phrases of all lengths.
    """
    parts = saved(encoded(docs, text_col, lang_col, max_words))
    words = parts.where("word is not null").select("block", "lang", "word", "at", "n")
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")))
    kept = words.withColumn("f", F.sum("n").over(Window.partitionBy("word", "lang"))).where(F.col("f") >= min_count)
    kept = saved(kept.select("block", "at", "lang", "word", "f"))
    terms = numbered(kept.select("lang", "word", "f").distinct())
    own = kept.join(terms.select("lang", "word", "id"), ["lang", "word"]).select("block", "at", "id")

    def keyed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.nulls(0, pa.binary()), "n": pa.nulls(0, pa.int64())})
        ids = np.frombuffer(left.column("ids")[0].as_py(), np.int32)
        number = np.zeros(int(ids.max()) + 1, np.int64)
        number[np.asarray(right.column("at"))] = np.asarray(right.column("id"))
        keys, n = windows(number[ids], left.column("own")[0].as_py(), max_words)
        return pa.table({"key": _binary(keys), "n": pa.array(n, pa.int64())})

    texts = parts.where("ids is not null").select("block", "own", "ids")
    keys = saved(texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(keyed, "key binary, n long"))
    discard(parts, kept)
    single = terms.select(F.expr(f"rpad(unhex(lpad(hex(id), 8, '0')), {4 * max_words}, x'00')").alias("key"), "f")
    out = saved(counted(keys, max_words, min_count).unionByName(single))
    discard(keys)
    return out, terms, totals


def _part(first: str, length: str, width: int) -> str:
    """SQL for the key of ``length`` words from word ``first`` (from 0) of a key."""
    return f"rpad(substring(key, 4 * ({first}) + 1, 4 * ({length})), {4 * width}, x'00')"


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, cover: int = COVER, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language by score, occurrences (both falling) and phrase.

    A-Z are read as a-z; texts are parted at ``.,;:!?`` and line ends, pieces at blanks and tabs. A phrase of 2 to ``max_words`` words is a candidate from ``min_count``
    occurrences within pieces on (overlaps count). Its score is that of its weakest cut into two parts, floor(2000000 a / (l + r)), a, l and r the occurrences of the
    whole and the parts; ties go to the cut nearest the front. Candidates inside a longer candidate with ``cover`` hundredths of their occurrences or more go. n: all
    words of the language. A null language is ``und``; null and empty texts have no words; repeated rows count each time; other columns are ignored; an empty
    table gives an empty result. Sums are 64-bit numbers, products decimals of 38 digits.

    Languages are dealt into ``SALTS`` shares, each gives its first ``top`` rows, and only those meet.
    """
    counts, terms, totals = phrase_counts(docs, text_col, lang_col, min_count, max_words)
    size = " + ".join(f"if(substring(key, {4 * i + 1}, 4) = x'00000000', 0, 1)" for i in range(max_words))
    sized = counts.withColumn("words", F.expr(size))
    phrases = sized.where("words > 1")
    cuts = phrases.select("key", "f", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "words")
    cuts = cuts.select("key", "f", "k", F.expr(_part("0", "k", max_words)).alias("lkey"), F.expr(_part("k", "words - k", max_words)).alias("rkey"))
    left, right = counts.select(F.col("key").alias("lkey"), F.col("f").alias("l")), counts.select(F.col("key").alias("rkey"), F.col("f").alias("r"))
    cuts = cuts.join(left, "lkey").join(right, "rkey")
    score = F.expr("(cast(f as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)").cast("long")
    scored = cuts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("f").alias("a"))
    if max_words > 2:
        places = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), o -> struct(o, m))))")
        inner = phrases.where("words > 2").select("key", "f", F.explode(places).alias("p")).select(F.expr(_part("p.o", "p.m", max_words)).alias("key"), "f")
        around = inner.groupBy("key").agg(F.max("f").alias("around"))
        covered = F.expr(f"coalesce(cast(around as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {int(cover)}, false)")
        scored = scored.join(around, "key", "left").where(~covered)
    scored = saved(scored.select("key", "a", "cut"))
    ids = F.array(*[F.conv(F.hex(F.expr(f"substring(key, {4 * i + 1}, 4)")), 16, 10).cast("long") for i in range(max_words)])
    spelled = scored.select("key", F.posexplode(F.array_remove(ids, 0)).alias("i", "id")).join(terms.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.expr("array_join(transform(array_sort(collect_list(struct(i, word))), x -> x.word), ' ')").alias("phrase"))
    rows = scored.join(spelled, "key").select("key", "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", "salt").orderBy(*order)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = saved(rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(counts, terms, totals, scored)
    return out
