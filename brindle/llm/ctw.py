"""Language-model scores by context-tree weighting over bytes, with a word unigram beside it."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import buffers, discard, evenly, saved, slices
from brindle.llm.langid import fold

#: Bytes of context. A gram is DEPTH context bytes, the latest first, and the byte they predict: 48 bits.
DEPTH = 5
#: A byte that no UTF-8 text holds marks the end of a text and stands before its start.
MARK = 0xFF
#: Bytes of text in a block, and for each part of the statistics; twice as many positions make a two-byte context heavy, and at most so
#: many contexts are.
BLOCK_BYTES, MOST_HEAVY = 16 << 20, 4096
#: Distinct words that are held as strings at a time; beyond, they are kept as hashes.
WORDS_HELD = 100_000
#: Parts of the statistics: grams by their two latest context bytes (three, where these are heavy), words by their hash.
GRAM, WORD = 0, 1
#: Numbers of the cells above the parts: one byte of context and a node, two bytes and a node, and what is counted besides.
DEEP, WORDS = 1 << 40, -1


def grams_of(texts: list[bytes]) -> np.ndarray:
    """Grams of all positions of all texts, end marks included, in the order of the text."""
    pad = bytes([MARK]) * DEPTH
    raw = np.frombuffer(b"".join(pad + t + bytes([MARK]) for t in texts), np.uint8).astype(np.uint64)
    n = len(raw) - DEPTH
    key = raw[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        key |= raw[DEPTH - back : DEPTH - back + n] << np.uint64(8 * (DEPTH - back + 1))
    own = np.ones(n, bool)
    if len(texts) > 1:
        # positions that would predict another text's padding
        stops = np.cumsum(np.fromiter((len(t) + 1 + DEPTH for t in texts), np.int64, len(texts)))[:-1]
        own[(stops[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return key[own]


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) by Stirling's series, shifted up by 8."""
    x = n + 0.5
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    return _stirling(x + 8) - shift


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    return _stirling(x + 8) - shift


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability (natural log) of n0 zeros and n1 ones."""
    return _lgamma_half(n0) + _lgamma_half(n1) - math.log(math.pi) - _lgamma_one(n0 + n1)


def _weighed(n0, n1, below):
    """(log P_w, weight of the node's own estimate) given the sum of its children's log P_w; None at full depth."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones_like(own)
    half = math.log(0.5)
    total = np.logaddexp(own + half, below + half)
    return total, np.exp(own + half - total)


def _by_node(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, j: int):
    """Binary counts at bit j of the predicted byte; (ctx, sym) sorted. -> sorted node keys, zeros, ones."""
    key = (ctx << np.uint64(8)) | np.uint64(1 << j) | (sym >> np.uint64(8 - j))
    one = (sym >> np.uint64(7 - j)) & np.uint64(1)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    ones = np.add.reduceat(n * one, at) if len(at) else np.zeros(0)
    total = np.add.reduceat(n, at) if len(at) else np.zeros(0)
    return key[at], total - ones, ones


def _sums(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Sums by number; doubles, also of nothing."""
    return np.bincount(at, weights=weights, minlength=size).astype(np.float64)


def subtree(keys: np.ndarray, counts: np.ndarray, top: int = 2):
    """Node tables of depths ``top``..DEPTH from sorted grams: ``{(depth, bit): (node keys, estimate of a one, weight)}``,
    and for each bit the nodes at depth ``top`` with their counts and log P_w."""
    seen = counts > 0
    keys, n = keys[seen], counts[seen].astype(np.float64)
    sym = keys & np.uint64(255)
    tables, above = {}, {}
    for d in range(DEPTH, top - 1, -1):
        ctx = keys >> np.uint64(8 * (DEPTH - d + 1))
        if d == DEPTH:
            c, s, m = ctx, sym, n
        else:
            pair, inv = np.unique((ctx << np.uint64(8)) | sym, return_inverse=True)
            c, s, m = pair >> np.uint64(8), pair & np.uint64(255), _sums(inv, n, len(pair))
        for j in range(8):
            node, n0, n1 = _by_node(c, s, m, j)
            below = None
            if d < DEPTH:
                child, logw = above[j]
                up = ((child >> np.uint64(16)) << np.uint64(8)) | (child & np.uint64(255))
                below = _sums(np.searchsorted(node, up), logw, len(node))
            logw, w = _weighed(n0, n1, below)
            tables[d, j] = (node, (n1 + 0.5) / (n0 + n1 + 1), w)
            above[j] = (node, logw) if d > top else (node, logw, n0, n1)
    return tables, above


def trunk(cells: list[tuple[int, float, float, float]]):
    """Node tables of depths 1 and 0 from depth-1 sums ``(cell, zeros, ones, sum of children's log P_w)``; at most 65,280 cells."""
    a = np.array(sorted(cells), np.float64).reshape(-1, 4)
    node, (n0, n1, below) = a[:, 0].astype(np.uint64), a[:, 1:].T
    logw, w = _weighed(n0, n1, below)
    root, inv = np.unique(node & np.uint64(255), return_inverse=True)
    r0, r1, rl = (_sums(inv, x, len(root)) for x in (n0, n1, logw))
    _, rw = _weighed(r0, r1, rl)
    return {1: (node, (n1 + 0.5) / (n0 + n1 + 1), w), 0: (root, (r1 + 0.5) / (r0 + r1 + 1), rw)}


def crown(rows: list[tuple[int, float, float, float]]) -> dict:
    """Node tables above the parts from ``(cell, zeros, ones, sum of children's log P_w)``: depths 0 and 1, and depth 2 of heavy contexts."""
    cells = {int(r[0]): np.array(r[1:], np.float64) for r in rows if 0 <= r[0] < DEEP}
    a = np.array(sorted(tuple(r) for r in rows if r[0] >= DEEP), np.float64).reshape(-1, 4)
    node, (n0, n1, below) = a[:, 0].astype(np.int64) - DEEP, a[:, 1:].T
    logw, w = _weighed(n0, n1, below)
    for k, *x in zip((((node >> 16) << 8) | (node & 255)).tolist(), n0, n1, logw, strict=True):
        cells[k] = cells.get(k, 0) + np.array(x)
    return trunk([(k, *x) for k, x in cells.items()]) | {2: (node.astype(np.uint64), (n1 + 0.5) / (n0 + n1 + 1), w)}


def log10_probability(keys: np.ndarray, tables: dict, top: dict) -> np.ndarray:
    """log10 P(byte | context) of sorted grams: along the path, each node's estimate enters with its posterior weight.

    ``tables`` holds the depths of a part, ``top`` those above. The path ends at the first node that was not seen in training: it and all
    below predict a half, with the weight that is left.
    """
    sym, out = keys & np.uint64(255), np.zeros(len(keys))
    for j in range(8):
        node = np.uint64(1 << j) | (sym >> np.uint64(8 - j))
        acc, rest = np.zeros(len(keys)), np.ones(len(keys))
        alive = np.arange(len(keys))
        for d in range(DEPTH + 1):
            table, est, w = tables[d, j] if (d, j) in tables else top[d]
            if not len(table) or not len(alive):
                break
            ctx = keys[alive] >> np.uint64(8 * (DEPTH - d + 1)) if d else np.zeros(len(alive), np.uint64)
            want = (ctx << np.uint64(8)) | node[alive]
            at = np.minimum(np.searchsorted(table, want), len(table) - 1)
            hit = table[at] == want
            alive, at = alive[hit], at[hit]
            acc[alive] += rest[alive] * w[at] * est[at]
            rest[alive] *= 1 - w[at]
        p = acc + rest * 0.5
        out += np.log10(np.where((sym >> np.uint64(7 - j)) & np.uint64(1), p, 1 - p))
    return out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key. The keys come in sorted runs, which a stable sort merges."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


class _Block:
    """Distinct grams and words of a block's texts, with their counts in training texts."""

    def __init__(self):
        self.keys, self.counts, self.words, self.size = [], [], Counter(), 0
        self.hashes, self.seen = [], []

    def add(self, texts: list[bytes], train: list[bool]) -> None:
        for use in (True, False):
            part = [t for t, x in zip(texts, train, strict=True) if x == use]
            if not part:
                continue
            u, n = np.unique(grams_of(part), return_counts=True)
            self.keys.append(u)
            self.counts.append(n if use else np.zeros(len(u), np.int64))
            self.size += len(u)
            for t in part:
                if use:
                    self.words.update(t.split())
                else:
                    self.words.update(dict.fromkeys(t.split(), 0))
                if len(self.words) > WORDS_HELD:
                    self.close_words()
        if self.size > 2 << 20:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        u, n = _merge(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.counts, self.size = [u], [n], len(u)
        return u, n


    def close_words(self) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            self.hashes.append(_word_hashes(list(self.words)))
            self.seen.append(np.fromiter(self.words.values(), np.int64, len(self.words)))
            self.words = Counter()
        u, n = _merge(self.hashes, self.seen) if self.hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.hashes, self.seen = [u], [n]
        return u, n


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def is_heavy(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    return np.isin(keys >> np.uint64(8 * (DEPTH - 1)), heavy)


def _part_of(keys: np.ndarray, kind: int, parts: int, heavy: np.ndarray) -> np.ndarray:
    top = keys
    if kind == GRAM:
        top = np.where(is_heavy(keys, heavy), (keys >> np.uint64(8 * (DEPTH - 2))) | np.uint64(1 << 24), keys >> np.uint64(8 * (DEPTH - 1)))
    return (((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Differences (of ascending values), byte planes, Zstandard."""
    a = np.diff(a, prepend=a[:1] * 0) if ascending else np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes, dtype, ascending: bool = False) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if ascending else a


def _blobs(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int, heavy: np.ndarray):
    part = _part_of(keys, kind, parts, heavy)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[p] : edges[p + 1]]
        at = at[np.argsort(keys[at])] if kind == WORD else at
        yield 2 * p + kind, block, _pack(keys[at], True), _pack(counts[at].astype(np.int64))


_BLOB = "part long, block long, keys binary, counts binary"


def _rows(rows, schema):
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_BLOB_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _by_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, some of which may be empty; each for itself, so that no rounding depends on its neighbours."""
    out, full = np.zeros(len(lengths), values.dtype), np.flatnonzero(lengths)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out


def _dealt(src: DataFrame) -> DataFrame:
    """``src`` with a column ``block``: each task cuts its rows into blocks of about ``BLOCK_BYTES``, whatever the rows are."""

    def body(batches):
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for b in slices(batches, "t", max_bytes=1 << 21):
            if size > BLOCK_BYTES:
                block, size = block + 1, 0
            size += b.column("t").nbytes
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, block, np.int64))], [*b.schema.names, "block"])

    return src.mapInArrow(body, "id long, held boolean, t string, block long")


def _positions(batches):
    """Positions of each two-byte context; beyond these, the number of training texts and the number of rows."""
    n = np.zeros((1 << 16) + 2, np.int64)
    for b in slices(batches, "t", max_bytes=1 << 21):
        held = b.column("held").to_pylist()
        n[-2:] += (held.count(False), len(held))
        pad = bytes([MARK, MARK])
        raw = np.frombuffer(b"".join(pad + t.lower() + pad for t in buffers(b, "t")), np.uint8).astype(np.int64)
        n[:-2] += np.bincount((raw[1:] << 8) | raw[:-1], minlength=1 << 16)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])


def score(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", heavy_positions: int = 2 * BLOCK_BYTES) -> DataFrame:
    """Score every row; learn from the rows where ``held_out`` (by default fold 1 of 5) is false.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``. Both models see the text
    with A-Z in lower case; null text is empty. ``score`` is the log10 probability of all its bytes and the end of the text;
    ``base_score`` that of its words and an end under the smoothed unigram, whose words are counted by a 64-bit hash. If nothing is
    held for training, every bit is a half. Repeated ids and rows are rows like others; an empty table gives an empty result.

    The model is never in one place. Texts are dealt into blocks. Each block's distinct grams and words go, with counts, to the
    part that owns them, so that a part holds whole subtrees: from depth 2 down, or from depth 3 down under the two-byte contexts with
    more than ``heavy_positions`` positions (more, if over ``MOST_HEAVY`` of them had as many). Parts
    add up the counts, write them, and send their subtrees' weights to the depths above, a table of at most 65,280 cells and 255 for each
    heavy context. Then parts answer each block with the probabilities of its grams, and blocks sum them up. There are
    as many parts as blocks; what they exchange is never more than the distinct grams of each block.
    """
    held = fold(id_col, 5) == 1 if held_out is None else held_out
    dealt = saved(_dealt(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(f"`{text_col}`").alias("t"))))
    positions = np.zeros((1 << 16) + 2, np.int64)
    for r in dealt.mapInArrow(_positions, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        positions[r["cell"]] = r["n"]
    volume, texts_seen = int(positions[:-2].sum()), int(positions[-2])
    parts = max(12, math.ceil(volume / BLOCK_BYTES))
    heavy = np.flatnonzero(positions[:-2] > max(heavy_positions, volume // MOST_HEAVY)).astype(np.uint64)

    def gather(batches):
        own, x = None, _Block()

        def close():
            return _rows([*_blobs(own, GRAM, *x.close(), parts, heavy), *_blobs(own, WORD, *x.close_words(), parts, heavy)], _BLOB_ARROW)

        for b in slices(batches, "t", max_bytes=1 << 21):
            block = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(edges, edges[1:], strict=False):
                if own is not None and own != block[i]:
                    yield close()
                    x = _Block()
                own, rows = int(block[i]), b.slice(i, j - i)
                x.add([t.lower() for t in buffers(rows, "t")], [not h for h in rows.column("held").to_pylist()])
        if own is not None:
            yield close()

    # a block that lies in two files' splits answers for itself twice, which changes nothing
    blobs = saved(dealt.mapInArrow(gather, _BLOB))

    def grouped(batches):
        """Rows of a partition sorted by part -> (part, iterator) runs, without holding them."""
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def add_up(batches):
        part, keys, counts, size = None, [], [], 0

        def close():
            u, n = _merge(keys, counts)
            return _rows([(part, -1, _pack(u, True), _pack(n))], _BLOB_ARROW)

        for p, _, k, c in grouped(batches):
            if part is not None and p != part:
                yield close()
                keys, counts, size = [], [], 0
            part = p
            keys.append(_unpack(k, np.uint64, True))
            counts.append(_unpack(c, np.int64))
            size += len(keys[-1])
            if size > 4 << 20:
                u, n = _merge(keys, counts)
                keys, counts, size = [u], [n], 0
        if part is not None:
            yield close()

    # part 2p of the grams and 2p + 1 of the words go to task p
    task = evenly("part div 2")
    sums = saved(blobs.repartition(parts, task).sortWithinPartitions("part").mapInArrow(add_up, _BLOB))

    def cells(batches):
        names = ["cell", "n0", "n1", "below"]
        for p, _, k, c in grouped(batches):
            keys, n = _unpack(k, np.uint64, True), _unpack(c, np.int64)
            if p % 2 == WORD:
                yield pa.RecordBatch.from_arrays([pa.array([WORDS]), pa.array([float(n.sum())]), pa.array([float((n > 0).sum())]), pa.array([0.0])], names)
                continue
            deep = is_heavy(keys, heavy)
            for which, top, base in ((~deep, 2, 0), (deep, 3, DEEP)):
                for node, logw, n0, n1 in subtree(keys[which], n[which], top)[1].values():
                    u, inv = np.unique(((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)), return_inverse=True)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64) + base), *(pa.array(_sums(inv, x, len(u))) for x in (n0, n1, logw))], names)

    top_rows = sums.mapInArrow(cells, "cell long, n0 double, n1 double, below double").groupBy("cell").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()
    tokens_seen, distinct = next(((int(r[1]), int(r[2])) for r in top_rows if r[0] == WORDS), (0, 0))
    # the end token: once in each training text
    total, vocabulary = tokens_seen + texts_seen, distinct + bool(texts_seen)
    top = docs.sparkSession.sparkContext.broadcast(crown(top_rows))

    def answer(batches):
        part, light, deep, words = None, None, None, None
        for p, block, k, c in grouped(batches):
            keys = _unpack(k, np.uint64, True)
            if block == -1:
                part, n = p, _unpack(c, np.int64)
                if p % 2 == GRAM:
                    which = is_heavy(keys, heavy)
                    light, deep = subtree(keys[~which], n[~which], 2)[0], subtree(keys[which], n[which], 3)[0]
                else:
                    words = keys, n
                continue
            if part != p:
                raise RuntimeError(f"part {p} has no sums")
            if p % 2 == GRAM:
                which, value = is_heavy(keys, heavy), np.zeros(len(keys))
                value[~which] = log10_probability(keys[~which], light, top.value)
                value[which] = log10_probability(keys[which], deep, top.value)
            else:
                value = words[1][np.searchsorted(words[0], keys)]
            yield _rows([(p % 2, block, k, _pack(value))], _BLOB_ARROW)

    asked = sums.unionByName(blobs.withColumn("counts", F.lit(None).cast("binary"))).repartition(parts, task).sortWithinPartitions("part", "block")
    answers = asked.mapInArrow(answer, _BLOB)

    def finish(texts: pa.Table, known: pa.Table) -> pa.Table:
        kind = np.array(known.column("part").to_pylist())
        keys, values = known.column("keys").to_pylist(), known.column("counts").to_pylist()

        def joined(which, dtype):
            k = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x, np.uint64, True) for x, q in zip(keys, kind, strict=True) if q == which)])
            v = np.concatenate([np.zeros(0, dtype), *(_unpack(x, dtype) for x, q in zip(values, kind, strict=True) if q == which)])
            k, at = np.unique(k, return_index=True)
            return pd.Index(k), v[at]

        gram, logp = joined(GRAM, np.float64)
        word, count = joined(WORD, np.int64)
        end = math.log10((texts_seen + 0.5) / (total + 0.5 * (vocabulary + 1)))
        out = [[], [], [], [], [], []]
        for b in slices(texts.to_batches(), "t", max_bytes=1 << 20):
            held_back = [t.lower() for t in buffers(b, "t")]
            words = [t.split() for t in held_back]
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
            c = count[word.get_indexer(_word_hashes(list(number)))]
            n_words = np.array([len(ws) for ws in words])
            own = _by_text(logp[gram.get_indexer(grams_of(held_back))], np.array([len(t) + 1 for t in held_back]))
            known_words = _by_text((c > 0).astype(np.int64)[ids], n_words) + (texts_seen > 0)
            base = _by_text(np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))[ids], n_words) + end
            bits = -own * math.log2(10) / np.array([len(t) + 1 for t in held_back])
            for x, v in zip(out, (n_words + 1, known_words, np.full(len(words), total), base, own, bits), strict=True):
                x.extend(v.tolist())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        return pa.table([texts.column("id"), texts.column("held"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "held_out", *names])

    # blocks in order, each to the next task; a few more tasks than blocks, as tasks of the first step had different numbers of them
    deepest = dealt.agg(F.max(F.col("block").bitwiseAND((1 << 32) - 1))).first()[0] or 0
    key, n = evenly(f"(shiftright(block, 32) * {deepest + 1}L + (block & {(1 << 32) - 1}L)) & {(1 << 31) - 1}L"), 3 * parts
    done = saved(
        dealt.withColumn("key", key).repartition(n, "key")
        .groupBy("key")
        .cogroup(answers.withColumn("key", key).repartition(n, "key").groupBy("key"))
        .applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    )
    discard(dealt, blobs, sums)
    return done
