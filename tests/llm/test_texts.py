"""Operators 2, 4, 5, 6, 7, 8 and 9, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from brindle.llm import bpe, chat, ctw, langid, linededup, packing, token_counts, tokens
from brindle.llm.common import tokenizer_path
from brindle.llm.queries import QUERIES

from . import helpers


def by_row(df):
    return sorted(map(repr, df.collect()))


# ---- 2: context-tree weighting


class Sequential:
    """Context-tree weighting as it is written down: a tree for each node of a byte, updated bit by bit; a prediction is a quotient of P_w."""

    def __init__(self, depth):
        self.depth, self.node = depth, {}

    def path(self, ctx, node):
        return [self.node.get((node, ctx[len(ctx) - d :]), (0, 0, 0.0, 0.0, 0.0)) for d in range(self.depth + 1)]

    def updated(self, path, bit):
        """The same nodes after one more bit: zeros, ones, log KT, sum of the children's log P_w, log P_w."""
        out, child = [], None
        for d in range(self.depth, -1, -1):
            n0, n1, kt, below, pw = path[d]
            kt += math.log(((n1 if bit else n0) + 0.5) / (n0 + n1 + 1))
            if child is not None:
                below += child
            new = kt if d == self.depth else math.log(0.5) + max(kt, below) + math.log1p(math.exp(-abs(kt - below)))
            out.append((n0 + 1 - bit, n1 + bit, kt, below, new))
            child = new - pw
        return out[::-1]

    def steps(self, text):
        raw = bytes([255] * self.depth) + text + b"\xff"
        for i in range(self.depth, len(raw)):
            for j in range(8):
                yield raw[i - self.depth : i], (1 << j) | (raw[i] >> (8 - j)), (raw[i] >> (7 - j)) & 1

    def learn(self, text):
        for ctx, node, bit in self.steps(text):
            for d, x in enumerate(self.updated(self.path(ctx, node), bit)):
                self.node[node, ctx[len(ctx) - d :]] = x

    def score(self, text):
        total = 0.0
        for ctx, node, bit in self.steps(text):
            path = self.path(ctx, node)
            total += self.updated(path, bit)[0][4] - path[0][4]
        return total / math.log(10)


def brute_ctw(train, texts):
    model = Sequential(ctw.DEPTH)
    for t in train:
        model.learn(t)
    return [model.score(t) for t in texts]


def small_texts():
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "mats", "Über", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (100, "cat cat"), (None, "sat On"), (101, "new-word " * 3)]


@pytest.mark.parametrize("heavy", [1 << 30, 20])
def test_ctw_and_unigram_match_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(ctw, "MOST_HEAVY", 1 << 20)
    rows = small_texts()
    df = spark.createDataFrame([(*r, 7, "b", "c") for r in rows], "doc_id long, text string, block long, part string, held string").repartition(3)
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    texts = [(t or "").encode().lower() for _, t in rows]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    own = brute_ctw(train, texts)
    c = Counter(w for t in train for w in t.split())
    c[""] = len(train)
    n, v = sum(c.values()), len(c)
    want = sorted(
        (repr(i), h, len(t.split()) + 1, sum(c[w] > 0 for w in [*t.split(), ""]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), ""]), 6), s)
        for (i, _), h, t, s in zip(rows, held, texts, own, strict=True)
    )
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in ctw.score(df, heavy_positions=heavy).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6]
        assert abs(a[6] - b[6]) < 1e-6


@pytest.mark.parametrize("rows", [[(7, "quiz zone")], [(7, "quiz zone"), (1, "ab cd")], [(7, "qq"), (1, "ab")] * 3, [(None, None)], *([(i, f"{chr(97 + i)}{chr(98 + i)} text") for i in range(n)] for n in (1, 2, 3, 5, 10))])
def test_ctw_of_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for fold in range(5):
        held = [(0 if i is None else zlib.crc32(str(i).encode()) % 5) == fold for i, _ in rows]
        texts = [(t or "").encode().lower() for _, t in rows]
        want = brute_ctw([t for t, h in zip(texts, held, strict=True) if not h], texts)
        got = ctw.score(df, held_out=langid.fold("doc_id", 5) == fold).collect()
        assert sorted(round(r.score, 6) for r in got) == pytest.approx(sorted(want), abs=1e-5)
        if fold == 1:
            assert sorted(r.held_out for r in got) == sorted(held)


def test_ctw_deals_repeated_rows_into_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 2000)
    rows = spark.createDataFrame([(1, "always the same text")] * 3000, "doc_id long, text string").repartition(2)
    dealt = ctw._dealt(rows.selectExpr("doc_id id", "false held", "text t"))
    assert dealt.select("block").distinct().count() >= 2
    got = ctw.score(rows).select("score").distinct().collect()
    assert len(got) == 1


def test_ctw_hostile_and_empty(spark):
    assert ctw.score(helpers.docs(spark)).count() == len(helpers.ROWS)
    assert ctw.score(helpers.empty(spark)).count() == 0


def test_ctw_predictions_sum_to_one():
    texts = [b"the cat sat", b"the mat", b"a hat"]
    key, n = np.unique(ctw.grams_of(texts), return_counts=True)
    tables, above = ctw.subtree(key, n)
    cells = defaultdict(lambda: [0.0, 0.0, 0.0])
    for node, logw, n0, n1 in above.values():
        for k, w, a, b in zip(node.tolist(), logw, n0, n1, strict=True):
            at = cells[((k >> 16) << 8) | (k & 255)]
            at[0] += a
            at[1] += b
            at[2] += w
    top = ctw.crown([(k, *v) for k, v in cells.items()])
    for ctx in (b"e cat", b"zzzzz", b"  the"):
        base = sum(int(c) << (8 * (5 - i)) for i, c in enumerate(reversed(ctx)))
        grams = np.array([base | s for s in range(256)], np.uint64)
        assert abs((10 ** ctw.log10_probability(grams, tables, top)).sum() - 1) < 1e-9


# ---- 4: packing


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_one_by_one_best_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 1024])
    lengths = [rng.randint(1, cap) if rng.random() < 0.7 else rng.randint(1, max(1, cap // 10)) for _ in range(rng.randint(0, 900))]
    runs = packing.best_fit_decreasing(Counter(lengths), cap)
    bins = defaultdict(list)
    for size, _, first, n, off in runs:
        for b in range(first, first + n):
            bins[b].append((off, size))
    assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
    for b in bins.values():
        at = 0
        for off, size in sorted(b):
            assert off == at
            at += size
        assert at <= cap
    assert len(bins) == packing.pack_one_by_one(lengths, cap)


def test_segment_tree_finds_the_tightest():
    rng = random.Random(0)
    tree, have = packing.SegmentTree(100), set()
    for _ in range(2000):
        x = rng.randint(0, 100)
        on = rng.random() < 0.4
        tree.set(x, on)
        have = have | {x} if on else have - {x}
        need = rng.randint(1, 100)
        assert tree.tightest(need) == min((h for h in have if h >= need), default=-1)


def check_packing(rows, got):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) - start - 1) % 1024 + 1
            want[repr(i), piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start, piece = start + n, piece + 1
    assert Counter((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    assert len(seqs) == packing.pack_one_by_one([r.length for r in got], 1024)


def test_packing_query_and_hostile_rows(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_packing([tuple(r) for r in src], QUERIES["op4_best_fit_packing"](spark, sf_dir).collect())
    check_packing([r[:2] for r in helpers.rows()], packing.pack(helpers.docs(spark)).collect())
    assert packing.pack(helpers.empty(spark)).count() == 0


def test_units_are_exact():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), tokens.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    atoms = ["a", "The", "'s", "'", " ", "  ", "\n", "\t", "12", "é", "梦", "😀", "<|endoftext|>", "...", " ", " ", "_", "I'll", "\r\n", "ing"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_bytes(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


# ---- 5: language identification


def test_language_counts_and_posteriors_match_plain_bayes(spark):
    train = [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat est sur la table", "fr"), ("a dog and the cat", "en")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.fit(df, buckets=1 << 14)
    probe = ["the dog", "die katze!!", "été sur la", "x"]
    got, score = model.predict(probe)

    def grams(t):
        c, o, _ = langid.normal_form([t])
        return [int(b) for h, _ in langid.hashed_ngrams(c, o, 1 << 14) for b in h]

    counts = defaultdict(Counter)
    for t, lang in train:
        counts[lang].update(grams(t))
    for t, lang, p in zip(probe, got, score, strict=True):
        logs = {x: math.log(sum(y == x for _, y in train) / 4) + sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * (1 << 14))) for g in grams(t)) for x in counts}
        best = max(sorted(logs), key=logs.get)
        assert lang == best
        assert abs(p - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


def test_language_query_is_accurate_and_hostile_rows_are_defined(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op5_langid"](spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    d = helpers.docs(spark)
    out = langid.identify(d, langid.fit(d))
    assert out.columns == [*(c for c in d.columns if c not in langid.RESULTS), *langid.RESULTS]
    rows = out.collect()
    helpers.assert_extras(rows, langid.RESULTS)
    assert len(rows) == len(helpers.ROWS)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    none = langid.fit(helpers.empty(spark))
    assert {r.lang_pred for r in langid.identify(d, none).collect()} == {"und"}


def test_many_languages_give_the_same_posteriors_in_one_block_or_many(spark):
    rng = random.Random(8)
    langs = [f"l{i:03d}" for i in range(300)]
    words = {x: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(6)] for x in langs}
    rows = [(i, " ".join(rng.choices(words[x], k=8)), x) for i, x in enumerate(langs * 2)] + [(900, None, "l001"), (901, "--- 1", "l002"), (902, "abcd", None)]
    df = spark.createDataFrame([(*r, "a", 1.0) for r in rows], "doc_id long, text string, lang string, lang_best string, score double").repartition(3)
    one, many = langid.fit(df, buckets=1 << 10), langid.fit(df, buckets=1 << 10, max_cells=50 << 10)
    assert (len(one.blocks), len(many.blocks)) == (1, 6)
    assert np.array_equal(np.hstack(many.blocks), one.blocks[0])
    want = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(df, one).collect()}
    got = langid.identify(df, many)
    assert got.columns == ["doc_id", "text", "lang", "lang_best", "lang_pred", "score"]
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in got.collect()} == want
    assert want[900] == want[901] == ("und", 0.0)
    assert sum(want[i][0] == x for i, _, x in rows[:600]) > 590
    total, _ = one.logs([rows[5][1]])
    c, o, _ = langid.normal_form([rows[5][1]])
    grams = [int(b) for h, _ in langid.hashed_ngrams(c, o, 1 << 10) for b in h]
    counts = defaultdict(Counter)
    for _, t, x in rows[:600]:
        cc, oo, _ = langid.normal_form([t])
        counts[x].update(int(b) for h, _ in langid.hashed_ngrams(cc, oo, 1 << 10) for b in h)
    sizes = Counter(x for _, t, x in rows if x and t is not None)
    for j, x in enumerate(langs):
        if x not in ("l002",):
            plain = math.log(sizes[x] / sum(sizes.values())) + sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * 1024)) for g in grams)
            assert total[0, j] == pytest.approx(plain, abs=1e-3)


# ---- 6: token counts


def test_resynchronised_counts_equal_whole_encodings():
    path = tokenizer_path("piece_bpe_32k.model")
    small = token_counts.PieceCounter(path, chunk=40, overlap=4, huge=30)
    rng = random.Random(3)
    atoms = ["a", "b", "the", " ", " ", "  ", "\n", "é", "梦", "😀", "ꙮ", "▁", ".", "ing", "x" * 30, "tion", "1", "\t", "<s>"]
    for _ in range(1500):
        t = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 120)))
        assert small.huge_count(t) == len(small.lib.encode(t)), t
    assert small.widened > 0


def test_count_query_and_hostile_rows(spark, sf_dir):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text.encode()), n := len(lib.encode(r.text)), n > 4096) for r in src)
    assert sorted(tuple(r) for r in QUERIES["op6_token_counts"](spark, sf_dir).collect()) == want
    d = helpers.docs(spark)
    out = token_counts.count_tokens(d)
    assert out.columns == [*(c for c in d.columns if c not in token_counts.RESULTS), *token_counts.RESULTS]
    helpers.assert_extras(out.collect(), token_counts.RESULTS)
    assert Counter((r.text, r.n_tokens) for r in out.collect()) == Counter((t, len(lib.encode(t or ""))) for _, t, *_ in helpers.rows())
    assert token_counts.count_tokens(helpers.empty(spark)).count() == 0


# ---- 7: BPE


def library_digests(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    out = []
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_bpe_query_and_hostile_rows(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r.doc_id, *d) for r, d in zip(src, library_digests([r.text for r in src]), strict=True))
    assert sorted(tuple(r) for r in QUERIES["op7_bpe_roundtrip"](spark, sf_dir).collect()) == want
    d = helpers.docs(spark)
    out = bpe.encode_decode(d)
    assert out.columns == [*(c for c in d.columns if c not in bpe.RESULTS), *bpe.RESULTS]
    helpers.assert_extras(out.collect(), bpe.RESULTS)
    texts = [t for _, t, *_ in helpers.rows()]
    assert Counter((r.text, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == Counter((t, *x) for t, x in zip(texts, library_digests(texts), strict=True))
    assert bpe.encode_decode(helpers.empty(spark)).count() == 0


def test_bpe_of_random_strings_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(4)
    atoms = ["a", "aa", "b", "The", "'s", "'re", "'", " ", "\n", "12", "É", "é", "İ", "Σ", "梦", "😀", "<|endoftext|>", "<|startoftext|>", "...", " ", " ", "_", "ing", "tion", "th", "\x00"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    texts += ["".join(rng.choice("abetsrionhl") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    got = own.encode(texts)
    for t, g, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(g[0], "<u4").tolist() == e.ids, t
        assert g[1] == lib.decode(e.ids, skip_special_tokens=False), t
    assert 0 < own.failed < own.speculated


def test_bpe_of_every_plain_code_point_equals_the_library():
    own = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    for c in map(chr, range(0xA1, 0x250)):
        texts = [c, f"a{c}b", f"{c}li", f"x{c}", f"1{c}2", f"{c}{c}{c}!", f"Text with {c}wa and A{c} in it\n{c}"]
        for t, g, e in zip(texts, own.encode(texts), own.lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(g[0], "<u4").tolist() == e.ids, t
            assert g[1] == own.lib.decode(e.ids, skip_special_tokens=False), t


def test_bpe_of_all_code_points_equals_the_library():
    """Every code point beside letters up to the end of the ideographs, and every 97th beyond, where nothing is assigned."""
    own = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    points = [c for c in [*range(0x250, 0x32400), *range(0x32400, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [" ".join(f"a{chr(c)}b" for c in points[k : k + 200]) for k in range(i, min(i + 20_000, len(points)), 200)]
        for t, g, e in zip(texts, own.encode(texts), own.lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(g[0], "<u4").tolist() == e.ids, t
            assert g[1] == own.lib.decode(e.ids, skip_special_tokens=False), t


def test_memories_are_bounded_by_bytes_on_texts_without_blanks(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBER", 1 << 18)
    monkeypatch.setattr(tokens, "REMEMBER", 1 << 18)
    rng = random.Random(6)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    texts = [han(rng.randint(50, 400)) + "。" + han(100) for _ in range(150)] + ["x" * 3000, "".join(rng.choice("abcde") for _ in range(2000))]
    texts += [" ".join(f"{rng.randrange(10**6)}w" for _ in range(300)) for _ in range(10)]
    own, byte = bpe.WordBpe(tokenizer_path("word_bpe_49k.json")), tokens.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    word_lib, byte_lib = (Tokenizer.from_file(tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for i in range(0, len(texts), 8):
        part = texts[i : i + 8]
        assert [np.frombuffer(g[0], "<u4").tolist() for g in own.encode(part)] == [e.ids for e in word_lib.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(g, "<u4").tolist() for g in byte.encode_bytes(part)] == [e.ids for e in byte_lib.encode_batch(part, add_special_tokens=False)]
        assert max(map(len, [*own.units, *own.word_ids, *byte.known, ""])) <= 64
        assert sum(map(len, own.units)) + sum(map(len, own.before)) + sum(map(len, byte.known)) < 1 << 18


# ---- 8: chat formatting


def test_chat_round_trip_of_hostile_turns(spark):
    bad = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x|>", "a<|", "<", "|>", "\n", "é😀", "", None, "<|endoftext|>", "\\n"]
    rows = [(c, n, r, bad[(c + n) % len(bad)]) for c in range(12) for n, r in enumerate(["system", "user", "assistant", "we\nird\\role", None, "assistant"])]
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (3, 2, "assistant", rows[20][3])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, tokens string").repartition(3)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    start, stop = chat.reserved("byte_bpe_50k.json")
    assert start > max(tokens.ByteBpe.shared("byte_bpe_50k.json").lib.get_vocab(with_added_tokens=True).values())
    for r in formatted.collect():
        assert r.tokens.count(start) == r.tokens.count(stop) == r.n_turns
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(1, n, ["user", "assistant"][n % 2], f"turn {n} " * 5) for n in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = by_row(chat.digests(chat.format_conversations(df)))
    parts = chat.format_conversations(df, part_tokens=50)
    assert parts.count() > 3
    assert by_row(chat.digests(parts)) == whole


# ---- 9: line de-duplication


def test_repeated_chunks_go_and_first_places_stay(spark):
    block = "\n".join(f"shared line number {i} with some words" for i in range(12))
    rows = [(i, f"own start {i} {i * 7}\n{block}\nown end {i}") for i in range(5)] + [(9, "alone\nin the world"), (10, None), (11, ""), (None, block)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, _ends string, k int").repartition(3), stats=True).collect()}
    assert got[None].text == block
    for i in range(5):
        assert got[i].text.startswith(f"own start {i}")
        assert got[i].text.endswith(f"own end {i}")
        assert got[i].removed_lines >= 5
        assert (got[i]._ends, got[i].k) == ("e", 1)
    assert (got[9].text, got[10].text, got[11].text) == ("alone\nin the world", None, "")


@pytest.mark.parametrize("words", [40, 49, 60])
def test_single_lines_are_no_chunks_and_long_ones_are_runs(spark, words):
    passage = " ".join(f"w{i}" for i in range(words))
    rows = [(1, f"a one\n{passage}\nb one"), (2, f"a two\n{passage}\nb two"), (3, "x\ny\nz"), (4, "x\ny\nz"), (4, "x\ny\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect())
    assert got[:3] == rows[:3]
    assert got[3] == got[4] and len(got[3][1]) < 5
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df, run_words=50).collect())
    assert got[:2] == [rows[0], (2, "a two\nb two") if words > 50 else rows[1]]


def test_line_dedup_hostile(spark):
    d = helpers.docs(spark)
    for run_words in (None, 50):
        out = linededup.dedup_lines(d, run_words=run_words)
        assert out.columns == d.columns
        rows = out.collect()
        assert len(rows) == len(helpers.ROWS)
        helpers.assert_extras(rows)
        more = linededup.dedup_lines(d, stats=True, run_words=run_words)
        assert more.columns == [*(c for c in d.columns if c != "removed_lines"), "removed_passages", "removed_lines"]
        helpers.assert_extras(more.collect(), ("removed_lines",))
        assert linededup.dedup_lines(helpers.empty(spark), run_words=run_words).count() == 0


def wrapped_passages(lines, n=40):
    """Pairs of documents: a passage of 60 words over so many lines, each time between fresh lines."""
    rng, rows = random.Random(lines), []
    fresh = lambda: "\n".join(" ".join(f"f{rng.randrange(10**9)}" for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 6)))
    for i in range(n):
        words = [f"p{lines}x{i}x{j}" for j in range(60)]
        cut = [0, *sorted(rng.sample(range(5, 56), lines - 1)), 60]
        passage = "\n".join(" ".join(words[a:b]) for a, b in zip(cut, cut[1:], strict=False))
        for later in (0, 1):
            head, tail = fresh(), fresh()
            rows.append((1000 * later + i, f"{head}\n{passage}\n{tail}", f"{head}\n{tail}" if later else f"{head}\n{passage}\n{tail}"))
    return rows


@pytest.mark.parametrize("lines", [2, 3, 4, 5, 6, 12])
def test_wrapped_passages_go_whatever_stands_around_them(spark, lines):
    import corpus_pipeline as p

    rows = wrapped_passages(lines)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in p.line_dedup(spark, df, "").collect()}
    assert got == {i: want for i, _, want in rows}


def brute_gone(rows, words=50, chunks=True):
    """Lines that go, by row: every chunk and every shortest run of more words is looked up among all that stood before."""
    rows = sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, np.uint64(xxhash.xxh64_intdigest((x[1][1] or "").encode(), 42)).astype(np.int64)))
    first, places = {}, []
    for at, (d, t) in rows:
        if t is None:
            continue
        lines = t.split("\n")
        w = [len(x.split(" ")) if x.strip(" \t\r") else 0 for x in lines]
        found = set()
        if chunks:
            m = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
            roll = [4294967291] + [(31 * a + b) % 4294967291 for a, b in zip(m, m[1:], strict=False)]
            start = 0
            for i in range(len(lines)):
                if i == len(lines) - 1 or (i and roll[i] < roll[i - 1] and roll[i] < roll[i + 1]):
                    if i > start and sum(w[start : i + 1]):
                        found.add((start, i))
                    start = i + 1
        for a in range(len(lines)):
            if words is not None and w[a]:
                on = next((b for b in range(a, len(lines)) if sum(w[a : b + 1]) > words), None)
                back = next((b for b in range(a, -1, -1) if sum(w[b : a + 1]) > words), None)
                found |= {(a, on)} if on is not None else set()
                found |= {(back, a)} if back is not None else set()
        for s, e in sorted(found):
            places.append((at, (d, t), s, e, "\n".join(lines[s : e + 1])))
            first.setdefault(places[-1][4], ((d, t), s, e))
    gone = defaultdict(set)
    for at, doc, s, e, text in places:
        f = first[text]
        gone[at].update(range(max(s, f[2] + 1) if f[0] == doc else s, e + 1))
    return gone


def brute_texts(rows, **how):
    gone = brute_gone(rows, **how)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[at]) for at, (_, t) in enumerate(rows)]


def mixed_rows():
    rng = random.Random(9)
    pool = [" ".join(f"w{i}" for i in range(rng.choice([1, 4, 11, 30, 48, 49, 50, 70]))) + f" z{n}" for n in range(12)] + ["", "  ", " \t"]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {d} {rng.random()}" for _ in range(rng.randint(1, 14)))) for d in range(60)]
    rows += [(70, "\n".join(["same line again and again"] * 40)), (71, ""), (72, None), (None, rows[3][1]), (None, None), (5, rows[5][1]), (5, rows[6][1])]
    return rows


@pytest.mark.parametrize("words", [None, 50, 7])
def test_line_dedup_against_brute_force(spark, words):
    rows = mixed_rows()
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _ends string").repartition(3)
    got = linededup.dedup_lines(df, stats=True, run_words=words).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for (d, _), t in zip(rows, brute_texts(rows, words=words), strict=True))
    gone = brute_gone(rows, words=words)
    assert sum(r.removed_lines for r in got) == sum(map(len, gone.values())) > 0
    kept = {x for r in got if r.text is not None for x in r.text.split("\n")}
    assert all(x in kept for _, t in rows if t for x in t.split("\n") if x.strip())


def test_texts_of_very_many_lines(spark):
    n = 60_000
    lines = [f"line {i} of a long text, with a few words" for i in range(n)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines[1000:] + ["end"])), (3, "\n".join(["x"] * n))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, run_words=50).collect()}
    assert (got[1], got[2]) == (rows[0][1], "new\nend")
    assert 0 < len(got[3]) < len(rows[2][1])


@pytest.mark.parametrize("hashes", [1, 2, 40])
def test_true_repeats_go_even_if_hashes_collide(spark, monkeypatch, hashes):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(tuple, linededup.dedup_lines(df, run_words=50).collect()))
    assert want != Counter(rows)
    monkeypatch.setattr(linededup, "LINE_HASH", f"pmod(xxhash64(x), {hashes})")
    assert Counter(map(tuple, linededup.dedup_lines(df, run_words=50).collect())) == want


# ---- pipeline


def plain_bayes(train, texts):
    """Naive Bayes over hashed n-grams, in whole numbers and dictionaries."""

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = " " + " ".join(t.split()) + " " if t.split() else " "
        for k in range(1, 5):
            for i in range(len(t) - k + 1):
                if t[i : i + k] != " ":
                    h = 0
                    for c in t[i : i + k]:
                        h = (h * 0x100000001B3 + ord(c)) % 2**64
                    yield ((h ^ k) * 0x9E3779B97F4A7C15 % 2**64) >> 48

    counts, sizes = defaultdict(Counter), Counter()
    for t, x in train:
        counts[x].update(grams(t))
        sizes[x] += 1
    sums = {x: sum(counts[x].values()) + 0.5 * 65536 for x in sizes}
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        g = Counter(grams(t))
        logs = {x: math.log(sizes[x] / sum(sizes.values())) + sum(n * math.log((counts[x][b] + 0.5) / sums[x]) for b, n in g.items()) for x in sorted(sizes)}
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    from .test_pairs import brute_fingerprint, closure

    fixture = helpers.docs(spark)
    rng = random.Random(12)
    shared = [" ".join(rng.choice(["river", "stone", "cloud", "ember", "maple"]) + str(rng.randrange(50)) for _ in range(60)) for _ in range(3)]
    extra = [(20 + i, f"the line about topic {i}\nanother one {i * i}\nand a last line {i * 3}" + (f"\n{shared[i % 3]}" if i % 4 == 0 else ""), "en", "s") for i in range(30)]
    extra += [(60 + i, "der alte Mann geht langsam durch den dunklen Wald und sucht seinen Hund " * 6 + f"Nummer {i // 2}", "de", "s") for i in range(6)]
    docs = fixture.unionByName(spark.createDataFrame([(*r, None, *helpers.EXTRA.values(), *helpers.RESULTS.values()) for r in extra], fixture.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "best_fit_packing"]
    stage, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    rows = [(r.doc_id, r.text, r.lang) for r in stage.collect()]
    for name, f in p.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(stage.collect())
        helpers.assert_extras(seen[-1])
    # language ID
    train = [(t, x) for d, t, x in rows if t is not None and x is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2)]
    known = [(d, t) for (d, t, _), (x, s) in zip(rows, plain_bayes(train, [t for _, t, _ in rows]), strict=True) if x != "und" and s >= 0.5]
    assert Counter((r.doc_id, r.text) for r in seen[0]) == Counter(known)
    assert 20 < len(known) < len(rows)
    # lines
    left = [(d, t) for (d, _), t in zip(known, brute_texts(known), strict=True) if t]
    assert Counter((r.doc_id, r.text) for r in seen[1]) == Counter(left)
    assert all(r.n_chars == len(r.text) for r in seen[1])
    assert sum(len(t or "") for _, t in left) < sum(len(t or "") for _, t in known)
    # one of each group
    prints = [brute_fingerprint(t) for _, t in left]
    uniq = sorted(set(prints))
    group = closure(uniq, [(a, b) for i, a in enumerate(uniq) for b in uniq[:i] if (a ^ b).bit_count() <= 2])
    best = {}
    for (d, t), f in zip(left, prints, strict=True):
        best.setdefault(group[f], []).append((d is None, d or 0, d, t))
    want = {min(v, key=lambda x: x[:2])[2:] for v in best.values()}
    assert {(r.doc_id, r.text) for r in seen[2]} == want and len(seen[2]) == len(want) < len(left)
    # sequences
    check_packing([(r.doc_id, r.text) for r in seen[2]], p.run(spark, str(tmp_path)).collect())
