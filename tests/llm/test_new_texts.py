"""Operators 11, 12 and 13."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import periodic, phrases, warc
from brindle.llm.queries import ORACLE_SQL, QUERIES

from . import helpers


# ---- 13: periodic runs


def plain_runs(words):
    """By definition: stretches in which words q apart agree, as long as they go, without those of a smaller period."""
    out, ids = [], np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0)
    for q in range(1, len(words) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            run = words[i : j + q]
            if len(run) >= max(6, 4 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[0] is not None and 1000 * best[1] // best[2] or None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


def test_runs_of_random_texts():
    rng = random.Random(13)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(8)):
            letters, words = "abcdefghij"[: rng.randint(1, 10)], []
            while len(words) < rng.randrange(90):
                unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
                words += unit * rng.choice((1, 1, 2, 4, 7)) + unit[: rng.randint(0, len(unit))]
            texts.append(words)
        size, runs, kept = periodic._runs_of([" ".join(t).encode() for t in texts])
        assert size.tolist() == [len(t) for t in texts]
        for words, found, rest in zip(texts, runs.to_pylist(), kept, strict=True):
            want = plain_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in found] == want
            gone = {i for s, length, q in want for i in range(s + q, s + length)}
            assert rest.decode().split() == [w for i, w in enumerate(words) if i not in gone]


def test_levels_end_and_huge_texts_stay_near_linear():
    for text, want in ((b"a " * 100_000, [(0, 100_000, 1)]), (b"a b c d e f g " * 20_000 + b"x", [(0, 140_000, 7)]), (b" ".join(b"%d" % i for i in range(100_000)), [])):
        _, runs, _ = periodic._runs_of([text])
        assert [(r["start"], r["length"], r["period"]) for r in runs.to_pylist()[0]] == want
    words = np.arange(1000)
    assert periodic.block_names(words, np.full(1000, 1000)) == []


def test_equal_stretches_of_two_texts_are_no_run():
    _, runs, _ = periodic._runs_of([b"a b a b a b", b"a b a b a b"])
    assert runs.to_pylist() == [[], []]  # six words, but not four times the period; eight would be
    _, runs, _ = periodic._runs_of([b"x a b a b a b a b"])
    assert runs.to_pylist() == [[{"start": 1, "length": 8, "period": 2}]]


def test_periodic_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    got = [r.asDict() for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(want, key=key) and any(r["n_runs"] for r in want)


def test_periodic_runs_of_hostile_rows(spark):
    df = helpers.docs(spark)
    got = periodic.find_runs(df).collect()
    helpers.assert_extras(got)
    assert len(got) == len(helpers.ROWS)
    for r in got:
        words = (r.text or "").encode().split()
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == plain_runs(words)
    rows = [r.asDict() for r in periodic.digests(periodic.find_runs(periodic.made_periodic(df))).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(plain_row(r[0], r[1])) for r in helpers.ROWS)
    assert periodic.find_runs(helpers.empty(spark)).count() == 0
    assert periodic.digests(periodic.find_runs(periodic.made_periodic(helpers.empty(spark)))).count() == 0


# ---- 12: WARC archives

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (3, "http://a/3", BIG), (9, None, BIG), (None, "http://none", BIG), (1, "http://a/1", None), (2, "http://a/2", ""),
    (4, "http://ä/\r\n x?y=%20", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50), (11, "u", "x" * 99), (12, "u", "x" * 99), (-7, "u", "ends\r\n\r\nWARC/1.1\r\n"), (10, "u", BIG + " 😀 梦 \0"), (13, "u", "long " * 500_000),
]


def plain_pages(rows):
    by = {}
    for i, _, t in rows:
        raw = (t or "").encode()
        if len(raw) >= 100 and i is not None:
            by[raw] = min(i, by.get(raw, i))
    for i, _, t in rows:
        raw = (t or "").encode()
        first = by.get(raw)
        again = first is not None and first != i
        yield (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)


def test_pages_through_archives(spark):
    df = spark.createDataFrame([(*r, "own", 3) for r in PAGES], "page_id long, url string, html string, digest string, key int").repartition(3)
    got = warc.through_archives(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_pages(PAGES)))
    assert warc.through_archives(df.limit(0)).count() == 0


def test_hot_and_other_copies_get_one_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    rows = [(i, "u", "y" * (100 + i % 20 if i % 3 else 100)) for i in range(600)]
    got = warc.payload_roles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.id, r.refers_to) for r in got.collect()) == sorted((r[0], r[4]) for r in plain_pages(rows))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_archives_are_members_with_an_index_and_strays_go(spark, tmp_path):
    whole, parted = f"file://{tmp_path}/whole", f"file://{tmp_path}/parted"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    wrote = warc.write_archives(warc.payload_roles(df), whole, archive_bytes=1)
    assert wrote.count() > 2 and sum(r.records for r in wrote.collect()) == len(PAGES)
    for r in wrote.collect():
        lib = zlib.decompressobj(31)
        lib.decompress((tmp_path / "whole" / r.path).read_bytes())
        assert lib.eof and not lib.unused_data  # one stream
    (tmp_path / "whole" / "lost.warc.gz").write_bytes(b"half")
    assert warc.sweep(wrote, whole) == 1 and warc.listed(spark, whole).count() == wrote.count()
    done = warc.normalise(warc.listed(spark, whole), whole, parted)
    assert not done.where("error is not null").count() and sum(r.records for r in done.collect()) == len(PAGES)
    index = warc.read_index(spark, parted)
    for r in index.collect():
        raw = (tmp_path / "parted" / r.path).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: " + r.type.encode())
    for r in done.collect():
        assert gzip.decompress((tmp_path / "parted" / r.path).read_bytes()) == gzip.decompress((tmp_path / "whole" / r.source).read_bytes())
    some = warc.read_records(index.where("type = 'response'"), parted).collect()
    assert all(r.intact for r in some) and sorted(bytes(r.payload) for r in some) == sorted((t or "").encode() for (_, _, t), x in zip(PAGES, plain_pages(PAGES), strict=True) if x[3] == "response")
    assert {r.uri for r in some} >= {"http://%C3%A4/%0D%0A%20x?y=%20"}


def test_torn_archives_keep_what_is_whole():
    records = [warc.record(str(i), "u", b"p" * i * 1000, hashlib.sha256(b"p" * i * 1000).hexdigest(), None, "1970-01-01T00:00:00Z") for i in range(40)]
    text = b"".join(records)

    def run(raw):
        out, lines = io.BytesIO(), io.BytesIO()
        got = warc.normalised(io.BytesIO(raw), out, lines)
        return got, gzip.decompress(out.getvalue()) if out.getvalue() else b"", lines.getvalue().count(b"\n")

    assert run(gzip.compress(text)) == ((40, run(gzip.compress(text))[0][1], None), text, 40)
    parts = gzip.compress(text[:5000]) + gzip.compress(text[5000:]) + bytes(100)
    assert run(parts)[1:] == (text, 40)  # any members will do, and padding
    assert run(b"")[0] == (0, 0, None)
    full = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = full.compress(text) + full.flush()
    for cut in (1, 10, 500, 20_000, len(raw) - 9):
        (n, _, wrong), kept, lines = run(raw[:cut])
        assert kept == b"".join(records[:n]) and lines == n and wrong
    for bad in (text + b"rest", b"junk\r\n\r\n" + text, text.replace(b"Content-Length: 1", b"Content-Length: x", 2), b"no gzip"):
        (n, _, wrong), kept, _ = run(gzip.compress(bad) if bad != b"no gzip" else bad)
        assert wrong and kept == b"".join(records[:n])


# ---- 11: phrase collocations


def plain_phrases(rows, min_count, max_words, top=2000):
    """By definition, from ``(text, lang)``."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= min_count}
        gone = {g[o : o + m] for g, a in often.items() for m in range(2, len(g)) for o in range(len(g) - m + 1) if 100 * a >= 80 * counts[g[o : o + m]]}
        rows = []
        for g, a in often.items():
            if g not in gone:
                score, _, left, right = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("max_words", "block"), [(4, 16 << 20), (4, 300), (3, 40), (2, 1), (5, 150)])
def test_phrases_against_brute_force(spark, monkeypatch, max_words, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "RANGE_ROWS", 50)
    rng = random.Random(block)
    vocab = [*"ABCdefgh", "né", "x\x01", "x", "\x1f", "\x85", "梦", "long" * 20]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(vocab[: rng.randint(1, len(vocab))]) if rng.random() < 0.9 else f"once{rng.random()}")
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?", " \r "]) for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "xx"), (" . ; ", "only breaks"), ("a b c d " * 200, "en"), ("word", None)]
    df = spark.createDataFrame([(*r, i, "own", "own") for i, r in enumerate(rows)], "text string, lang string, key int, word string, rank string").repartition(3)
    for least in (3, 8):
        assert phrase_rows(phrases.collocations(df, min_count=least, max_words=max_words)) == plain_phrases(rows, least, max_words)


def test_phrases_first_of_each_language_and_none(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SALTS", 3)
    rows = [(f"p{i} q{i}. " * (3 + i % 4), lang) for i in range(40) for lang in ("en", "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = phrase_rows(phrases.collocations(df, min_count=3, top=7))
    assert got == plain_phrases(rows, 3, 4, top=7) and len(got) == 14
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df, min_count=1000).count() == 0
    helper = spark.createDataFrame([(r[1], r[2]) for r in helpers.ROWS], "text string, lang string")
    assert phrase_rows(phrases.collocations(helpers.docs(spark), min_count=3)) == phrase_rows(phrases.collocations(helper, min_count=3)) == plain_phrases([(r[1], r[2]) for r in helpers.ROWS], 3, 4)


def test_radix_order_is_byte_order():
    rng = np.random.default_rng(3)
    keys = np.zeros((5000, 4), ">u4")
    keys[:, :3] = rng.integers(0, 3, (5000, 3)) * rng.integers(1, 1 << 30, (5000, 3))
    raw = keys.view(np.uint8).reshape(5000, 16)
    assert [bytes(r) for r in raw[phrases.radix_order(raw)]] == sorted(bytes(r) for r in raw)
    assert len(phrases.radix_order(raw[:0])) == 0


@pytest.mark.parametrize("name", ["op11_phrases", "op12_warc", "op13_periodic_runs"])
def test_new_queries_match_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(repr, want.fetchall()))
