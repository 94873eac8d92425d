"""The index engine: scoring, search, extraction, scanning, maintenance, snapshots, protocol, service and replay."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.__main__ import arguments, main
from brindle.functions import extension, lenient_json, normal_path, score, score_column
from brindle.functions.score import contains_subsequence, with_score
from brindle.model import DECLARATIONS, FILES, QUERY_TIMEOUT
from brindle.operators import extract, ignore, maintain
from brindle.plans import batch_search, compile_query, keys, search, topk
from brindle.sources import log, shared, snapshot, tree
from brindle.streaming import protocol, replay, service


def model_score(name, pattern):
    """The rules of the score, byte by byte."""
    n, p = name.encode(), pattern.encode()
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    if not p:
        return 0
    if len(p) > len(n):
        return None
    if low(n) == low(p):
        return 1000
    if low(n).startswith(low(p)):
        return 500 + max(0, 100 - (len(n) - len(p)))
    total, j, last = 0, 0, None
    for i, c in enumerate(n):
        if j < len(p) and low(bytes([c])) == low(p[j : j + 1]):
            total += 10 * (last is not None and i == last + 1) + 5 * (c == p[j])
            total += 20 * (i == 0 or n[i - 1] in b"_:" or (97 <= n[i - 1] <= 122 and 65 <= c <= 90))
            last, j = i, j + 1
    return max(1, total - len(n) // 4) if j == len(p) else None


@pytest.mark.parametrize(
    ("name", "pattern", "want"),
    [("foo", "foo", 1000), ("fooBar", "foo", 597), ("fooBarBaz", "foo", 594), ("isReady", "iR", 49), ("bar::size", "bs", 48), ("FooBarBaz", "FB", 48), ("FooBarBaz", "fb", 38), ("get_size", "gs", 48), ("gaps", "gs", 29), ("abc", "abcd", None)],
)
def test_model_of_the_score(name, pattern, want):
    assert model_score(name, pattern) == want


def test_scores_match_the_model(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("aAbBc_:é") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["x'\"\\y", "fooBär", "a.b*c"]
    patterns = ["", "a", "aB", "b_c", "A:b", "abc", "cab", "é", "'", "\\", ".*", "aaaa", "ab" * 26]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for p in patterns:
        want = [model_score(n, p) for n in names]
        got = df.select("name", score("name", p).alias("s"), contains_subsequence("name", p).alias("c")).collect()
        assert [r.s for r in got] == want, p
        assert [r.c for r in got] == [w is not None for w in want], p
        assert [r.score for r in with_score(df, p).select("name", "score").collect()] == want, p
    both = spark.createDataFrame([(n, p) for n in names for p in patterns], "n string, p string")
    assert all(r.s == model_score(r.n, r.p) for r in both.select("n", "p", score_column("n", "p").alias("s")).collect())


@settings(max_examples=200, deadline=None)
@given(st.text("ab/. \\", max_size=12), st.sampled_from(["enum", "Class", "STRUCT"]))
def test_query_text(text, kind):
    spec = compile_query(f"{text} {kind}")
    parts = [t for t in text.split(" ") if t]
    assert spec.kind == kind.lower()
    assert spec.file == "".join(t for t in parts if set(t) & set("/\\."))
    assert spec.name == "".join(t for t in parts if not set(t) & set("/\\."))


def test_search_orders_limits_and_quirks(spark):
    rows = [("foo", "function", "b.cpp", 3, 0), ("foo", "class", "a.cpp", 9, 1), ("fooBar", "function", "a.cpp", 1, 2), ("xfoo", "macro", "dir/c.h", 1, 3), (None, "macro", "dir/c.h", 1, 4)]
    df = spark.createDataFrame(rows, "name string, kind string, file string, line int, ord long")
    assert [(r.name, r.file) for r in search(df, "foo").collect()] == [("foo", "a.cpp"), ("foo", "b.cpp"), ("fooBar", "a.cpp"), ("xfoo", "dir/c.h")]
    assert len(search(df, "foo", 2).collect()) == 2
    assert [r.name for r in search(df, "struct foo class").collect()] == ["foo"]
    assert search(df, "").count() == 0
    assert search(df, " ").count() == 5
    assert search(df, "dch.h").count() == 0
    assert search(df, "d.h").count() == 2
    plan = search(df, "fo class")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "Python" not in plan


def test_unrolled_score_plan_grows_linearly(spark):
    df = spark.createDataFrame([("the_long_name_of_it", "macro", "f.c", 1, 0)], "name string, kind string, file string, line int, ord long")
    for p in ("tlnoi", "thelongnameofi"):
        assert search(df, p).collect()[0].score == model_score("the_long_name_of_it", p)


#: Files of our own, each with several constructs, and what is reported of them in order.
CASES = {
    "a cache with a forward declaration, a nested type and members": (
        """
        class Evictor;
        namespace store {
        struct Slot { unsigned long key; char payload[16]; };
        class Cache final : public Base {
            enum Policy : char { Oldest, Rarest };
            static constexpr int kWays = 8;
            Evictor* evictor_ = nullptr;
        public:
            explicit Cache(int ways) : evictor_(nullptr) { reset(); }
            ~Cache();
            Slot* find(unsigned long key) const;
            bool insert(Slot slot), full() const noexcept;
        };
        }
        """,
        [("Slot", "struct"), ("Cache", "class"), ("Policy", "enum"), ("Cache", "function"), ("~Cache", "function"), ("insert", "function")],
    ),
    "members defined outside, with locals of all sorts": (
        """
        store::Cache::~Cache() { long lost = 0; static int calls; constexpr unsigned kMask = 7u; (void)lost; }
        bool store::Cache::insert(Slot slot) { for (int way = 0; way < 8; ++way) { if (probe(way)) return true; } return false; }
        """,
        [("store::Cache::~Cache", "function"), ("kMask", "variable"), ("store::Cache::insert", "function")],
    ),
    "globals: several in one line, pointers, arrays, references": (
        """
        unsigned hits, misses = 0, *latest = &hits;
        static const double kRatio{0.75};
        char* banner = "a;b{c}";
        long table[64];
        char** lines;
        int& alias = misses;
        extern int elsewhere;
        """,
        [("hits", "variable"), ("misses", "variable"), ("latest", "variable"), ("kRatio", "variable"), ("banner", "variable"), ("elsewhere", "variable")],
    ),
    "templates of every sort in one file": (
        """
        template <typename K, typename V = int> struct Pair { K k; V v; };
        template <class... Ts> class Bundle : Ts... { };
        template <typename N> constexpr N clamp(N x, N lo, N hi);
        template <> struct Pair<char, char> { };
        template <class T> using Ref = T&;
        template <typename T> requires Small<T> T twice(T t) { return t + t; }
        """,
        [("Pair", "struct"), ("Bundle", "class"), ("clamp", "function"), ("Ref", "alias"), ("twice", "function")],
    ),
    "aliases and typedefs, also those that are passed over": (
        """
        using Clock = steady_clock;
        using std::swap;
        typedef unsigned char Octet;
        typedef Octet* OctetPtr;
        typedef void (*Handler)(int);
        typedef struct { int a; } Anonymous;
        typedef enum Tone { Low, High } ToneAlias;
        """,
        [("Clock", "alias"), ("Octet", "typedef"), ("Anonymous", "typedef"), ("Tone", "enum"), ("ToneAlias", "typedef")],
    ),
    "macros beside conditions and comments": (
        """
        #ifndef GUARD_H
        #  define GUARD_H
        #define LOG(level, text) \\
            do { emit(level, text); } while (0)
        // #define COMMENTED 1
        /* #define NEITHER 2
           struct Ghost { }; */
        #undef LOG
        #endif
        """.replace("\\\\", "\\"),
        [("GUARD_H", "macro"), ("LOG", "macro")],
    ),
    "strings and characters that look like code": (
        """
        const char* page = R"html(<script>function f() { class Z { }; }</script>)html";
        char quote = '"', brace = '{';
        const char* both = "/* not a comment */ struct Y { };";
        void after();
        """,
        [("page", "variable"), ("quote", "variable"), ("brace", "variable"), ("both", "variable"), ("after", "function")],
    ),
    "names behind pointers and references, and a pointer to a function": (
        """
        Node* next(Node* n);
        Node& front();
        double (*curve)(double, double);
        auto size() -> unsigned long;
        [[nodiscard]] int checked(void);
        """,
        [("(*curve)", "function"), ("size", "function"), ("checked", "function")],
    ),
    "a class behind an export macro is read as a body": (
        """
        struct SHARED_EXPORT Window : Widget {
            int width = 3;
            void show();
            virtual bool close(int reason) = 0;
        };
        """,
        [("show", "function"), ("close", "function")],
    ),
    "enums, forward and scoped, and what has no name or is no declaration": (
        """
        enum struct Axis : short;
        enum Colour { Red, Green };
        enum { Nameless };
        union Bits { float f; unsigned u; };
        using namespace store;
        static_assert(sizeof(int) == 4, "int");
        """,
        [("Axis", "enum"), ("Colour", "enum")],
    ),
    "linkage, operators and bodies after other functions": (
        """
        extern "C" { void c_entry(void); int c_count; }
        extern "C" int c_single(int);
        Vec operator+(Vec a, Vec b) { return Vec{a.x + b.x}; }
        bool Vec::operator==(const Vec& o) const { auto same = [&](int i) { return i == o.x; }; return same(x); }
        int outer() { struct Local { int v; }; int inner(int); return inner(1); }
        """,
        [("c_entry", "function"), ("c_count", "variable"), ("c_single", "function"), ("operator+", "function"), ("Vec::operator==", "function"), ("outer", "function"), ("Local", "struct"), ("inner", "function")],
    ),
    "nothing": ("  \n// only a comment", []),
}


@pytest.mark.parametrize("source", list(CASES))
def test_extraction(source):
    text, want = CASES[source]
    assert [(n, k) for n, k, *_ in extract.scan(text.encode())] == want


def test_what_lies_too_deep_is_not_reported():
    deep = "".join(f"namespace level{i} {{ " for i in range(7))
    assert [n for n, *_ in extract.scan(f"{deep}void seen();{' }' * 7}".encode())] == ["seen"]
    assert [n for n, *_ in extract.scan(f"{deep}namespace level7 {{ void unseen(); }}{' }' * 7}".encode())] == []


def test_lines_offsets_and_bytes():
    got = extract.scan("// é\n\nvoid foo() {}\nvoid bär() {}\n".encode())
    assert [(n, line) for n, _, line, _, _ in got] == [("foo", 3), ("bär", 4)]


@settings(max_examples=150, deadline=None)
@given(st.text("{}()<>;:=,*& \n#\"'/abclass struct enum", max_size=60))
def test_the_scanner_survives_anything(text):
    extract.scan(text.encode())


def test_paths_and_extensions(spark):
    rows = [("a/x.cpp", "cpp"), ("dir/.cpp", ""), (".hidden.h", "h"), ("X.HPP", "HPP"), ("noext", ""), ("a.b/c", "")]
    df = spark.createDataFrame(rows, "p string, want string")
    assert all(r.e == r.want for r in df.select("want", extension("p").alias("e")).collect())
    assert [tree.file_extension(os.path.basename(p)) for p, _ in rows] == [w for _, w in rows]
    raw = spark.createDataFrame([("./././a",), ("b\\c",)], "p string")
    assert [r.n for r in raw.select(normal_path("p").alias("n")).collect()] == ["././a", "b/c"]


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_scanning_a_tree(spark, tmp_path):
    write(tmp_path, {"main.cpp": "", "util.hpp": "", "sub/deep/d.cc": "", "README.md": "", ".hidden.cpp": "", "_x.h": "", "sub/.cpp": "", "X.HPP": "", "build/g.cpp": "", "build_release/h.cpp": "", "vendor/huge.c": ""})
    (tmp_path / "link").symlink_to(tmp_path / "sub", target_is_directory=True)
    rules = "# c\r\nbuild/*\r\n\nvendor/huge.c"
    got = {r.path for r in tree.read_tree(spark, str(tmp_path), ignore=rules, batch="2").collect()}
    assert got == {"main.cpp", "util.hpp", "sub/deep/d.cc", ".hidden.cpp", "_x.h", "build_release/h.cpp"}
    twice = tree.read_tree(spark, str(tmp_path), ["sub", "sub/deep"], content=False).collect()
    assert [r.path for r in twice] == ["sub/deep/d.cc"] * 2
    assert twice[0].mtime_ns == os.stat(tmp_path / "sub/deep/d.cc").st_mtime_ns
    assert twice[0].content is None
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0
    assert tree.list_tree(str(tmp_path), ()) == []
    for fan in ("1", "2", "3", "99"):
        assert {r.path for r in tree.read_tree(spark, str(tmp_path), ignore=rules, fan=fan).collect()} == got
    scan_relative = tree.read_tree(spark, str(tmp_path), ["build"], ignore="g.cpp", ignore_from="scan").collect()
    assert scan_relative == []


def test_ignore_rules():
    rules = ignore.parse_rules("build/*\r\n./a\\b.c\n# x\n\nlast")
    assert [(r.pattern, r.is_glob) for r in rules] == [("build/", True), ("a/b.c", False), ("last", False)]
    assert ignore.parse_rules("") == []


def test_maintenance_with_repeated_inputs(spark):
    rec = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], FILES)
    cur = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4), ("d", 4)], FILES)
    assert sorted(r.path for r in maintain.removed(rec, cur).collect()) == ["c"]
    assert sorted(r.path for r in maintain.changed(rec, cur).collect()) == ["b", "d", "d"]
    assert sorted(r.path for r in maintain.evicted(rec, cur).collect()) == ["b", "c", "d"]
    assert tuple(maintain.delta_counts(rec, cur).first()) == (1, 2, 3, 1)
    assert sorted(tuple(r) for r in maintain.upserted(rec, cur).collect()) == [("a", 1), ("b", 9), ("c", 3), ("d", 4)]


def names(index):
    return sorted(r.name for r in index.declarations.collect())


def test_index_life(spark, tmp_path):
    write(tmp_path, {"a.cpp": "void alpha() {}", "b.cpp": "void beta() {}\nint two = 2;", "c.cpp": "class Gone {};"})
    index = service.Index(spark, str(tmp_path))
    assert index.search("alpha") == []
    index.start()
    assert (index.ready, index.dirty, index.n_files) == (True, False, 3)
    assert names(index) == ["Gone", "alpha", "beta", "two"]
    assert [r.ord for r in index.declarations.orderBy("ord").collect()] == [0, 1, 2, 3]
    index.refresh()
    assert not index.dirty
    os.remove(tmp_path / "c.cpp")
    write(tmp_path, {"b.cpp": "void better() {}", "d.cpp": "#define DELTA 1"})
    os.utime(tmp_path / "b.cpp", ns=(1, 1))
    index.refresh()
    assert index.dirty
    assert names(index) == ["DELTA", "alpha", "better"]
    assert index.declarations.orderBy("ord").first().name == "alpha"
    index.save()
    write(tmp_path, {"a.cpp": "void changed() {}"})
    assert index.refresh_file("a.cpp")
    assert names(index) == ["DELTA", "better", "changed"]
    os.remove(tmp_path / "d.cpp")
    assert not index.refresh_file(str(tmp_path / "d.cpp"))
    again = service.Index(spark, str(tmp_path))
    again.start()
    assert names(again) == ["alpha", "better"]
    assert not again.dirty
    os.remove(tmp_path / "b.cpp")
    assert again.prune() == 1
    assert again.dirty
    assert snapshot.delete(spark, again.cache_dir)
    assert not snapshot.delete(spark, again.cache_dir)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, again.cache_dir)
    assert again.slowest() == []


def test_json_snapshots(spark, tmp_path):
    write(tmp_path, {"v1": '{"version":1,"foreign":[{"n":"old","k":"function","f":"o.cpp","l":7}]}', "bad": "not json", "v9": '{"version":999,"declarations":[]}', "none": '{"version":2,"files":[]}', "empty": '{"version":2,"declarations":[],"files":[]}'})
    d, f = snapshot.import_json(spark, str(tmp_path / "v1"), "foreign")
    assert [tuple(r) for r in d.collect()] == [("old", "function", "o.cpp", 7, 0)]
    assert f.count() == 0
    assert snapshot.import_json(spark, str(tmp_path / "empty"))[0].count() == 0
    for bad in ("bad", "v9", "none"):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.import_json(spark, str(tmp_path / bad))
    rows = spark.createDataFrame([("q\"x\n", "macro", "é.h", 3, 0)], d.schema)
    snapshot.export_json(str(tmp_path / "parts"), rows, spark.createDataFrame([("é.h", 5)], FILES))
    snapshot.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "out"))
    assert json.loads((tmp_path / "out").read_text()) == {"version": 2, "declarations": [{"n": 'q"x\n', "k": "macro", "f": "é.h", "l": 3}], "files": [{"p": "é.h", "m": 5}]}
    for where in ("out", "parts"):
        back, files = snapshot.import_json(spark, str(tmp_path / where))
        assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows.collect()]
        assert files.first().mtime_ns == 5


def test_json_snapshots_of_many_parts(spark, tmp_path, monkeypatch):
    from brindle.sources import json_snapshot

    monkeypatch.setattr(json_snapshot, "PART_ROWS", 20)
    rows = [(f"n{i}", "macro", "f.h", i, i) for i in range(100)]
    files = [(f"p{i:03d}", i) for i in range(50)]
    snapshot.export_json(str(tmp_path / "many"), spark.createDataFrame(rows, DECLARATIONS), spark.createDataFrame(files, FILES))
    assert len([f for f in os.listdir(tmp_path / "many") if f.endswith(".json")]) >= 9
    d, f = snapshot.import_json(spark, str(tmp_path / "many"))
    assert sorted(map(tuple, d.collect())) == sorted(rows) and sorted(map(tuple, f.collect())) == files


@pytest.mark.parametrize("split", [150, 700, 1 << 20])
def test_json_snapshots_are_read_in_splits_of_any_size(spark, tmp_path, split):
    rng = random.Random(split)
    text = lambda: "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", "\n", "}}", '\\"', " "]) for _ in range(rng.randrange(12)))
    rows = [{"n": text(), "k": rng.choice(["enum", "what", "macro"]), "f": text(), "l": i} | ({"x": {"y": [text(), {"z": text()}]}} if rng.random() < 0.2 else {}) for i in range(80)]
    files = [{"p": text(), "m": i} for i in range(rng.choice([0, 30]))]
    for document in ({"version": 2, "declarations": rows, "files": files}, {"meta": {"a}": {"b": "}"}}, "files": files, "none": [], "declarations": rows, "k}[": 1.5, "version": 2}, {"version": 2, "declarations": [], "files": files}):
        for k, indent in enumerate((None, 1)):
            path = tmp_path / f"{len(document)}{k}{len(document['declarations'])}"
            path.write_text(json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=indent) + "\n" * rng.randrange(2))
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            try:
                d, f = snapshot.import_json(spark, str(path))
                got, files_got = sorted(d.collect(), key=lambda r: r.ord), f.collect()
                tasks = d.rdd.getNumPartitions()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert [(r.name, r.kind, r.file, r.line, r.ord) for r in got] == [(r["n"], r["k"] if r["k"] != "what" else "function", r["f"], r["l"], i) for i, r in enumerate(document["declarations"])]
            assert sorted((r.path, r.mtime_ns) for r in files_got) == sorted((r["p"], r["m"]) for r in files)
            assert not document["declarations"] or split > 200 or tasks > 4


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('{"id":1,"method":"query","params":{"pattern":"Foo","limit":50}}', (1, "query", "Foo", 50, "")),
        ('{"id":2,"method":"query","params":{"pattern":"F"}}', (2, "query", "F", 200, "")),
        ('{"id":2,"method":"query"}', (2, "query", "", 200, "")),
        ('{"id":3,"method":"query","params":{"limit":0}}', (3, "query", "", 200, "")),
        ('{"id":3.99,"method":"query","params":{"limit":-4}}', (3, "query", "", 200, "")),
        ('{"id":4,"method":"frobulate"} trailing', (4, "unknown", "", 200, "")),
        ('{"id":4,"id":5,"method":"status"}', (5, "status", "", 200, "")),
        ('{"id":"x","method":7}', (0, "unknown", "", 200, "")),
        ("[1]", (0, "unknown", "", 200, "")),
        ('{"id":13,"method":"rebuildFile"}', (13, "rebuildFile", "", 200, "")),
        ('{"id":14,"method":"query","params":{"limit":99999999999}}', (14, "query", "", protocol.MAX_LIMIT, "")),
        ("not json", None),
        ('{"id":NaN}', None),
        ('{"id":1e999}', None),
        ('{"id":1e3}', None),
        ('{"params":{"limit":Infinity}}', None),
        ("[" * 100_000, None),
        ("[" * 50_000 + "]" * 50_000, (0, "unknown", "", 200, "")),
        ("[1] x", (0, "unknown", "", 200, "")),
        ('{"id":"7"}', (0, "unknown", "", 200, "")),
        ("{'id':1}", None),
        ('{"id":6,"method":"query","params":5}', (6, "query", "", 200, "")),
        ('{"id":6,"method":"query","params":"x"}', (6, "query", "", 200, "")),
        ('{"method":"query","params":{"pattern":7,"limit":"5"}}', (0, "query", "", 200, "")),
        ('{"id":92233720368547758089}', ((1 << 63) - 1, "unknown", "", 200, "")),
        ('{"id":-92233720368547758089}', (-(1 << 63), "unknown", "", 200, "")),
        ('{"id":-}', (0, "unknown", "", 200, "")),
        ('{"id":' + "1" * 64 + "}", None),
        ('{"id":true,"method":"status"}', (0, "status", "", 200, "")),
        ("   ", None),
        ("[1,]", None),
        ('{"a":1,}', None),
        ('{"a" 1}', None),
        ('"half', None),
        ('"half\\', None),
        ("truth", None),
        ('{"id":1,"method":"query","params":{"pattern":"\\ud83d\\ude00\\udc00"}}', (1, "query", "😀\ufffd", 200, "")),
    ],
)
def test_requests_line_and_column_form(spark, line, want):
    r = protocol.parse_request(line)
    assert (r and (r.id, r.method, r.pattern, r.limit, r.file)) == want
    row = protocol.parse_requests(spark.createDataFrame([(line,)], "line string")).first()
    assert row.bad == (want is None)
    if want:
        assert (row.id, row.method, row.pattern, row.limit, row.file) == want


def _fuzzed_lines(n, seed=8):
    rng = random.Random(seed)
    parts = ['{', '}', '[', ']', ',', ':', '"', '\\', '\\u', '00e9', 'd800', '"id"', '"method"', '"params"', '"query"', '"status"', '"pattern"', '"limit"', '"file"', "true", "null", "NaN", "-", "1", "23.5", "1e9", " ", "\t", "\r", "x", "é", "😀", "\x00", "\x7f"]
    whole = ['{"id":3,"method":"query","params":{"pattern":"Foo","limit":7}}', '{"id":4,"method":"status"}', '{"id":5,"method":"rebuildFile","params":{"file":"a.cpp"}}']
    for _ in range(n):
        if rng.random() < 0.5:
            yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        else:
            line = list(rng.choice(whole))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 3)] = rng.choice(parts)
            yield "".join(line)


def test_fuzzed_lines_are_read_alike_and_never_end_the_loop(spark):
    lines = list(_fuzzed_lines(10_000))
    df = spark.createDataFrame(list(enumerate(lines)), "nth long, line string")
    got = {r.nth: r for r in protocol.parse_requests(df).collect()}
    bad = 0
    for i, line in enumerate(lines):
        r = protocol.parse_request(line)
        if line in ("", "\r"):
            assert i not in got
        elif r is None:
            bad += 1
            assert got[i].bad
        else:
            assert not got[i].bad and (r.id, r.method, r.pattern, r.limit, r.file) == tuple(got[i])[2:-1]

    class Stub:
        strict_compat, cache, rows_key, n_files, n_declarations, ready = False, False, "declarations", 0, 0, True
        search = staticmethod(lambda text, limit: [])
        refresh = build = staticmethod(lambda: None)
        refresh_file = staticmethod(lambda f: False)

    lines = [x for x in lines if "shutdown" not in x]
    answers = list(service.serve(Stub(), lines))
    assert len(answers) == sum(x not in ("", "\r") for x in lines) and sum('"error":"bad JSON"' in a for a in answers) == bad > 1000
    assert all(json.loads(a) for a in answers)


def test_parser_agrees_with_json_where_json_is_strict():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice("abcé\n\""): value(depth - 1) for _ in range(rng.randrange(4))}
        return [None, True, False, rng.randrange(-(1 << 62), 1 << 62), "".join(rng.choice('ab"\\\n\té😀/') for _ in range(5))][kind]

    for _ in range(500):
        v = value(4)
        assert lenient_json.parse(json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) == v


def test_strict_compat_reads_escapes_as_question_marks():
    assert protocol.parse_request('{"method":"query","params":{"pattern":"\\u0041"}}').pattern == "A"
    assert protocol.parse_request('{"method":"query","params":{"pattern":"\\u0041"}}', strict_compat=True).pattern == "?"
    assert protocol.parse_request('{"method":"query","params":{"pattern":"\\u0041\\u0042\\\\u0043"}}', strict_compat=True).pattern == "??\\u0043"


def test_unknown_escapes_and_control_bytes_pass(spark):
    line = '{"id":7,"method":"query","params":{"pattern":"a\\qb\tc\\\\d"}}'
    assert protocol.parse_request(line).pattern == "aqb\tc\\d"
    assert protocol.parse_requests(spark.createDataFrame([(line,)], "line string")).first().pattern == "aqb\tc\\d"


def test_serving_a_session(spark, tmp_path):
    write(tmp_path, {"a.cpp": "void alpha() {}"})
    index = service.Index(spark, str(tmp_path))
    index.start()
    write(tmp_path, {"n.cpp": "class Newcomer {};"})
    lines = ["\r\n", '{"id":1,"method":"rebuildFile","params":{"file":"n.cpp"}}\r\n', '{"id":2,"method":"query","params":{"pattern":"newc"}}', "{bad", '{"id":3,"method":"what"}', '{"id":4,"method":"rebuildFile"}', '{"id":5,"method":"status"}', '{"id":6,"method":"rebuild"}', '{"id":7,"method":"forceRebuild"}', '{"id":8,"method":"shutdown"}', '{"id":9,"method":"status"}']
    got = [json.loads(x) for x in service.serve(index, lines)]
    assert [g["id"] for g in got] == [1, 2, 0, 3, 4, 5, 6, 7, 8]
    assert got[0]["status"] == "rebuilt"
    assert [s["name"] for s in got[1]["declarations"]] == ["Newcomer"]
    assert list(got[1]["declarations"][0]) == ["name", "kind", "file", "line", "score"]
    assert all("error" in got[i] for i in (2, 3, 4))
    assert got[5] == {"id": 5, "status": "ready", "files": 2, "declarations": 2}
    assert got[8]["status"] == "shutdown"
    assert snapshot.exists(spark, index.cache_dir)


def test_replay_equals_the_loop_and_events_refresh(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"a.cpp": "void alpha() {}", "b.cpp": "void beta() {}"})
    lines = ['{"id":1,"method":"query","params":{"pattern":"a"}}', '{"id":2,"method":"rebuildFile","params":{"file":"b.cpp"}}', "x", '{"id":3,"method":"status"}']
    write(tmp_path, {"in/r.txt": "\n".join(lines)})
    index = service.Index(spark, str(root), cache=False)
    index.build()
    want = list(service.serve(index, lines))
    replay.replay(index, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("nth").collect()
    assert [r.response for r in got] == want
    write(root, {"b.cpp": "void gamma() {}"})
    write(tmp_path, {"ev/e.json": '{"path":"b.cpp","at":1}\n{"path":"b.cpp","at":2}\n'})
    service.follow(index, str(tmp_path / "ev"), str(tmp_path / "ck2"))
    assert names(index) == ["alpha", "gamma"]


def test_batches_of_requests_equal_the_loop(spark, tmp_path):
    """Hundreds of requests of all sorts, some files changed, new or gone: as a table and one by one."""
    rng = random.Random(21)
    sources = {f"d{i % 3}/f{i}.cpp": f"int var{i};\nvoid run{i}() {{}}" for i in range(12)}
    later = {"d0/f0.cpp": "struct Fresh {};", "d1/f4.cpp": "", "new.h": "#define NEWER 1\nenum E { A };"}
    lines = []
    for i in range(45):
        what = rng.choice(["query"] * 5 + ["status", "rebuildFile", "rebuildFile", "what"] + ["rebuild"] * (i > 30))
        params = {"pattern": rng.choice(["v", "var1", "run", "f0.cpp", "fresh", "NE", "macro", " ", "", "variable r"]), "limit": rng.randint(-1, 9)} if what == "query" else {"file": rng.choice([*sources, *later, "./d2/../d0/f0.cpp", "none.cpp", ""])} if what == "rebuildFile" else {}
        lines.append(rng.choice(["{bad", "", "[]"]) if rng.random() < 0.05 else json.dumps({"id": i, "method": what, "params": params}))
    for tail in ([], ['{"id":7,"method":"forceRebuild"}', '{"id":8,"method":"status"}', '{"id":8,"method":"query","params":{"pattern":"var"}}'], ['{"id":9,"method":"shutdown"}', '{"id":10,"method":"status"}']):
        got = []
        for way in ("loop", "table"):
            root = tmp_path / f"{way}{len(tail)}"
            write(root, sources)
            index = service.Index(spark, str(root), cache=False)
            index.build()
            write(root, later)
            os.remove(root / "d2/f2.cpp")
            if way == "loop":
                got.append(list(service.serve(index, lines + tail)))
            else:
                df = spark.createDataFrame([(i, x) for i, x in enumerate(lines + tail)], "at long, line string").repartition(5)
                rows = replay.answered(index, replay.numbered(df, ["at"])).collect()
                got.append([r.response for r in sorted(rows, key=lambda r: r.nth)])
                assert [r.nth for r in sorted(rows, key=lambda r: r.nth)] == list(range(len(rows)))
        assert got[0] == got[1]


def test_running_sums_over_ranges(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id * 37 % 1000 AS k", "id % 5 AS v")
    rows = sorted(replay.running(df.repartition(6), ["k"], "v").collect(), key=lambda r: r.k)
    assert [r.before for r in rows] == [sum(x.v for x in rows[:i]) for i in range(1000)]
    assert replay.running(df.limit(0), ["k"]).count() == 0


def test_command_line(tmp_path):
    a = arguments(["--root", "r", "--search-dir", "x", "--search-dir", "y", "--no-cache"])
    assert (a.root, a.dirs, a.cache, a.diagnostics) == ("r", ["x", "y"], False, False)
    for wrong in (["--root", "r", "--nope"], []):
        with pytest.raises(SystemExit) as e:
            arguments(wrong)
        assert e.value.code == 1
    with pytest.raises(SystemExit) as e:
        arguments(["--help"])
    assert e.value.code == 0
    more = arguments(["--root", "r", "--rows-key", "hits", "--query-timeout", "0", "--strict-compat"])
    assert (more.rows_key, more.query_timeout, more.strict_compat) == ("hits", 0.0, True)
    assert arguments(["--root", "r"]).query_timeout == QUERY_TIMEOUT
    assert main(["--root", str(tmp_path / "none")]) == 1


def test_single_files_stay_beside_the_index_until_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(service, "MERGE", 3)
    write(tmp_path, {f"f{i}.cpp": f"int v{i};" for i in range(5)})
    index = service.Index(spark, str(tmp_path))
    index.start()
    base, version = index.base, index.saved
    write(tmp_path, {"f0.cpp": "int w0;", "g.h": "struct G { };"})
    assert index.refresh_file("f0.cpp") and index.refresh_file(str(tmp_path / "g.h"))
    assert index.base is base and index.n_files == 6
    index.save()
    assert index.saved == version
    assert sorted(r.name for r in snapshot.load(spark, index.cache_dir)[0].collect()) == names(index) == ["G", "v1", "v2", "v3", "v4", "w0"]
    os.remove(tmp_path / "f1.cpp")
    assert not index.refresh_file("f1.cpp")
    assert not index.delta
    assert names(index) == ["G", "v2", "v3", "v4", "w0"]
    index.save()
    assert index.declarations.select("ord").distinct().count() == 5
    again = service.Index(spark, str(tmp_path))
    again.start()
    assert names(again) == ["G", "v2", "v3", "v4", "w0"]


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_log_equals_a_plain_table_under_any_changes(spark, tmp_path):
    rng, folder = random.Random(4), str(tmp_path / "l")
    plain = {f"f{i}": (i, [(f"n{i}_{k}", "macro", f"f{i}", k, i * 10 + k) for k in range(i % 4)]) for i in range(60)}
    tables = lambda x: (spark.createDataFrame([r for _, rows in x.values() for r in rows], DECLARATIONS), spark.createDataFrame([(p, ns) for p, (ns, _) in x.items()], FILES))
    made = log.Log.create(*tables(plain), folder, buckets=5)
    made.commit()
    for step in range(14):
        change = {f"f{rng.randrange(70)}": (rng.choice([None, step + 1000]), []) for _ in range(rng.randint(1, 9))}
        change = {p: (ns, [(f"s{step}{p}", "enum", p, 1, 10_000 + 100 * step + i)] if ns else []) for i, (p, (ns, _)) in enumerate(change.items())}
        made.append(*reversed(tables(change)))
        plain |= change
        plain = {p: x for p, x in plain.items() if x[0] is not None}
        if step % 5 == 2:
            made.fold({rng.randrange(5), rng.randrange(5)})
        elif step % 5 == 4:
            made.unite()
        elif step == 8:
            made.tidy()
        if step % 3 == 0:
            made.commit({"f1": (7, [("single", "macro", "f1", 1, 5)])})
            plain["f1"] = (7, [("single", "macro", "f1", 1, 5)])
            made.append(*reversed(tables({"f1": plain["f1"]})))
        d, r = made.merged(*made.base())
        assert sorted(map(tuple, d.collect())) == sorted(x for _, rows in plain.values() for x in rows)
        assert sorted(map(tuple, r.collect())) == sorted((p, ns) for p, (ns, _) in plain.items())
    made.commit()
    made.commit()
    again = log.Log.open(spark, folder)
    assert sorted(map(tuple, snapshot.load(spark, folder)[0].collect())) == sorted(x for _, rows in plain.values() for x in rows)
    named = {*again.state.base.values(), *again.state.deltas.values()}
    assert {f for f in os.listdir(folder) if os.path.isdir(f"{folder}/{f}")} == named  # nothing else is left


def test_a_batch_of_events_writes_little_and_folding_reads_only_its_buckets(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("concat('name_', id * 7919 % 1000003) AS name", "'macro' AS kind", "concat('dir/f', id % 20000, '.cpp') AS file", "cast(id as int) AS line", "id AS ord")
    files = spark.range(20_000).selectExpr("concat('dir/f', id, '.cpp') AS path", "id AS mtime_ns")
    folder = str(tmp_path / "l")
    made = log.Log.create(rows, files, folder)
    before = _bytes(folder)
    stamps = files.where("mtime_ns % 200 = 3").withColumn("mtime_ns", F.lit(1).cast("long"))
    made.append(stamps, stamps.selectExpr("concat('new', path) AS name", "'enum' AS kind", "path AS file", "1 AS line", "1000000L AS ord"))
    assert stamps.count() == 100 and _bytes(folder) - before < before / 100
    assert not made.tidy()  # too little to be folded
    one = min(b for b, n in made.state.waiting.items() if n)
    version = dict(made.state.base)
    made.fold({one})
    assert {b for b in version if made.state.base[b] != version[b]} == {one} and made.merged(*made.base())[0].count() == 400_000 - 100 * 20 + 100
    with pytest.raises(log.LogError):
        log.State.read('{"version": 1}')


def test_sessions_leave_no_tables_behind(spark, tmp_path):
    write(tmp_path, {f"f{i}.cpp": f"int v{i};" for i in range(4)})
    base = shared.shared_base(spark).removeprefix("file://")
    before = set(os.listdir(base))
    index = service.Index(spark, str(tmp_path))
    index.start()
    for i in range(3):
        write(tmp_path, {"f0.cpp": f"int w{i};", f"g{i}.h": "struct G { };"})
        os.utime(tmp_path / "f0.cpp", ns=(i + 1, i + 1))
        index.refresh()
        index.save()
    assert set(os.listdir(base)) == before and names(index) == sorted(["v1", "v2", "v3", "w2"] + ["G"] * 3)
    assert index.n_files == 7 and index.n_declarations == 7


def test_one_folder_is_read_by_many_tasks_and_deep_trees_in_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "LOOKS", 5)
    monkeypatch.setattr(tree, "READS", 10)
    write(tmp_path, {f"big/f{i}.cpp": f"int v{i};" for i in range(60)} | {f"d{i}/e{i}/g/h{i}.h": "" for i in range(8)} | {"d1/.hidden.cc": "", "d1/no.txt": "", "build/x.cpp": ""})
    for dirs, ignored in (([], "build/*\nbig/f1.cpp"), (["big", "d1", "none"], "")):
        got = tree.spread_tree(spark, str(tmp_path), dirs, ignored)
        want = tree.read_tree(spark, str(tmp_path), dirs, ignored)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.rdd.getNumPartitions() >= 6
    assert tree.spread_tree(spark, str(tmp_path / "nothing")).count() == 0
    assert tree.spread_tree(spark, str(tmp_path), content=False).where("content is null and mtime_ns > 0").count() == 70


def test_rules_of_a_table_equal_one_predicate(spark):
    rng = random.Random(6)
    parts = ["a", "b", "src", "x.c", "build", ""]
    paths = ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(200)] + ["./a/b", "a\\b\\x.c", "", None]
    text = "\n".join(["/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(["", "/*"]) for _ in range(12)])
    rules = ignore.parse_rules(text)
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    table = spark.createDataFrame([(r.pattern, r.is_glob) for r in rules] * 2, "pattern string, is_glob boolean")
    want = [r.n for r in ignore.not_ignored(files.where("path is not null"), rules).collect()] + [len(paths) - 1]
    assert sorted(r.n for r in ignore.not_ignored_by(files, table).collect()) == sorted(want)


def test_watching_a_tree_refreshes_what_changed(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"a/x.cpp": "int one;", "b/y.cpp": "int two;", "b/no.txt": "", "gone/z.h": "int three;"})
    index = service.Index(spark, str(root), cache=False)
    index.build()
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    service.watch(index, state, check)
    assert names(index) == ["one", "three", "two"]
    write(root, {"a/x.cpp": "int uno;", "c/d/new.h": "enum New {};"})
    os.utime(root / "a/x.cpp", ns=(5, 5))
    os.remove(root / "gone/z.h")
    seen = []
    refresh = index.refresh_files
    index.refresh_files = lambda paths: (seen.append(sorted(r.path for r in paths.collect())), refresh(paths))
    service.watch(index, state, check)
    service.watch(index, state, check)
    assert seen == [["a/x.cpp", "c/d/new.h", "gone/z.h"]] and names(index) == ["New", "two", "uno"]
    assert len(os.listdir(state)) <= 8


def test_one_failing_request_does_not_end_the_service(spark, tmp_path, monkeypatch):
    write(tmp_path, {"a.cpp": "void alpha() {}"})
    index = service.Index(spark, str(tmp_path), cache=False)
    index.build()
    monkeypatch.setattr(service.Index, "refresh", lambda self: 1 / 0)
    got = [json.loads(x) for x in service.serve(index, ['{"id":1,"method":"rebuild"}', '{"id":2,"method":"query","params":{"pattern":"alpha"}}'])]
    assert got[0] == {"id": 1, "error": "division by zero"}
    assert got[1]["declarations"][0]["name"] == "alpha"


def test_sql_functions_agree_with_the_columns(spark):
    from brindle.functions.register import register

    register(spark)
    rng = random.Random(3)
    rows = [("".join(rng.choice("aAbB_:é") for _ in range(rng.randint(0, 8))), "".join(rng.choice("aAbB_") for _ in range(rng.randint(0, 4)))) for _ in range(300)]
    spark.createDataFrame(rows, "n string, p string").createOrReplaceTempView("pairs")
    assert all(r.s == model_score(r.n, r.p) for r in spark.sql("SELECT n, p, fuzzy_score(n, p) AS s FROM pairs").collect())


def test_batches_of_searches_equal_single_ones(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("abcAB_:") for _ in range(rng.randint(1, 9))), rng.choice(["class", "enum", "macro"]), f"d{i % 3}/f{i % 7}.{rng.choice(['h', 'cpp'])}", i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "name string, kind string, file string, line int, ord long").cache()
    texts = ["ab", "A enum", "b d1.h", "class", "f2.cpp", "  ", "", None, "abc enum d/.h", "zzzz", "a" * 60, "_:"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, pattern string")
    for some in (texts, texts[:10]):
        got = {}
        for r in batch_search(df, asked.where(f"qid < {len(some)}"), 7).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.name, r.kind, r.file, r.line, r.score))
        for i, t in enumerate(some):
            assert got.get(i, []) == [tuple(r) for r in search(df, t, 7).collect()], t
    own = spark.createDataFrame([(i, t, i % 3 + 1) for i, t in enumerate(texts)], "qid long, pattern string, most long")
    got = batch_search(df, own, "most", max_patterns=5).groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in got} == {i: n for i, t in enumerate(texts) if (n := len(search(df, t, i % 3 + 1).collect()))}
    plan = batch_search(df, own, 7)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert batch_search(df, own.where("pattern = 'zzzz'"), 7).count() == 0 == batch_search(df.limit(0), own, 7).count()


def test_clustered_search_equals_plain_search_and_reads_little(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows = [("".join(rng.choice("abcAB_:é") for _ in range(rng.randint(0, 30))), rng.choice(["class", "enum"]), f"f{i % 5}.h", i % 9, i) for i in range(3000)]
    rows += [(f"prefix{'x' * (i % 7)}", "enum", "p.h", 1, 10_000 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, kind string, file string, line int, ord long").cache()
    topk.save_clustered(df, str(tmp_path / "t"), 16)
    table = topk.Clustered.open(spark, str(tmp_path / "t"))
    assert sum(table.bands.values()) == len(rows)
    for looks in (1 / 8, 1):
        monkeypatch.setattr(topk, "LOOKS", looks)
        for text, limit in (("a", 5), ("ab", 3), ("AB_", 200), ("prefix", 10), ("PREFIXX enum", 4), ("b f3.h", 7), ("é", 9), ("zzz", 4), ("abcab", 1), ("", 5), ("  ", 6), ("class", 8), ("a" * 31, 2), ("_", 5000)):
            assert topk.search_clustered(table, text, limit).collect() == search(df, text, limit).collect(), text
    reads = []
    run = topk.search_clustered(table, "prefix", 10, reads)
    assert len(run.collect()) == 10 and sum(reads) + topk.rows_read(run) < len(rows) / 10


@given(pattern=st.text("abA_", min_size=1, max_size=5), name=st.text("abAB_:", max_size=14))
@settings(max_examples=500, deadline=None)
def test_no_name_that_the_pattern_does_not_begin_passes_its_bound(pattern, name):
    got = model_score(name, pattern)
    if got is not None and not name.lower().startswith(pattern.lower()):
        assert got <= topk.best_subsequence(len(pattern), len(name))


@given(name=st.text("abAB_:é", max_size=12), file=st.text("ab/.", max_size=6), pattern=st.text("abAB_é", max_size=4))
@settings(max_examples=300, deadline=None)
def test_rows_that_match_have_the_keys_of_the_pattern(name, file, pattern):
    has = {keys.EVERY, keys.KIND + 1}
    for base, text in ((0, name), (keys.FILE, file)):
        raw = text.lower().encode() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text).encode()
        has |= {base + keys.BYTE + c for c in raw} | {base + raw[i] * 256 + raw[j] for i in range(len(raw)) for j in range(i + 1, len(raw))}
    if model_score(name, pattern) is not None:
        assert set(keys.pattern_keys("class", "", pattern)) <= has or not pattern


def test_keys_of_rows(spark):
    df = spark.createDataFrame([("aBa", "enum", "x/é", 1), ("", "class", "", 2), (None, None, None, 3)], "name string, kind string, file string, ord long")
    every = [*range(keys.PAIR, keys.PAIR + 65536, 1), *range(keys.BYTE, keys.BYTE + 256), *range(keys.FILE, keys.FILE + 65536), *range(keys.FILE + keys.BYTE, keys.FILE + keys.BYTE + 256), *range(keys.KIND, keys.EVERY + 1)]
    got = {r.ord: set(r.k) for r in keys.with_keys(df, every, "k").collect()}
    a, b, x = 97, 98, [ord("x"), ord("/"), 0xC3, 0xA9]
    files = {keys.FILE + keys.BYTE + c for c in x} | {keys.FILE + x[i] * 256 + x[j] for i in range(4) for j in range(i + 1, 4)}
    assert got[1] == {keys.EVERY, keys.KIND + 3, keys.BYTE + a, keys.BYTE + b, a * 256 + b, b * 256 + a, a * 256 + a} | files
    assert got[2] == {keys.EVERY, keys.KIND + 1} and got[3] == {keys.EVERY}
    assert keys.key_counts(df.toArrow(), [keys.EVERY, a * 256 + b, 5, keys.KIND + 1, keys.FILE + keys.BYTE + ord('x')]) == {keys.EVERY: 3, a * 256 + b: 1, 5: 0, keys.KIND + 1: 1, keys.FILE + keys.BYTE + ord('x'): 1}
