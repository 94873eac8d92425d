"""Adapters from the driver's tables to the engine's schemas, so that every query has an SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import ascii_lower
from brindle.model import EXTENSIONS, KINDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task turns into sources or requests, about: a few row groups of keys are much work behind them.
SOURCES_EACH, LINES_EACH = 4_000, 20_000


def spread(keys: DataFrame, each: int) -> DataFrame:
    """Narrow rows dealt evenly to as many tasks as their number asks for, before long values are made of them: a table of many rows may be one row group, which is one task."""
    return keys.repartition(1 + keys.count() // each)


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declarations: four ways to write a name, eight kinds, one file for each type, brand and extension."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    words = F.split("p_name", " ")
    second = F.element_at(words, 2)
    name = (
        F.when(F.col("p_partkey") % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.element_at(words, 1), F.upper(F.substring(second, 1, 1)), F.expr("substring(element_at(split(p_name, ' '), 2), 2)")))
        .when(F.col("p_partkey") % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("::")))
        .otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    )
    file = F.concat(F.lit("src/"), ascii_lower("p_type"), F.lit("/"), F.translate(ascii_lower("p_brand"), "#", "_"), F.lit("."), _pick(EXTENSIONS, F.col("p_size") % 8))
    return p.select(name.alias("name"), _pick(KINDS, F.floor(F.col("p_partkey") / 4) % 8).alias("kind"), file.alias("file"), F.col("p_size").cast("int").alias("line"), F.col("p_partkey").alias("ord"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files; two of ten extensions do not qualify."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), _pick((*EXTENSIONS, "md", "HPP"), F.col("doc_id") % 10)))
    return d.select(path.alias("path"), F.col("n_chars").alias("mtime_ns"), F.col("text").alias("content"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was recorded: nine parts of ten."""
    return table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(_part_path().alias("path"), F.col("p_partkey").alias("mtime_ns"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there now: six of seven, a third of them touched."""
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(_part_path().alias("path"), (F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 0, 1000000).otherwise(0)).alias("mtime_ns"))


def _part_path():
    return F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".cpp"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as declarations of the recorded files."""
    li = table(spark, sf_dir, "lineitem").where("l_partkey % 10 <> 0")
    return li.select(F.concat_ws("_", F.lit("d"), "l_orderkey", "l_linenumber").alias("name"), _pick(KINDS, F.col("l_linenumber") % 8).alias("kind"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".cpp")).alias("file"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def escaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request lines with escapes of every sort, raw tabs, repeated keys, values of wrong types (limits in quotes alone and before a number), and trailing text."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id"), LINES_EACH)
    u, i = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit('{"id":'), i, F.lit(',"method":"query","params":{"pattern":"a\\u0041\\u0042'), u, F.lit('\\q\\/"}} trailing {')))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit('{"id":1,"id":'), i, F.lit(',"method":"status","method":"query","params":{"pattern":"tab\there'), u, F.lit('","limit":"'), u, F.lit('"}}')))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit('[1,{"id":'), i, F.lit("}]")))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit('{"id":true,"method":null,"params":{"pattern":null,"limit":"'), u, F.lit('","limit":'), u, F.lit(',"file":"a\\\\b\\"c"}}')))
        .when(F.col("event_id") % 6 == 4, F.concat(F.lit(' \t{ "id" : -'), i, F.lit(' , "method" : "shutdown" }')))
        .otherwise(F.concat(F.lit('{"id":'), i, F.lit(',"method":"rebuildFile","params":{"file":"\\n'), u, F.lit('.h"}}')))
    )
    return e.select("event_id", line.alias("line"))


def hostile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines that must not end a service: foreign numbers, depth, wrong types, numbers beyond 64 bits, blanks, halves of pairs."""
    e = spread(table(spark, sf_dir, "events").select("event_id"), LINES_EACH)
    i, at = F.col("event_id").cast("string"), F.col("event_id") % 12
    deep = lambda c: F.repeat(F.lit(c), (F.col("event_id") % 7 + 2000).cast("int"))
    lines = [
        F.concat(F.lit('{"id":1e'), i, F.lit(',"method":"query"}')),
        F.concat(F.lit('{"method":"status","id":NaN,"n":'), i, F.lit("}")),
        F.concat(i, deep("[")),
        F.concat(deep("["), deep("]")),
        F.concat(F.lit('{"id":"'), i, F.lit('","method":"status"}')),
        F.concat(F.lit('{"id":-'), i, F.lit('.99,"method":"rebuild","params":[]}')),
        F.concat(F.lit('{"params":5,"id":'), i, F.lit(',"method":"query"}')),
        F.concat(F.lit('{"params":{"pattern":7,"limit":"5","file":{}},"method":"query","id":'), i, F.lit("}")),
        F.concat(F.lit('{"id":99999999999999999999'), i, F.lit(',"method":"shutdown"}')),
        F.lit(" \t "),
        F.concat(F.lit('{"id":'), i, F.lit(',"method":"query","params":{"pattern":"\\ud83d\\ude00\\ud800x\\u00e9\\uzzzz"}}')),
        F.concat(F.lit('{"id":'), F.repeat(F.lit("0"), F.lit(60)), i, F.lit('}{"method":1}')),
    ]
    return e.select("event_id", F.element_at(F.array(*lines), at.cast("int") + 1).alias("line"))


def replay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to an index of ``generated_sources``: queries for forty names with limits, status, single-file refreshes, one refresh, wrong lines."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id"), LINES_EACH)
    i, u, at = F.col("event_id").cast("string"), (F.col("user_id") % 40).cast("string"), F.col("event_id") % 10
    head = F.concat(F.lit('{"id":'), i, F.lit(',"method":"'))
    line = (
        F.when(F.col("event_id") == 700, F.concat(head, F.lit('rebuild"}')))
        .when(at < 6, F.concat(head, F.lit('query","params":{"pattern":"Account'), u, F.lit(' class","limit":'), (F.col("event_id") % 4 + 1).cast("string"), F.lit("}}")))
        .when(at == 6, F.concat(head, F.lit('status"}')))
        .when(at == 7, F.concat(head, F.lit('rebuildFile","params":{"file":"./gen/c'), u, F.lit('.cpp"}}')))
        .when(at == 8, F.concat(F.lit("wrong "), i))
        .otherwise(F.concat(head, F.lit('rebuildFile"}')))
    )
    return e.select("event_id", line.alias("line"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request lines, numbers written as decimals every third time."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), LINES_EACH)
    method = F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "click", "status").when(F.col("event_type") == "signup", "rebuildFile").when(F.col("event_type") == "purchase", "rebuild").otherwise("frobulate")
    ident = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".75").otherwise(""))
    limit = (F.col("user_id") % 50 - 5).cast("string")
    params = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit(',"params":{"pattern":"u'), F.col("user_id").cast("string"), F.lit('","limit":'), limit, F.lit(',"file":"f'), F.col("user_id").cast("string"), F.lit('.cpp"}')))
    line = F.when(F.col("event_id") % 11 == 0, "not json").when(F.col("event_id") % 13 == 0, F.lit("\r")).otherwise(F.concat(F.lit('{"id":'), ident, F.lit(',"method":"'), method, F.lit('"'), params, F.lit("}\r")))
    return e.select("event_id", line.alias("line"))


#: A C++ file with known declarations; the customer's key goes between the parts.
GENERATED = ("// header of ", "\n#define LIMIT_", " 10\nnamespace n", " {\nclass Account", " {\npublic:\n  void close", "();\n  int balance;\n};\n}\nint total", " = 0;\nvoid run", "() { int local = 1; constexpr int kept = 2; }\nenum class Mode", " { A };\n")


def generated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C++ file for each customer."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), SOURCES_EACH)
    k = F.col("c_custkey").cast("string")
    pieces = [F.lit(GENERATED[0])]
    for p in GENERATED[1:]:
        pieces += [k, F.lit(p)]
    return c.select(F.concat(F.lit("gen/c"), k, F.lit(".cpp")).alias("path"), F.col("c_nationkey").cast("long").alias("mtime_ns"), F.encode(F.concat(*pieces), "UTF-8").alias("content"))


#: A second C++ file, with every construct that is reported or passed over; the key goes between the parts.
CONSTRUCTS = (
    "/* enum Hidden { A }; */\nstruct Later",
    ";\nstruct Point",
    " final : Base { int x; };\nusing Id",
    " = long;\ntypedef unsigned Word",
    ";\n#define SUM",
    "(a, b) \\\n  ((a) + (b))\ntemplate <class T> T pick",
    "(T a) { return a; }\ntemplate <class T> class Bag",
    " { void put(T); };\nint declared",
    "(int);\nint *made",
    "(int) { return 0; }\nint ready",
    " = 1, *spare",
    ", many[3];\nconst char* text",
    ' = R"(struct No { };)";\nenum Early',
    " : int;\nvoid Point",
    "::move() { static int calls = 0; constexpr int step",
    " = 1; }\nbool operator<(int, int);\nunion Raw { int bits; };\nnamespace a { namespace b { namespace c { namespace d { namespace e { namespace f { namespace g { namespace h { int deep; struct Deep { }; } } } } } } } }\n",
)


def construct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C++ file with every construct for each supplier."""
    s = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), SOURCES_EACH)
    k = F.col("s_suppkey").cast("string")
    pieces = [F.lit(CONSTRUCTS[0])]
    for p in CONSTRUCTS[1:]:
        pieces += [k, F.lit(p)]
    return s.select(F.concat(F.lit("all/s"), k, F.lit(".cpp")).alias("path"), F.col("s_suppkey").alias("mtime_ns"), F.encode(F.concat(*pieces), "UTF-8").alias("content"))


def initialised_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C++ file for each supplier in which functions stand where a value follows."""
    s = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), SOURCES_EACH)
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("auto gone"), k, F.lit("(int) = delete;\nint zero"), k, F.lit("(int a) = 0;\nclass Pure"), k, F.lit(" { virtual int pure() = 0; };\nlong plain"), k, F.lit("(1);\n"))
    return s.select(F.concat(F.lit("init/s"), k, F.lit(".cpp")).alias("path"), F.col("s_suppkey").alias("mtime_ns"), F.encode(text, "UTF-8").alias("content"))


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules ``pattern, is_glob``: two for each order that match nothing, the path of every seventh document, the folders of one language."""
    f = files(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    none = o.select(F.concat(F.lit("none/"), "k", F.lit("/")).alias("pattern"), F.lit(True).alias("is_glob")).unionByName(o.select(F.concat(F.lit("none/f"), "k").alias("pattern"), F.lit(False).alias("is_glob")))
    exact = f.where("mtime_ns % 7 = 0").select("path", F.lit(False).alias("is_glob")).withColumnRenamed("path", "pattern")
    globs = f.where("path like '%/fr/%'").select(F.regexp_extract("path", "^(.*/fr/)", 1).alias("pattern"), F.lit(True).alias("is_glob"))
    return none.unionByName(exact).unionByName(globs.distinct())


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as ignore files: a comment, a prefix, an exact path with backslashes, a blank line, an indented prefix."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey").cast("string")
    return n.select("n_nationkey", F.concat(F.lit("# "), "n_name", F.lit("\r\n./src"), k, F.lit("/*\r\n\nold\\f"), k, F.lit(".c\n x"), k, F.lit("/*")).alias("text"))


def written_tree(sources: DataFrame, root: str) -> str:
    """Write sources as files below ``root``, a folder that all executors see."""

    def body(batches):
        import os

        made = set()
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                full = os.path.join(root, path)
                if (folder := os.path.dirname(full)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(full, "wb", buffering=0) as f:
                    f.write(content)
            yield pdf[["path"]]

    sources.select("path", "content").mapInPandas(body, "path string").write.format("noop").mode("overwrite").save()
    return root


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as query texts: a name part, for some with a kind, for some with a file part."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    part, kind = _pick(("rw", "sr", "Bolt", "sg", "RING", "anv", "hg", "o_w"), F.col("n_nationkey") % 8), _pick(KINDS, F.floor(F.col("n_nationkey") / 8))
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(part, F.lit(" "), kind)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("brand_1.h "), part)).otherwise(part)
    return n.select(F.col("n_nationkey").cast("long").alias("qid"), text.alias("pattern"))
