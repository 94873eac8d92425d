"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import testbed as tb
from brindle.functions import ascii_lower, equals_ignore_case, extension, is_file_token, kind_name, kind_of, lenient_json, normal_path, tokens
from brindle.functions.register import register
from brindle.functions.score import with_scores
from brindle.functions.text import known_kind
from brindle.model import EXTENSIONS, KINDS
from brindle.operators import extract, ignore, maintain, present, stats
from brindle.plans import apropos, batch_search, search, topk
from brindle.plans.search import compiled_columns
from brindle.sources import log, snapshot, tree, tree_stream
from brindle.sources.shared import shared_folder
from brindle.streaming import protocol, replay, service

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_K, _X = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]", "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
_UP, _LO = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _low(x: str) -> str:
    return f"translate({x}, {_UP}, {_LO})"


#: The adapters of ``testbed`` in SQL.
DECLARATIONS = f"""decl AS (SELECT CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_')
  WHEN 1 THEN split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
  WHEN 2 THEN replace(p_name, ' ', '::') ELSE upper(replace(p_name, ' ', '_')) END AS name,
  {_K}[(p_partkey // 4) % 8 + 1] AS kind, 'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '.' || {_X}[p_size % 8 + 1] AS file,
  p_size::INT AS line, p_partkey AS ord FROM part)"""
FILES = f"""files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.' || list_concat({_X}, ['md', 'HPP'])[doc_id % 10 + 1] AS path, n_chars AS mtime_ns, text AS content FROM documents)"""
STATES = f"""records AS (SELECT 'f' || p_partkey || '.cpp' AS path, p_partkey AS mtime_ns FROM part WHERE p_partkey % 10 <> 0),
current_ AS (SELECT 'f' || p_partkey || '.cpp' AS path, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1000000 ELSE 0 END AS mtime_ns FROM part WHERE p_partkey % 7 <> 0),
removed AS (SELECT path FROM records ANTI JOIN current_ USING (path)),
changed AS (SELECT c.path, c.mtime_ns FROM current_ c LEFT JOIN records r USING (path) WHERE c.mtime_ns IS DISTINCT FROM r.mtime_ns),
evicted AS (SELECT path FROM removed UNION SELECT path FROM changed),
indexed AS (SELECT 'd_' || l_orderkey || '_' || l_linenumber AS name, {_K}[l_linenumber % 8 + 1] AS kind, 'f' || l_partkey || '.cpp' AS file,
  l_linenumber::INT AS line, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_partkey % 10 <> 0)"""
PATTERNS = f"""texts AS (SELECT n_nationkey::BIGINT AS qid, ['rw', 'sr', 'Bolt', 'sg', 'RING', 'anv', 'hg', 'o_w'][n_nationkey % 8 + 1] AS part, {_K}[n_nationkey // 8 + 1] AS k FROM nation),
patterns AS (SELECT qid, CASE qid % 3 WHEN 0 THEN part || ' ' || k WHEN 1 THEN 'brand_1.h ' || part ELSE part END AS pattern FROM texts)"""


def score_sql(name: str, pattern: str) -> str:
    """The score of ASCII names, null for no match."""
    low, lp = _low(name), _low(pattern)
    step = f"instr(substr({low}, acc[-1] + 1), substr({lp}, x[1], 1))"
    pos = f"list_reduce(list_transform(range(1, length({pattern}) + 1), lambda i: [i]), lambda acc, x: list_append(acc, CASE WHEN acc[-1] < 0 OR {step} = 0 THEN -1 ELSE acc[-1] + {step} END), [0]::BIGINT[])"
    gain = f"""list_sum(list_transform(range(2, length({pattern}) + 2), lambda i: CASE WHEN i > 2 AND ps[i] = ps[i - 1] + 1 THEN 10 ELSE 0 END
      + CASE WHEN ps[i] = 1 OR substr({name}, ps[i] - 1, 1) IN ('_', ':') OR (substr({name}, ps[i] - 1, 1) BETWEEN 'a' AND 'z' AND substr({name}, ps[i], 1) BETWEEN 'A' AND 'Z') THEN 20 ELSE 0 END
      + CASE WHEN substr({name}, ps[i], 1) = substr({pattern}, i - 1, 1) THEN 5 ELSE 0 END))"""
    return f"""(CASE WHEN {pattern} = '' THEN 0 WHEN length({name}) < length({pattern}) THEN NULL WHEN length({name}) = length({pattern}) AND {low} = {lp} THEN 1000
      WHEN starts_with({low}, {lp}) THEN 500 + greatest(0, 100 - (length({name}) - length({pattern})))
      ELSE list_transform([{pos}], lambda ps: CASE WHEN ps[-1] > 0 THEN greatest(1, {gain} - length({name}) // 4) END)[1] END)::INT"""


def search_sql(kind: str | None, file: str, name: str, limit: int = 200) -> str:
    where = [f"kind = '{kind}'"] if kind else []
    where += [f"{score_sql('file', repr(file))} IS NOT NULL"] if file else []
    return f"""WITH {DECLARATIONS}, s AS (SELECT *, {score_sql("name", repr(name)) if name else "0"} AS score FROM decl {"WHERE " + " AND ".join(where) if where else ""})
SELECT name, kind, file, line, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, file, line, name, ord LIMIT {limit}"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# ---- search


def _search(name: str, text: str, kind: str | None, file: str, part: str, limit: int = 200) -> None:
    query(name, search_sql(kind, file, part, limit if limit > 0 else 200))(lambda spark, d: search(tb.declarations(spark, d), text, limit))


_search("search_name_kind", "rw struct", "struct", "", "rw")
_search("search_kind_first", "struct rw", "struct", "", "rw")
_search("search_name", "sg", None, "", "sg", 50)
_search("search_prefix", "redW", None, "", "redW", 40)
_search("search_exact", "SMALL_RING", None, "", "SMALL_RING", 30)
_search("search_joined_names", "sm all ri", None, "", "smallri", 100)
_search("search_kind_only", "enum", "enum", "", "")
_search("search_file_only", "econ.hpp", None, "econ.hpp", "")
_search("search_name_file_kind", "bolt brand_1.cpp class", "class", "brand_1.cpp", "bolt", 100)
_search("search_last_kind_wins", "struct class gear", "class", "", "gear")
_search("search_blanks_give_all", "   ", None, "", "", 0)
query("search_empty_pattern", f"WITH {DECLARATIONS} SELECT name, kind, file, line, 0::INT AS score FROM decl WHERE false")(lambda spark, d: search(tb.declarations(spark, d), ""))

query("apropos", search_sql(None, "", "gear", 1 << 40))(lambda spark, d: apropos(tb.declarations(spark, d), "gear"))

_SCORED = ["rw", "RB", "smallring", "ring", "small_ring", "aa", "x", ""]
query("score_rules", f"WITH {DECLARATIONS} SELECT ord, name, {', '.join(f'{score_sql("name", repr(p))} AS s{i}' for i, p in enumerate(_SCORED))} FROM decl")(
    lambda spark, d: with_scores(tb.declarations(spark, d).select("ord", "name"), {f"s{i}": p for i, p in enumerate(_SCORED)})
)
query(
    "batch_search",
    f"""WITH {DECLARATIONS}, {PATTERNS},
q AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN split_part(pattern, ' ', 2) END AS qkind, CASE WHEN qid % 3 = 1 THEN 'brand_1.h' ELSE '' END AS qfile,
  CASE qid % 3 WHEN 1 THEN split_part(pattern, ' ', 2) ELSE split_part(pattern, ' ', 1) END AS qname FROM patterns),
s AS (SELECT qid, decl.*, {score_sql("name", "qname")} AS score FROM decl JOIN q ON (qkind IS NULL OR kind = qkind) AND (qfile = '' OR {score_sql("file", "qfile")} IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file, line, name, ord)::INT AS rank FROM s WHERE score IS NOT NULL)
SELECT qid, rank, name, kind, file, line, score FROM r WHERE rank <= 25""",
)(lambda spark, d: batch_search(tb.declarations(spark, d), tb.patterns(spark, d), 25))


def _clustered(spark, d) -> topk.Clustered:
    folder = f"{shared_folder(spark, 'clustered')}/t"
    topk.save_clustered(tb.declarations(spark, d), folder, 64)
    return topk.Clustered.open(spark, folder)


query("topk_prefix", search_sql(None, "", "redW", 40))(lambda spark, d: topk.search_clustered(_clustered(spark, d), "redW", 40))
query("topk_subsequence", search_sql("struct", "", "sg", 50))(lambda spark, d: topk.search_clustered(_clustered(spark, d), "sg struct", 50))
query("topk_name_and_file", search_sql(None, "brand_1.h", "smallri", 30))(lambda spark, d: topk.search_clustered(_clustered(spark, d), "brand_1.h smallri", 30))


# ---- query text


@query(
    "compile_queries",
    f"""WITH {PATTERNS} SELECT qid, CASE WHEN qid % 3 = 0 THEN k END AS kind, CASE WHEN qid % 3 = 1 THEN 'brand_1.h' ELSE '' END AS file, part AS name FROM patterns JOIN texts USING (qid)""",
)
def _compile(spark, d):
    kind, file, name = compiled_columns(F.col("pattern"))
    return tb.patterns(spark, d).select("qid", kind.alias("kind"), file.alias("file"), name.alias("name"))


_WORDS = "SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS token FROM documents"


@query("tokenize", f"SELECT token, count(*) AS n FROM ({_WORDS}) GROUP BY token")
def _tokenize(spark, d):
    return tb.table(spark, d, "documents").select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("token_kinds", f"SELECT p_partkey, {_low('p_type')} AS low, CASE WHEN list_contains({_K}, {_low('w')}) THEN {_low('w')} END AS kind FROM (SELECT *, {_K}[p_partkey % 8 + 1] || CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE '' END AS w FROM part)")
def _token_kinds(spark, d):
    word = F.concat(F.upper(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 8 + 1).cast("int"))), F.when(F.col("p_partkey") % 3 == 0, "S").otherwise(""))
    return tb.table(spark, d, "part").select("p_partkey", ascii_lower("p_type").alias("low"), kind_of(word).alias("kind"))


@query("file_tokens", f"SELECT token, count(*) AS n FROM ({_WORDS}) WHERE regexp_matches(token, '[/\\\\.]') GROUP BY token")
def _file_tokens(spark, d):
    t = tb.table(spark, d, "documents").select(F.explode(tokens("text")).alias("token"))
    return t.where(is_file_token("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("equals_ignore_case", f"SELECT p_partkey, {_low('p_type')} = {_low('lower(p_type)')} AS same, {_low('p_type')} = {_low('p_name')} AS other FROM part")
def _equals(spark, d):
    return tb.table(spark, d, "part").select("p_partkey", equals_ignore_case("p_type", F.lower("p_type")).alias("same"), equals_ignore_case("p_type", "p_name").alias("other"))


# ---- scan, ignore, paths


@query("extension_filter", f"WITH {FILES} SELECT path, mtime_ns FROM files WHERE list_contains({_X}, regexp_extract(path, '(?:^|/)[^/]+[.]([^./]*)$', 1))")
def _extensions(spark, d):
    return tb.files(spark, d).where(extension("path").isin(*EXTENSIONS)).select("path", "mtime_ns")


IGNORE = "# rules\r\nsrc1/*\r\n./src2/en/*\nsrc3\\fr\\*\n\nsrc0/en/doc_0.cpp\n src5/*"


@query(
    "ignore_rules_applied",
    f"""WITH {FILES} SELECT path FROM files WHERE NOT (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/') OR starts_with(path, 'src3/fr/')
    OR starts_with(path, ' src5/') OR path = 'src0/en/doc_0.cpp')""",
)
def _ignored(spark, d):
    return ignore.not_ignored(tb.files(spark, d).select("path"), ignore.parse_rules(IGNORE))


@query("ignore_many_rules", f"WITH {FILES} SELECT path FROM files WHERE mtime_ns % 7 <> 0 AND path NOT LIKE '%/fr/%'")
def _many_rules(spark, d):
    return ignore.not_ignored_by(tb.files(spark, d).select("path"), tb.rule_table(spark, d))


_RULES = "SELECT n_nationkey, unnest(['src' || n_nationkey || '/', 'old/f' || n_nationkey || '.c', ' x' || n_nationkey || '/']) AS pattern, unnest([true, false, true]) AS is_glob FROM nation"


@query("ignore_rules_parsed", _RULES)
def _rules(spark, d):
    return tb.rule_texts(spark, d).select("n_nationkey", F.explode(ignore.parsed_rules(F.col("text"))).alias("r")).select("n_nationkey", "r.pattern", "r.is_glob")


@query("rule_count", f"SELECT count(*) AS rules, count_if(is_glob) AS globs FROM ({_RULES})")
def _rule_count(spark, d):
    return _rules(spark, d).agg(F.count("*").alias("rules"), F.count_if("is_glob").alias("globs"))


@query("normal_paths", f"WITH {FILES}, w AS (SELECT path AS p, CASE mtime_ns % 3 WHEN 0 THEN './' || path WHEN 1 THEN replace(path, '/', chr(92)) ELSE '././' || path END AS raw FROM files) SELECT raw, CASE WHEN starts_with(replace(raw, chr(92), '/'), './') THEN substr(replace(raw, chr(92), '/'), 3) ELSE replace(raw, chr(92), '/') END AS path FROM w")
def _paths(spark, d):
    f = tb.files(spark, d)
    raw = F.when(F.col("mtime_ns") % 3 == 0, F.concat(F.lit("./"), "path")).when(F.col("mtime_ns") % 3 == 1, F.translate("path", "/", "\\")).otherwise(F.concat(F.lit("././"), "path"))
    return f.select(raw.alias("raw")).select("raw", normal_path("raw").alias("path"))


@query("kind_text", f"SELECT p_partkey, CASE WHEN list_contains({_K}, w) THEN w ELSE 'function' END AS stored, CASE WHEN list_contains({_K}, w) THEN w ELSE 'unknown' END AS shown FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Class' ELSE {_K}[p_partkey % 8 + 1] END AS w FROM part)")
def _kind_text(spark, d):
    w = F.when(F.col("p_partkey") % 5 == 0, "Class").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return tb.table(spark, d, "part").select("p_partkey", kind_name(w).alias("stored"), known_kind(w).alias("shown"))


# ---- maintenance


def _states(spark, d):
    return tb.records(spark, d), tb.current(spark, d)


query("removed_files", f"WITH {STATES} SELECT path FROM removed")(lambda spark, d: maintain.removed(*_states(spark, d)))
query("changed_files", f"WITH {STATES} SELECT path, mtime_ns FROM changed")(lambda spark, d: maintain.changed(*_states(spark, d)))
query("evicted_files", f"WITH {STATES} SELECT path FROM evicted")(lambda spark, d: maintain.evicted(*_states(spark, d)))
query("evict_declarations", f"WITH {STATES} SELECT indexed.* FROM indexed ANTI JOIN evicted ON file = path")(lambda spark, d: maintain.without(tb.indexed(spark, d), maintain.evicted(*_states(spark, d))))
query("upsert_records", f"WITH {STATES} SELECT path, mtime_ns FROM records ANTI JOIN changed USING (path) UNION ALL SELECT path, mtime_ns FROM changed")(lambda spark, d: maintain.upserted(tb.records(spark, d), maintain.changed(*_states(spark, d))))
query("delta_counts", f"WITH {STATES} SELECT (SELECT count(*) FROM removed) AS removed, (SELECT count(*) FROM changed) AS changed, (SELECT count(*) FROM evicted) AS evicted, (SELECT count(*) FROM current_ JOIN records USING (path, mtime_ns)) AS unchanged")(lambda spark, d: maintain.delta_counts(*_states(spark, d)))


_REFRESHED = f"""WITH {STATES}, kept AS (SELECT indexed.* FROM indexed ANTI JOIN evicted ON file = path),
fresh AS (SELECT 'new_' || path AS name, 'macro' AS kind, path AS file, 1::INT AS line, substr(path, 2, length(path) - 5)::BIGINT AS ord FROM changed)
SELECT * FROM kept UNION ALL SELECT name, kind, file, line, ord + (SELECT coalesce(max(ord), -1) FROM indexed) + 1 FROM fresh"""


def _fresh(paths):
    """One macro for each file to be read, numbered by the part."""
    own = F.expr("cast(substring(path, 2, length(path) - 5) as bigint)")
    return paths.select(F.concat(F.lit("new_"), "path").alias("name"), F.lit("macro").alias("kind"), F.col("path").alias("file"), F.lit(1).alias("line"), own.alias("ord")), paths


query("incremental_refresh", _REFRESHED)(lambda spark, d: maintain.apply_delta(tb.indexed(spark, d), *_states(spark, d), _fresh).declarations)


def _logged(spark, d, fold: bool) -> tuple[DataFrame, DataFrame]:
    """The index as a log, refreshed by a delta in two parts, the second after files of the first; folded bucket by bucket, if asked for."""
    records, current = _states(spark, d)
    made = log.Log.create(tb.indexed(spark, d), records, f"{shared_folder(spark, 'log')}/l")
    stamps, fresh = maintain.touched(records, current, _fresh)
    top = made.state.top
    made.append(stamps.where("mtime_ns is not null"), fresh.withColumn("ord", F.lit(-1).cast("long")))
    made.append(stamps, fresh.withColumn("ord", F.col("ord") + top + 1))
    if fold:
        for b in sorted(made.due(1 << 30))[::2]:
            made.fold({b})
        made.unite()
    made.commit()
    return snapshot.load(spark, made.folder)


query("log_merged", _REFRESHED)(lambda spark, d: _logged(spark, d, False)[0])
query("log_folded", _REFRESHED)(lambda spark, d: _logged(spark, d, True)[0])
query("log_records", f"WITH {STATES} SELECT path, mtime_ns FROM records ANTI JOIN evicted USING (path) UNION ALL SELECT path, mtime_ns FROM changed")(lambda spark, d: _logged(spark, d, True)[1])


@query("prune_deleted", f"WITH {STATES} SELECT indexed.* FROM indexed ANTI JOIN removed ON file = path")
def _prune(spark, d):
    return maintain.pruned(tb.indexed(spark, d), *_states(spark, d))[0]


@query("pruned_count", f"WITH {STATES} SELECT count(*) AS n FROM removed")
def _pruned(spark, d):
    return maintain.pruned(tb.indexed(spark, d), *_states(spark, d))[2].agg(F.count("*").alias("n"))


# ---- aggregates and reports

query("index_counts", f"WITH {STATES} SELECT (SELECT count(*) FROM indexed) AS declarations, (SELECT count(DISTINCT file) FROM indexed) AS files_with_declarations, (SELECT count(*) FROM records) AS files")(lambda spark, d: stats.counts(tb.indexed(spark, d), tb.records(spark, d)))


def _parsed(spark, d):
    """Sources of which every seventh cannot be read."""
    sources = tb.generated_sources(spark, d).withColumn("content", F.when(F.col("mtime_ns") % 7 != 0, F.col("content")))
    return extract.parse_sources(sources)


query("slowest_files", "SELECT 20::BIGINT AS files, true AS timed")(lambda spark, d: stats.slowest(_parsed(spark, d).withColumnRenamed("file", "path").select("path", "seconds")).agg(F.count("*").alias("files"), F.bool_and((F.col("seconds") >= 0) & F.col("path").isNotNull()).alias("timed")))
query("slowest_order", f"WITH {FILES} SELECT path, mtime_ns::DOUBLE AS seconds FROM files ORDER BY seconds DESC, path LIMIT 20")(lambda spark, d: stats.slowest(tb.files(spark, d).select("path", F.col("mtime_ns").cast("double").alias("seconds"))))
query("parse_errors", "SELECT count(*) FILTER (c_nationkey % 7 = 0) AS errors FROM customer")(lambda spark, d: stats.parse_errors(_parsed(spark, d)))
query("line_numbers", "SELECT doc_id, (1 + length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')))::INT AS line FROM documents")(
    lambda spark, d: tb.table(spark, d, "documents").withColumn("o", F.octet_length(F.expr("left(text, cast(n_chars div 2 as int))"))).select("doc_id", stats.line_of("text", "o").alias("line"))
)
query("dedup_captures", "SELECT DISTINCT 'o' || l_orderkey AS file, (l_partkey % 50)::INT AS byte_offset FROM lineitem")(lambda spark, d: stats.deduplicated(tb.table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), (F.col("l_partkey") % 50).cast("int").alias("byte_offset"))))

# ---- presentation

_LONGER = f"WITH {DECLARATIONS}, w AS (SELECT name, kind, CASE WHEN ord % 2 = 0 THEN repeat('deep/', 9) || file ELSE file END AS file, line, ord FROM decl)"
_SHORT = "CASE WHEN length(file) > 50 THEN '...' || right(file, 47) ELSE file END"


def _longer(spark, d):
    return tb.declarations(spark, d).withColumn("file", F.when(F.col("ord") % 2 == 0, F.concat(F.repeat(F.lit("deep/"), F.lit(9)), "file")).otherwise(F.col("file")))


query("short_paths", f"{_LONGER} SELECT ord, {_SHORT} AS path FROM w")(lambda spark, d: _longer(spark, d).select("ord", present.short_path("file").alias("path")))
query("result_lines", f"{_LONGER} SELECT ord, printf('%-50s %-10s %s:%s', name, kind, {_SHORT}, line::VARCHAR) AS shown FROM w")(lambda spark, d: _longer(spark, d).select("ord", present.result_line().alias("shown")))
query("absolute_paths", f"WITH {DECLARATIONS} SELECT ord, '/home/p/' || file AS path FROM decl")(lambda spark, d: tb.declarations(spark, d).select("ord", present.absolute("/home/p/").alias("path")))
query("summaries", f"WITH {DECLARATIONS} SELECT ord, name || ' [' || kind || ']' AS shown FROM decl")(lambda spark, d: tb.declarations(spark, d).select("ord", present.summary().alias("shown")))
query("exact_or_all_hit", f"WITH {DECLARATIONS} SELECT * FROM decl WHERE {_low('name')} = 'small_ring'")(lambda spark, d: present.exact_or_all(tb.declarations(spark, d), "Small_Ring"))
query("exact_or_all_miss", f"WITH {DECLARATIONS} SELECT * FROM decl")(lambda spark, d: present.exact_or_all(tb.declarations(spark, d), "nothing like this"))
query("result_json", f"WITH {DECLARATIONS} SELECT ord, to_json({{'name': name, 'kind': kind, 'file': file, 'line': line, 'score': 0}})::VARCHAR AS json FROM decl")(lambda spark, d: tb.declarations(spark, d).withColumn("score", F.lit(0)).select("ord", present.result_json().alias("json")))

# ---- protocol

_REQUESTS = """e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'status' WHEN 'signup' THEN 'rebuildFile' WHEN 'purchase' THEN 'rebuild' ELSE 'unknown' END AS method,
  event_id % 11 = 0 AS bad, event_id % 7 = 0 AS bare, user_id % 50 - 5 AS lim FROM events WHERE event_id % 11 = 0 OR event_id % 13 <> 0),
q AS (SELECT event_id, CASE WHEN bad THEN 0 ELSE event_id END AS id, CASE WHEN bad THEN 'unknown' ELSE method END AS method, CASE WHEN bad OR bare THEN '' ELSE 'u' || user_id END AS pattern,
  (CASE WHEN bad OR bare OR lim <= 0 THEN 200 ELSE lim END)::BIGINT AS "limit", CASE WHEN bad OR bare THEN '' ELSE 'f' || user_id || '.cpp' END AS file, bad FROM e)"""


def _requests(spark, d):
    return protocol.parse_requests(tb.request_lines(spark, d)).drop("line")


query("parse_requests", f"WITH {_REQUESTS} SELECT * FROM q")(_requests)


@query("match_responses", f"WITH {_REQUESTS} SELECT a.event_id AS id, b.method FROM q a JOIN q b ON a.event_id = b.id WHERE a.method = 'query'")
def _matched(spark, d):
    r = _requests(spark, d)
    return protocol.matched(r.where("method = 'query'").select(F.col("event_id").alias("id")), r.select("id", "method"))


_ESCAPED = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN -event_id ELSE event_id END AS id,
  CASE event_id % 6 WHEN 0 THEN 'query' WHEN 1 THEN 'query' WHEN 4 THEN 'shutdown' WHEN 5 THEN 'rebuildFile' ELSE 'unknown' END AS method,
  CASE event_id % 6 WHEN 0 THEN {} || user_id || 'q/' WHEN 1 THEN 'tab' || chr(9) || 'here' || user_id ELSE '' END AS pattern,
  CASE WHEN event_id % 6 = 3 AND user_id > 0 THEN user_id ELSE 200 END::BIGINT AS "limit",
  CASE event_id % 6 WHEN 3 THEN 'a' || chr(92) || 'b"c' WHEN 5 THEN chr(10) || user_id || '.h' ELSE '' END AS file, false AS bad FROM events"""
query("parse_escapes", _ESCAPED.format("'aAB'"))(lambda spark, d: protocol.parse_requests(tb.escaped_lines(spark, d)).drop("line"))
query("parse_escapes_compat", _ESCAPED.format("'a??'"))(lambda spark, d: protocol.parse_requests(tb.escaped_lines(spark, d), strict_compat=True).drop("line"))


query(
    "parse_hostile",
    """WITH e AS (SELECT event_id, event_id % 12 AS c, length(event_id::VARCHAR) > 3 AS long FROM events), b AS (SELECT *, c IN (0, 1, 9) OR c = 11 AND long AS bad FROM e)
SELECT event_id, CASE WHEN c IN (6, 7, 10) THEN event_id WHEN c = 5 THEN -event_id WHEN c = 8 THEN 9223372036854775807 WHEN c = 11 AND NOT long THEN event_id ELSE 0 END AS id,
  CASE WHEN c IN (6, 7, 10) THEN 'query' WHEN c = 4 THEN 'status' WHEN c = 5 THEN 'rebuild' WHEN c = 8 THEN 'shutdown' ELSE 'unknown' END AS method,
  CASE WHEN c = 10 THEN '😀' || chr(65533) || 'xé?' ELSE '' END AS pattern, 200::BIGINT AS "limit", '' AS file, bad FROM b""",
)(lambda spark, d: protocol.parse_requests(tb.hostile_lines(spark, d)).drop("line"))


@query("escaped_json", r"""SELECT doc_id, '{"id":' || doc_id || ',"error":"' || replace(replace(replace(replace(left(text, 80), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || chr(92) || 'r\\' || '"}' AS response FROM documents""")
def _escaped(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", protocol.error_response(F.col("doc_id"), F.concat(F.expr("left(text, 80)"), F.lit("\r\\"))).alias("response"))


@query("json_arrays", "SELECT event_id, len(a)::INT AS n, a[2] AS second, a[9] AS beyond, list_append(a, event_id)[-1] AS pushed FROM (SELECT event_id, [user_id, event_id % 5, user_id + 1] AS a FROM events)")
def _arrays(spark, d):
    text = F.concat(F.lit("["), F.concat_ws(",", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string"), (F.col("user_id") + 1).cast("string")), F.lit("]"))
    a = tb.table(spark, d, "events").select("event_id", F.from_json(text, "array<bigint>").alias("a"))
    return a.select("event_id", lenient_json.size("a").alias("n"), lenient_json.at("a", 1).alias("second"), lenient_json.at("a", 8).alias("beyond"), F.element_at(lenient_json.pushed("a", F.col("event_id")), -1).alias("pushed"))


@query("lenient_json_fields", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.none'), '') AS none FROM events")
def _fields(spark, d):
    j = tb.table(spark, d, "events").withColumn("j", F.from_json("props", "k string, none string"))
    return j.select("event_id", lenient_json.number("j.k").alias("k"), lenient_json.string("j.none").alias("none"))


# ---- extraction

_GEN = """SELECT 'gen/c' || k || '.cpp' AS file, name, kind, line FROM (SELECT c_custkey::VARCHAR AS k FROM customer),
LATERAL (VALUES ('LIMIT_' || k, 'macro', 2), ('Account' || k, 'class', 4), ('close' || k, 'function', 6), ('total' || k, 'variable', 10), ('run' || k, 'function', 11), ('kept', 'variable', 11), ('Mode' || k, 'enum', 12)) t(name, kind, line)"""


@query("extract_declarations", _GEN)
def _extracted(spark, d):
    return extract.captures_of(extract.parse_sources(tb.generated_sources(spark, d))).select("file", "name", "kind", "line")


@query("build_index_kinds", f"SELECT kind, count(*) AS n, count(DISTINCT file) AS files FROM ({_GEN}) GROUP BY kind")
def _built(spark, d):
    rows = extract.declarations_of(extract.parse_sources(tb.generated_sources(spark, d)))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


_ALL = """SELECT 'all/s' || k || '.cpp' AS file, name, kind, line FROM (SELECT s_suppkey::VARCHAR AS k FROM supplier),
LATERAL (VALUES ('Point' || k, 'struct', 3), ('Id' || k, 'alias', 4), ('Word' || k, 'typedef', 5), ('SUM' || k, 'macro', 6), ('pick' || k, 'function', 8), ('Bag' || k, 'class', 9), ('put', 'function', 9),
  ('declared' || k, 'function', 10), ('ready' || k, 'variable', 12), ('spare' || k, 'variable', 12), ('text' || k, 'variable', 13), ('Early' || k, 'enum', 14), ('Point' || k || '::move', 'function', 15),
  ('step' || k, 'variable', 15), ('operator<', 'function', 16)) t(name, kind, line)"""


@query("extract_constructs", _ALL)
def _constructs(spark, d):
    return extract.captures_of(extract.parse_sources(tb.construct_sources(spark, d))).select("file", "name", "kind", "line")


@query("numbered_declarations", f"SELECT file, name, kind, line, row_number() OVER (ORDER BY file, nth) - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, CASE WHEN name = 'put' OR name LIKE 'spare%' OR name LIKE 'step%' THEN 1 ELSE 0 END) AS nth FROM ({_ALL}))")
def _numbered(spark, d):
    return extract.declarations_of(extract.parse_sources(tb.construct_sources(spark, d))).select("file", "name", "kind", "line", "ord")


query("extract_init_declared", """SELECT 'init/s' || k || '.cpp' AS file, name, kind, line FROM (SELECT s_suppkey::VARCHAR AS k FROM supplier),
LATERAL (VALUES ('gone' || k, 'function', 1), ('zero' || k, 'function', 2), ('Pure' || k, 'class', 3), ('pure', 'function', 3), ('plain' || k, 'variable', 4)) t(name, kind, line)""")(
    lambda spark, d: extract.captures_of(extract.parse_sources(tb.initialised_sources(spark, d))).select("file", "name", "kind", "line")
)


@query("extract_table_function", _ALL)
def _table_function(spark, d):
    register(spark)
    tb.construct_sources(spark, d).createOrReplaceTempView("brindle_sources")
    return spark.sql("SELECT path AS file, name, kind, line FROM brindle_sources, LATERAL extract_declarations(content)")


@query("sql_functions", f"""WITH {DECLARATIONS} SELECT ord, {_low("name")} AS low, {score_sql("name", "'rw'")} AS score, regexp_extract(file, '([^.]*)$', 1) AS ext, CASE WHEN kind = 'enum' THEN 'enum' END AS kind,
  CASE WHEN contains(file, ' ') THEN 3 ELSE 2 END AS words, true AS is_file, file AS path FROM decl""")
def _sql_functions(spark, d):
    register(spark)
    tb.declarations(spark, d).createOrReplaceTempView("brindle_declarations")
    return spark.sql("""SELECT ord, ascii_lower(name) AS low, fuzzy_score(name, 'rw') AS score, file_extension(file) AS ext, kind_of(if(kind = 'enum', 'ENUM', 'x')) AS kind,
      size(query_tokens(concat('a  ', file))) AS words, is_file_token(file) AS is_file, normal_path(concat('./', replace(file, '/', chr(92)))) AS path FROM brindle_declarations""")


# ---- source, snapshot and streams, in folders of their own


def _tree(spark: SparkSession, sf_dir: str) -> str:
    return tb.written_tree(tb.generated_sources(spark, sf_dir), shared_folder(spark, "tree"))


@query("scan_source_tree", f"SELECT 'gen/c' || c_custkey || '.cpp' AS path, ({sum(map(len, tb.GENERATED))} + {len(tb.GENERATED) - 1} * length(c_custkey::VARCHAR))::INT AS bytes FROM customer WHERE c_custkey <> 0")
def _scan(spark, d):
    return tree.read_tree(spark, _tree(spark, d), ignore="gen/c0.cpp\n").select("path", F.length("content").alias("bytes"))


@query("scan_one_folder", f"SELECT 'gen/c' || c_custkey || '.cpp' AS path, ({sum(map(len, tb.GENERATED))} + {len(tb.GENERATED) - 1} * length(c_custkey::VARCHAR))::INT AS bytes FROM customer WHERE c_custkey <> 0")
def _scan_one(spark, d):
    return tree.spread_tree(spark, _tree(spark, d), ignore="gen/c0.cpp\n").select("path", F.length("content").alias("bytes"))


@query("build_from_tree", _GEN)
def _build(spark, d):
    sources = tree.read_tree(spark, _tree(spark, d))
    return extract.declarations_of(extract.parse_sources(sources)).select("file", "name", "kind", "line")


_DIRS = """c AS (SELECT c_custkey AS k, 'part' || c_custkey % 4 || '/deep' || c_custkey % 3 || '/c' || c_custkey || '.cpp' AS path FROM customer)"""


def _deep_tree(spark: SparkSession, sf_dir: str) -> str:
    """The sources dealt over folders, with an ignore file at the root."""
    path = F.concat(F.lit("part"), F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 4, F.lit("/deep"), F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 3, F.lit("/"), F.regexp_replace("path", "^gen/", ""))
    root = tb.written_tree(tb.generated_sources(spark, sf_dir).withColumn("path", path), shared_folder(spark, "deep"))
    with open(f"{root}/.declarations-ignore", "w", encoding="utf-8") as f:
        f.write("# rules\r\npart1/*\r\n./part2\\deep0\\*\n")
    return root


@query("scan_roots", f"WITH {_DIRS} SELECT path FROM c WHERE path LIKE 'part2/%' UNION ALL SELECT path FROM c WHERE path LIKE 'part2/deep1/%' UNION ALL SELECT path FROM c WHERE path LIKE 'part0/deep2/%'")
def _roots(spark, d):
    return tree.read_tree(spark, _deep_tree(spark, d), ["part2", "part2/deep1", "part0/deep2", "none"], content=False, fan="2").select("path")


@query("scan_with_ignore_file", f"WITH {_DIRS} SELECT path, true AS timed FROM c WHERE path NOT LIKE 'part1/%' AND path NOT LIKE 'part2/deep0/%'")
def _scan_ignored(spark, d):
    root = _deep_tree(spark, d)
    return tree.read_tree(spark, root, ignore=tree.load_ignore(root), content=False).select("path", (F.col("mtime_ns") > 1_500_000_000_000_000_000).alias("timed"))


@query("snapshot_round_trip", f"WITH {DECLARATIONS} SELECT * FROM decl")
def _snapshot(spark, d):
    folder = f"{shared_folder(spark, 'snapshot')}/s"
    snapshot.save(folder, tb.declarations(spark, d), tb.records(spark, d))
    return snapshot.load(spark, folder)[0]


@query("snapshot_files", f"WITH {STATES} SELECT path, mtime_ns FROM records WHERE path <> 'f1.cpp' UNION ALL SELECT 'n.cpp', 5")
def _snapshot_files(spark, d):
    folder = f"{shared_folder(spark, 'snapshot')}/s"
    version = snapshot.save(folder, tb.declarations(spark, d), tb.records(spark, d))
    snapshot.save_delta(spark, folder, version, {"f1.cpp": (None, []), "n.cpp": (5, [("n", "macro", "n.cpp", 1, 1 << 40)])})
    return snapshot.load(spark, folder)[1]


@query("snapshot_exists_and_delete", "SELECT false AS before, true AS saved, true AS deleted, false AS again, false AS after, count(*) AS rows FROM part")
def _snapshot_life(spark, d):
    folder = f"{shared_folder(spark, 'snapshot')}/s"
    before = snapshot.exists(spark, folder)
    snapshot.save(folder, tb.declarations(spark, d), tb.records(spark, d))
    n, saved = snapshot.load(spark, folder)[0].count(), snapshot.exists(spark, folder)
    deleted, again = snapshot.delete(spark, folder), snapshot.delete(spark, folder)
    return spark.createDataFrame([(before, saved, deleted, again, snapshot.exists(spark, folder), n)], "before boolean, saved boolean, deleted boolean, again boolean, after boolean, rows long")


@query("json_snapshot_v2", f"WITH {DECLARATIONS} SELECT name, kind, file, line, row_number() OVER (ORDER BY ord) - 1 AS ord FROM decl")
def _json_v2(spark, d):
    path = f"{shared_folder(spark, 'json')}/snapshot"
    snapshot.export_json(path, tb.declarations(spark, d), tb.records(spark, d))
    snapshot.join_parts(spark, path, f"{path}.json")
    return snapshot.import_json(spark, f"{path}.json")[0]


@query("json_snapshot_parts", f"WITH {STATES} SELECT name, kind, file, line FROM indexed")
def _json_parts(spark, d):
    path = f"{shared_folder(spark, 'json')}/snapshot"
    snapshot.export_json(path, tb.indexed(spark, d), tb.records(spark, d))
    return snapshot.import_json(spark, path)[0].drop("ord")


@query("json_snapshot_v2_files", f"WITH {STATES} SELECT path, mtime_ns FROM records")
def _json_v2_files(spark, d):
    path = f"{shared_folder(spark, 'json')}/snapshot"
    snapshot.export_json(path, tb.declarations(spark, d), tb.records(spark, d), "rows")
    return snapshot.import_json(spark, path, "rows")[1]


@query("json_snapshot_v1", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'enum' ELSE 'function' END AS kind, 'n.h' AS file, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey END::INT AS line, row_number() OVER (ORDER BY n_nationkey) - 1 AS ord FROM nation")
def _json_v1(spark, d):
    """A foreign file of version 1: no files, unknown kinds, missing fields."""
    path = f"{shared_folder(spark, 'json')}/v1"
    row = F.struct(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("n"), F.when(F.col("n_nationkey") % 2 == 0, "enum").otherwise("Enum").alias("k"), F.lit("n.h").alias("f"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey")).alias("l"))
    rows = tb.table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("a")).select(F.lit(1).alias("version"), F.transform("a", lambda x: x["r"]).alias("list"))
    rows.select(F.to_json(F.struct("version", "list"))).coalesce(1).write.text(path)
    return snapshot.import_json(spark, path, "list")[0]


#: Every tenth file was rewritten behind the index's back, so a row is there until or from the request that refreshes its file.
_REPLAY = f"""WITH r AS (SELECT event_id AS nth, event_id % 10 AS c, user_id % 40 AS u FROM events),
k AS (SELECT c_custkey AS k, 'gen/c' || c_custkey || '.cpp' AS file, c_custkey % 10 = 0 AS new FROM customer),
own AS (SELECT u AS k, min(nth) AS own FROM r WHERE c = 7 AND nth <> 700 GROUP BY u),
ends AS (SELECT k.*, CASE WHEN new THEN least(coalesce(own, 1152921504606846976), coalesce((SELECT nth FROM r WHERE nth = 700), 1152921504606846976)) ELSE 1152921504606846976 END AS turn FROM k LEFT JOIN own USING (k)),
d AS (SELECT 'Account' || k AS name, file, 4 AS line, -1 AS since, turn AS until FROM ends UNION ALL SELECT 'Accounted' || k, file, 1, turn, 1152921504606846976 FROM ends WHERE new AND turn < 1152921504606846976),
p AS (SELECT DISTINCT u, 'Account' || u AS pattern FROM r),
m AS (SELECT u, d.*, score FROM (SELECT p.u, d.*, {score_sql("name", "pattern")} AS score FROM p CROSS JOIN d) d WHERE score IS NOT NULL),
q AS (SELECT nth, name, file, line, score, row_number() OVER (PARTITION BY nth ORDER BY score DESC, file, line, name) AS rank, nth % 4 + 1 AS most FROM r JOIN m USING (u) WHERE c < 6 AND nth <> 700 AND since <= nth AND nth < until),
l AS (SELECT nth, string_agg('{{"name":"' || name || '","kind":"class","file":"' || file || '","line":' || line || ',"score":' || score || '}}', ',' ORDER BY rank) AS rows FROM q WHERE rank <= most GROUP BY nth),
s AS (SELECT nth, (SELECT count(*) FROM k) AS files, (SELECT 7 * count(*) FROM k) - 6 * (SELECT count(*) FROM ends WHERE new AND turn < r.nth) AS n FROM r WHERE c = 6)
SELECT nth, CASE WHEN nth = 700 OR c = 7 THEN '{{"id":' || nth || ',"status":"rebuilt"}}' WHEN c < 6 THEN '{{"id":' || nth || ',"declarations":[' || coalesce(rows, '') || ']}}'
  WHEN c = 6 THEN '{{"id":' || nth || ',"status":"ready","files":' || files || ',"declarations":' || n || '}}' WHEN c = 8 THEN '{{"id":0,"error":"bad JSON"}}' ELSE '{{"id":' || nth || ',"error":"no file given"}}' END AS response
FROM r LEFT JOIN l USING (nth) LEFT JOIN s USING (nth)"""


def _rewritten(spark, d, index) -> None:
    """Every tenth file gets one other declaration, unseen by the index."""
    root = index.root

    def touch(batches):
        for pdf in batches:
            for k in pdf["c_custkey"]:
                with open(f"{root}/gen/c{k}.cpp", "w", encoding="utf-8") as f:
                    f.write(f"class Accounted{k} {{ }};")
            yield pdf

    tb.spread(tb.table(spark, d, "customer").where("c_custkey % 10 = 0").select("c_custkey"), tb.SOURCES_EACH).mapInPandas(touch, "c_custkey long").write.format("noop").mode("overwrite").save()


@query("replay_requests", _REPLAY)
def _replay(spark, d):
    """All events as requests through the stream, files of them split."""
    index = service.Index(spark, _tree(spark, d), cache=False)
    index.build()
    _rewritten(spark, d, index)
    base = shared_folder(spark, "replay")
    tb.replay_lines(spark, d).repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("line").write.text(f"{base}/in")
    for i, name in enumerate(sorted(f for f in os.listdir(f"{base}/in") if f.startswith("part-"))):
        os.utime(f"{base}/in/{name}", (1_000_000_000 + i,) * 2)  # they arrived in their order
    replay.replay(index, f"{base}/in", f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out").select("nth", "response")


@query("responses", _REPLAY)
def _responses(spark, d):
    """The same requests as a table that knows its order."""
    index = service.Index(spark, _tree(spark, d), cache=False)
    index.build()
    _rewritten(spark, d, index)
    return replay.answered(index, replay.numbered(tb.replay_lines(spark, d), ["event_id"]))


_SESSION = f"""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 0::BIGINT AS nth, '{{"id":0,"error":"bad JSON"}}' AS response
UNION ALL SELECT 1, '{{"id":0,"error":"unknown method"}}'
UNION ALL SELECT 2, '{{"id":2,"error":"no file given"}}'
UNION ALL SELECT 3, '{{"id":3,"status":"rebuilt"}}'
UNION ALL SELECT 4, '{{"id":4,"list":[{{"name":"fresh_one","kind":"function","file":"gen/new.h","line":2,"score":1000}}]}}'
UNION ALL SELECT 5, '{{"id":5,"status":"rebuilt"}}'
UNION ALL SELECT 6, '{{"id":6,"status":"ready","files":' || (count(*) + 1) || ',"list":' || (7 * count(*) + 1) || '}}' FROM c
UNION ALL SELECT 7, '{{"id":7,"status":"rebuilt"}}'
UNION ALL SELECT 8, '{{"id":8,"list":[]}}'
UNION ALL SELECT 9, '{{"id":9,"status":"shutdown"}}'"""


@query("session", _SESSION)
def _session(spark, d):
    """A session with snapshots, in a foreign dialect: single-file refresh, refresh, forced rebuild, shutdown; what follows is not read."""
    root = _tree(spark, d)
    index = service.Index(spark, root, cache_dir=f"{shared_folder(spark, 'cache')}/s", rows_key="list", query_timeout=600)
    index.start()
    with open(f"{root}/gen/new.h", "w", encoding="utf-8") as f:
        f.write("// new\nvoid fresh_one();\n")
    lines = ["{bad", "[]", '{"id":2,"method":"rebuildFile"}', "\r", '{"id":3,"method":"rebuildFile","params":{"file":"gen/new.h"}}', '{"id":4,"method":"query","params":{"pattern":"fresh_one"}}', '{"id":5,"method":"rebuild"}', '{"id":6,"method":"status"}']
    got = list(service.serve(index, lines))
    os.remove(f"{root}/gen/new.h")
    got += service.serve(index, ['{"id":7,"method":"forceRebuild"}', '{"id":8,"method":"query","params":{"pattern":"fresh_one"}}', '{"id":9,"method":"shutdown"}', '{"id":10,"method":"status"}'])
    return spark.createDataFrame(list(enumerate(got)), "nth long, response string")


@query("warm_start", f"SELECT file, name, kind, line FROM ({_GEN}) WHERE file <> 'gen/c1.cpp' UNION ALL SELECT 'gen/c2.cpp', 'again', 'macro', 1")
def _warm_start(spark, d):
    """Saved, a file refreshed and saved as a delta, another deleted; then started from the snapshot, which is pruned."""
    root, cache = _tree(spark, d), f"{shared_folder(spark, 'cache')}/s"
    first = service.Index(spark, root, cache_dir=cache)
    first.start()
    with open(f"{root}/gen/c2.cpp", "r+", encoding="utf-8") as f:
        text = f.read().replace("// header of 2", "#define again 1")
        f.seek(0)
        f.write(text)
    first.refresh_file("gen/c2.cpp")
    first.save()
    os.remove(f"{root}/gen/c1.cpp")
    second = service.Index(spark, root, cache_dir=cache)
    second.start()
    if not second.ready or second.dirty or second.seconds:
        raise RuntimeError("not started from the snapshot")
    return second.declarations.select("file", "name", "kind", "line")


@query("event_feed", f"SELECT file, name, kind, line FROM ({_GEN}) WHERE substr(file, 6, length(file) - 9)::BIGINT % 5 <> 0 UNION ALL SELECT 'gen/c' || c_custkey || '.cpp', 'Renewed' || c_custkey, 'enum', 1 FROM customer WHERE c_custkey % 10 = 0")
def _event_feed(spark, d):
    """Every fifth file has events: half of them were rewritten, half deleted."""
    root = _tree(spark, d)
    index = service.Index(spark, root, cache=False)
    index.build()
    keys = tb.spread(tb.table(spark, d, "customer").where("c_custkey % 5 = 0").select("c_custkey"), tb.SOURCES_EACH)

    def touch(batches):
        for pdf in batches:
            for k in pdf["c_custkey"]:
                if k % 10:
                    os.remove(f"{root}/gen/c{k}.cpp")
                else:
                    with open(f"{root}/gen/c{k}.cpp", "w", encoding="utf-8") as f:
                        f.write(f"enum Renewed{k} {{ }};")
            yield pdf

    keys.mapInPandas(touch, "c_custkey long").write.format("noop").mode("overwrite").save()
    base = shared_folder(spark, "feed")
    path = F.concat(F.lit("gen/c"), F.col("c_custkey").cast("string"), F.lit(".cpp"))
    keys.select(path.alias("path"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("at")).write.json(f"{base}/in")
    service.follow(index, f"{base}/in", f"{base}/check")
    return index.declarations.select("file", "name", "kind", "line")


@query("tree_changes", """SELECT 0::BIGINT AS batch, 'gen/c' || c_custkey || '.cpp' AS path, 'new' AS state FROM customer
UNION ALL SELECT 1, 'gen/c' || c_custkey || '.cpp', CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE 'removed' END FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 1, 'gen/added.h', 'new'""")
def _tree_changes(spark, d):
    """Two triggers over a tree of which every fifth file changes or goes in between."""
    root, base = _tree(spark, d), shared_folder(spark, "changes")

    def trigger() -> None:
        rows = tree_stream.changes(spark, root, f"{base}/state")
        out = rows.writeStream.foreachBatch(lambda b, n: b.select(F.lit(n).cast("long").alias("batch"), "path", "state").write.mode("overwrite").parquet(f"{base}/out/n={n}"))
        out.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()

    trigger()

    def touch(batches):
        for pdf in batches:
            for k in pdf["c_custkey"]:
                if k % 10:
                    os.remove(f"{root}/gen/c{k}.cpp")
                else:
                    os.utime(f"{root}/gen/c{k}.cpp", ns=(1, 1))
            yield pdf

    tb.spread(tb.table(spark, d, "customer").where("c_custkey % 5 = 0").select("c_custkey"), tb.SOURCES_EACH).mapInPandas(touch, "c_custkey long").write.format("noop").mode("overwrite").save()
    with open(f"{root}/gen/added.h", "w", encoding="utf-8") as f:
        f.write("enum Added {};")
    trigger()
    return spark.read.parquet(f"{base}/out").select("batch", "path", "state")


@query("request_timeout", "SELECT 0::BIGINT AS nth, true AS late, 0::BIGINT AS n UNION ALL SELECT 1, false, least(200, count(*)) FROM part")
def _timeout(spark, d):
    """All parts as declarations whose names take their time: answered with an error; then without: answered with rows."""
    index = service.Index(spark, "/", cache=False, query_timeout=0.2)
    slow = F.expr("coalesce(left(cast(java_method('java.lang.Thread', 'sleep', 20L) as string), 0), '')")
    index.declarations, index.ready = tb.declarations(spark, d).withColumn("name", F.concat("name", slow)), True
    line = '{"id":1,"method":"query","params":{"pattern":" "}}'
    got = list(service.serve(index, [line]))
    index.declarations, index.query_timeout = tb.declarations(spark, d), 600
    got += service.serve(index, [line])
    return spark.createDataFrame([(i, '"error":"no answer' in x, x.count('"kind"')) for i, x in enumerate(got)], "nth long, late boolean, n long")
