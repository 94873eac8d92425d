"""Search: token text -> filters, score, top rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from brindle.functions import score_column
from brindle.functions.score import UNROLL, contains_subsequence, scored_pairs, subsequence_regex, with_score
from brindle.functions.text import LOWER, UPPER, ascii_lower, bytes_as_chars, is_file_token, kind_of, tokens
from brindle.model import DECLARATIONS, DEFAULT_LIMIT, KINDS, ORDER
from brindle.plans.keys import key_counts, pattern_keys, with_keys

_LOWER = str.maketrans(UPPER, LOWER)
#: Rows on which it is seen which of a pattern's keys is rare.
KEY_SAMPLE = 4096


@dataclass(frozen=True)
class QuerySpec:
    """What a query text asks for. ``empty`` asks for nothing; a text of blanks asks for every row."""

    kind: str | None
    file: str
    name: str
    empty: bool = False


def compile_query(text: str | None) -> QuerySpec:
    """Tokens between blanks: a kind (the last one counts), a file part (with ``/``, ``\\`` or ``.``), else a part of the name. Parts are joined."""
    kind, file, name = None, [], []
    for t in (text or "").split(" "):
        if not t:
            continue
        low = t.translate(_LOWER)
        if low in KINDS:
            kind = low
        elif any(c in t for c in "/\\."):
            file.append(t)
        else:
            name.append(t)
    return QuerySpec(kind, "".join(file), "".join(name), not text)


def candidates(declarations: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows that pass the filters, cheapest first, with their score."""
    out = declarations
    if spec.empty:
        out = out.where(F.lit(False))
    if spec.kind:
        out = out.where(F.col("kind") == spec.kind)
    if spec.file:
        out = out.where(contains_subsequence("file", spec.file))
    if not spec.name:
        return out.withColumn("score", F.lit(0))
    # the regular expression decides who matches; a filter on the score would be pushed down and copy its whole chain
    return with_score(out.where(contains_subsequence("name", spec.name)), spec.name)


def ranked(rows: DataFrame) -> list[Column]:
    return [F.desc("score"), *(F.col(c) for c in ORDER if c in rows.columns)]


def search(declarations: DataFrame, text: str | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``name, kind, file, line, score``, best first, at most ``limit`` rows (200 if that is not positive)."""
    rows = candidates(declarations, compile_query(text))
    top = rows.orderBy(*ranked(rows)).limit(limit if limit > 0 else DEFAULT_LIMIT)
    return top.select("name", "kind", "file", "line", "score")


def apropos(declarations: DataFrame, text: str | None) -> DataFrame:
    """All that ``search`` would find, without a limit, in the same order."""
    rows = candidates(declarations, compile_query(text))
    return rows.orderBy(*ranked(rows)).select("name", "kind", "file", "line", "score")


def compiled_columns(text: Column) -> tuple[Column, Column, Column]:
    """Kind, file part and name part of a column of query texts."""
    every = tokens(text)
    kinds = F.filter(F.transform(every, kind_of), lambda k: k.isNotNull())
    rest = F.filter(every, lambda t: kind_of(t).isNull())
    return (
        F.when(F.size(kinds) > 0, F.element_at(kinds, -1)),
        F.array_join(F.filter(rest, is_file_token), ""),
        F.array_join(F.filter(rest, lambda t: ~is_file_token(t)), ""),
    )


def batch_search(declarations: DataFrame, patterns: DataFrame, limit: int | str = DEFAULT_LIMIT, max_patterns: int = 4096) -> DataFrame:
    """Many queries at once: ``qid, rank, name, kind, file, line, score`` for a table ``qid, pattern``; ``declarations`` in the index's schema.

    No pattern meets every row: each asks by its rarest key (two bytes of a part in their order, a lone byte, or the kind), each row hands
    out those of its keys that are asked for, and both meet in a hash join. Only a text of blanks, which finds all rows, joins all. Which key is
    rare is seen on ``KEY_SAMPLE`` rows, as that changes no result. Equal patterns are matched once and joined to their queries. Patterns are taken in slices of
    about ``max_patterns``, which are broadcast. ``limit`` is a number for all or the name of a column of ``patterns``.
    Each task keeps its best rows per query before the shuffle (the window's group limit).
    """
    most = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    queries = patterns.where("pattern is not null and pattern <> ''").select("qid", "pattern", most.cast("int").alias("qlimit"))
    hit = _hits(declarations, queries, max_patterns).join(queries, "pattern")
    w = Window.partitionBy("qid").orderBy(*ranked(hit))
    hit = hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("qlimit"))
    if isinstance(limit, int):
        hit = hit.where(F.col("rank") <= limit)
    return hit.select("qid", "rank", "name", "kind", "file", "line", "score")


#: Stretches of time are put together from stretches of ``STEP`` to some power, as numbers are from digits.
STEP = 8


def stretches(since: int, until: int) -> list[tuple[int, int]]:
    """The fewest stretches ``(level, number)`` that are ``since`` to before ``until``: at most 2 * (STEP - 1) of each level."""
    out, level = [], 0
    while since < until:
        while since % STEP and since < until:
            out.append((level, since))
            since += 1
        while until % STEP and since < until:
            until -= 1
            out.append((level, until))
        since, until, level = since // STEP, until // STEP, level + 1
    return out


def versions_search(declarations: DataFrame, asked: DataFrame, times: int, max_patterns: int = 4096) -> DataFrame:
    """``(pattern, at, rows)`` for queries ``pattern, at, qlimit`` over rows that are there from ``since`` to before ``until``, all between 0 and ``times``: for each pattern and time
    the list of the best rows, as long as the pattern's largest limit.

    No row meets the queries, which may be as many: of the rows with one interval each pattern keeps its best, an interval becomes a few stretches of time, of whose rows each
    pattern keeps its best again, and a time looks into the stretches it is in, one of each level.
    """
    queries = asked.where("pattern is not null and pattern <> ''")
    most = queries.agg(F.max("qlimit")).first()[0] or 0
    levels = 0
    while STEP**levels < times:
        levels += 1
    whole = STEP**levels

    @F.arrow_udf("array<struct<level:int,number:long>>")
    def parts(since: pa.Array, until: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("number", pa.int64())]))
        return pa.array([[dict(zip(("level", "number"), x, strict=True)) for x in stretches(a, whole if b >= times else b)] for a, b in zip(since.to_pylist(), until.to_pylist(), strict=True)], kind)

    hit = _hits(declarations, queries, max_patterns, ("since", "until"))
    hit = hit.join(queries.groupBy("pattern").agg(F.max("qlimit").alias("qmost")), "pattern")

    def best(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("pattern", *by).orderBy(*ranked(rows))
        return rows.withColumn("__nth", F.row_number().over(w)).where((F.col("__nth") <= most) & (F.col("__nth") <= F.col("qmost"))).drop("__nth")

    held = best(hit, "since", "until").withColumn("s", F.explode(parts("since", "until"))).drop("since", "until").select("*", "s.*").drop("s")
    row = F.struct((-F.col("score")).alias("by"), *[c for c in ORDER if c in DECLARATIONS.names], "kind", "score")
    held = best(held, "level", "number").groupBy("pattern", "level", "number").agg(F.collect_list(row).alias("held"))
    times_asked = queries.groupBy("pattern", "at").agg(F.max("qlimit").alias("qmost"))
    inside = times_asked.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"at div {STEP**k}").alias("number")) for k in range(levels + 1)]))).select("pattern", "at", "qmost", "s.*")
    lists = inside.join(held, ["pattern", "level", "number"]).groupBy("pattern", "at", "qmost").agg(F.array_sort(F.flatten(F.collect_list("held"))).alias("r"))
    return lists.select("pattern", "at", F.transform(F.slice("r", F.lit(1), F.col("qmost")), lambda x: F.struct(*[x[c].alias(c) for c in ("name", "kind", "file", "line", "score")])).alias("rows"))


def _hits(declarations: DataFrame, queries: DataFrame, max_patterns: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows, with columns ``extra``, and the different patterns of ``queries`` that find them, with the score."""
    asked = queries.select("pattern").distinct().withColumn("p", F.struct(*(c.alias(a) for c, a in zip(compiled_columns(F.col("pattern")), ("kind", "file", "name"), strict=True))))
    asked = asked.select("pattern", F.col("p.kind").alias("qkind"), F.col("p.name").alias("qname"), F.col("p.file").alias("qfile"))
    rows = declarations.select(*DECLARATIONS.names, *extra)
    spark = declarations.sparkSession
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # a small table, which each pattern multiplies
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    sample = declarations.select("name", "kind", "file").limit(KEY_SAMPLE).toArrow()
    # a slice of patterns is known to the driver, as a broadcast is anyway
    parts = [asked.limit(max_patterns + 1).collect()]
    if len(parts[0]) > max_patterns:
        slices = -(-asked.count() // max_patterns)
        parts = (asked.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == s).collect() for s in range(slices))
    found = []
    for part in parts:
        every = [(r, pattern_keys(r["qkind"], r["qfile"], r["qname"])) for r in part]
        counts = key_counts(sample, sorted({k for _, ks in every for k in ks}))
        every = [(min(ks, key=lambda k: (counts[k], k)), *r) for r, ks in every]
        for long in (False, True):
            some = [r for r in every if (max(len(r[3].encode()), len(r[4].encode())) > UNROLL) == long]
            if some:
                found.append(_met(rows, spark.createDataFrame(some, StructType([StructField("__key", IntegerType()), *asked.schema])), some, long))
    if not found:
        found.append(rows.where(F.lit(False)).crossJoin(asked.limit(0)).withColumn("score", F.lit(0)))
    return reduce(DataFrame.unionByName, found)


def _met(rows: DataFrame, asked: DataFrame, patterns: list[tuple], long: bool) -> DataFrame:
    """Rows and the patterns that find them, with the score. Long patterns are matched by regular expressions, so that they do not lengthen the chain of the others."""
    keys = sorted({p[0] for p in patterns})
    own = with_keys(rows, keys, "__keys").select(*rows.columns, F.explode("__keys").alias("__key"))
    pairs = own.join(F.broadcast(asked), "__key").where("qkind is null or kind = qkind").drop("__key")
    if not long:
        return scored_pairs(pairs, max(len(p[3].encode()) for p in patterns), max(len(p[4].encode()) for p in patterns))
    low = lambda c: ascii_lower(bytes_as_chars(c))
    meets = F.rlike(low("name"), subsequence_regex("qname")) & F.rlike(low("file"), subsequence_regex("qfile"))
    return pairs.where(meets).withColumn("score", score_column("name", "qname"))
