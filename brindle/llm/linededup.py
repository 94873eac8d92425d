"""Line de-duplication over content-defined chunks of lines, in SQL expressions only.

Two steps find passages: ``chunk_ends`` cuts a text at local minima of a rolling hash over its line hashes, and ``_reach`` adds, if
asked for, the shortest runs of lines over a number of words, which chunks can straddle. One step groups equal passages over
all documents, one compares their bytes, and one takes out all places but the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, packed, saved, unpacked

#: Runs of lines with more words than this are compared wherever they begin, if asked for.
RUN_WORDS = 50
#: Identity of a line; equal hashes are compared by bytes afterwards.
LINE_HASH = "xxhash64(x)"
#: First line of a place that goes: what overlaps its own first place goes from where that ends.
CUT = "if(d <=> fd and th = fth, greatest(s, fe + 1), s)"


def _facts(df: DataFrame) -> DataFrame:
    """Adds ``lines`` and ``facts``: of each line the rolling hash's input (the first 32 bits of its MD5), its identity, and its
    words, which are its blanks plus one, or 0 if there is only white space."""
    df = df.withColumn("lines", F.expr("split(t, '\\n', -1)"))
    words = "if(trim(both ' \\t\\r' from x) = '', 0, 1 + octet_length(x) - octet_length(replace(x, ' ', '')))"
    return df.withColumn("facts", F.expr(f"transform(lines, x -> named_struct('m', cast(conv(substring(md5(x), 1, 8), 16, 10) as bigint), 'h', {LINE_HASH}, 'w', {words}))"))


def _chunks(df: DataFrame) -> DataFrame:
    """Adds ``chunks``: first and last line of each chunk of two lines or more that is not all white space.

    The rolling hash after line i covers lines i-1 and i, ``(31 * m[i-1] + m[i]) mod 4294967291``; a chunk ends where it is a
    strict local minimum, so an inserted line moves only the boundaries next to it.
    """
    df = df.withColumn("roll", F.expr("transform(facts, (x, i) -> if(i = 0, 4294967291L, pmod(31L * get(facts, i - 1).m + x.m, 4294967291L)))"))
    last = "size(lines) - 1"
    df = df.withColumn("ends", F.expr(f"filter(sequence(0, {last}), i -> i = {last} or (i > 0 and roll[i] < get(roll, i - 1) and roll[i] < get(roll, i + 1)))"))
    every = "transform(ends, (e, k) -> named_struct('s', if(k = 0, 0, get(ends, k - 1) + 1), 'e', e))"
    return df.withColumn("chunks", F.expr(f"filter({every}, v -> v.e > v.s and exists(slice(facts, v.s + 1, v.e - v.s + 1), x -> x.w > 0))")).drop("roll", "ends")


def _reach(df: DataFrame, lines: str, out: str, words: int) -> DataFrame:
    """Adds ``out``: for each element of ``lines`` the first place at which more than ``words`` words have been passed, or the size.

    Every element has a word or more, so ``words`` + 1 elements are enough. Sums over 1, 2, 4, ... elements are doubled
    from each other and then tried from the largest down: linear in the lines.
    """
    steps = int(words).bit_length()
    df = df.withColumn("sum0", F.expr(f"transform({lines}, x -> least(x.w, {int(words) + 1}))"))
    for k in range(steps - 1):
        df = df.withColumn(f"sum{k + 1}", F.expr(f"transform(sum{k}, (x, i) -> x + coalesce(get(sum{k}, i + {1 << k}), 0))"))
    df = df.withColumn(out, F.expr("transform(sum0, (x, i) -> named_struct('q', i, 't', 0))"))
    for k in reversed(range(steps)):
        fits = f"v.q + {1 << k} <= size(sum0) and v.t + get(sum{k}, v.q) <= {int(words)}"
        df = df.withColumn(out, F.expr(f"transform({out}, v -> if({fits}, named_struct('q', v.q + {1 << k}, 't', v.t + get(sum{k}, v.q)), v))"))
    return df.drop(*[f"sum{k}" for k in range(steps)])


def _runs(df: DataFrame, words: int) -> DataFrame:
    """Adds ``runs``: the shortest runs of lines s to e with more than ``words`` words, from each line on and back from each line.

    Blank lines neither begin nor end a run. A passage of more words is covered by the runs inside it entirely, and they
    are the same in every copy, whatever stands around it.
    """
    df = df.withColumn("on", F.expr("filter(transform(facts, (x, i) -> named_struct('i', i, 'w', x.w)), x -> x.w > 0)"))
    df = _reach(df, "on", "there", words).withColumn("back", F.reverse("on"))
    df = _reach(df, "back", "from", words)
    there = "transform(filter(transform(there, (v, p) -> named_struct('s', p, 'e', v.q)), v -> v.e < size(on)), v -> named_struct('s', on[v.s].i, 'e', on[v.e].i))"
    back = "transform(filter(transform(`from`, (v, p) -> named_struct('e', p, 's', v.q)), v -> v.s < size(on)), v -> named_struct('s', back[v.s].i, 'e', back[v.e].i))"
    return df.withColumn("runs", F.expr(f"concat({there}, {back})")).drop("on", "there", "back", "from")


def _slice(of: str, v: str = "v") -> str:
    return f"slice({of}, {v}.s + 1, {v}.e - {v}.s + 1)"


def passages(plain: DataFrame, run_words: int | None) -> DataFrame:
    """``(d, th, h, s, e)`` of every chunk, and of every run of more than ``run_words`` words, in ``plain(d, th, t)``; lines s to e, each pair once."""
    df = _chunks(_facts(plain))
    found = "chunks"
    if run_words is not None:
        # as whole numbers, of which duplicates are found by hashing; of structs, Spark compares each with each
        keys = "array_distinct(transform(concat(chunks, runs), v -> cast(v.s as bigint) * 2147483648L + v.e))"
        df, found = _runs(df, run_words), f"transform({keys}, x -> named_struct('s', cast(shiftright(x, 31) as int), 'e', cast(x & 2147483647L as int)))"
    df = df.withColumn("ids", F.expr("transform(facts, x -> x.h)")).withColumn("found", F.expr(found))
    df = df.select("d", "th", F.explode(F.expr(f"transform(found, v -> named_struct('h', xxhash64({_slice('ids')}), 's', v.s, 'e', v.e))")).alias("v"))
    return df.select("d", "th", "v.h", "v.s", "v.e")


def _differing(hit: DataFrame) -> DataFrame:
    """``h`` of the passages in ``hit(t, v)`` that share their hash with other bytes.

    Equal bytes are equal lines in equal order. So the least and the greatest row of line hashes of each ``h`` must be the same, and so
    must the least and the greatest text of each line hash: every line goes through the comparison once for a document, not once for each passage.
    """
    df = _facts(hit).withColumn("ids", F.expr("transform(facts, x -> x.h)"))
    rows = df.select(F.explode(F.expr(f"transform(v, v -> named_struct('h', v.h, 'ids', {_slice('ids')}))")).alias("r")).select("r.*")
    uneven = rows.groupBy("h").agg(F.min("ids").alias("lo"), F.max("ids").alias("hi")).where("lo <> hi").select("h")
    used = f"array_distinct(flatten(transform(v, v -> {_slice('lines')})))"
    lines = df.select(F.explode(F.expr(used)).alias("x")).select(F.expr(LINE_HASH).alias("h"), "x")
    mixed = saved(lines.groupBy("h").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("h"))
    if mixed.head(1):
        # two different lines with one 64-bit hash: whatever holds such a line is grouped again
        at = rows.select("h", F.explode("ids").alias("line")).distinct()
        uneven = uneven.union(at.join(mixed.select(F.col("h").alias("line")), "line", "left_semi").select("h"))
    out = saved(uneven.distinct())
    discard(mixed)
    return out


def _grouped_by_text(whole: DataFrame, places: DataFrame, wrong: DataFrame) -> DataFrame:
    """``(d, th, r)`` of the places whose hash is in ``wrong``, grouped by the passage's text itself; of those that repeat."""
    own = places.join(wrong, "h").groupBy("d", "th").agg(F.collect_set(F.struct("h", "s", "e")).alias("v"))
    df = _with(whole.select("d", "th", "t").dropDuplicates(["d", "th"]), own).where("size(v) > 0").withColumn("lines", F.expr("split(t, '\\n', -1)"))
    df = df.select("d", "th", F.explode(F.expr(f"transform(v, v -> named_struct('h', v.h, 's', v.s, 'e', v.e, 'x', array_join({_slice('lines')}, '\\n')))")).alias("v")).select("d", "th", "v.*")
    df = saved(df)
    first = df.groupBy("x").agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "s", "e")).alias("f")).where("n > 1")
    hits = df.join(first.select("x", F.col("f.d").alias("fd"), F.col("f.th").alias("fth"), F.col("f.e").alias("fe")).hint("merge"), "x")
    out = saved(hits.select("d", "th", F.struct("h", "s", "e", F.expr(CUT).alias("c")).alias("r")))
    discard(df)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats: bool = False, run_words: int | None = None) -> DataFrame:
    """``docs`` with every repeated multi-line chunk of ``text_col`` removed but for its first place.

    Places are ordered by id (null first), a hash of the whole text, and position. Chunks of white space only are
    left. Null text stays null and empty text stays empty; a document made of repeats only becomes empty; rows are never dropped.
    Rows with equal id and equal text are one document: all keep what the first place keeps. Passages whose hash is equal
    but whose bytes differ are grouped again by their text, so equal bytes go, and nothing else, whatever collides. An empty table gives an empty result.

    Chunk boundaries depend on the lines around a passage. With ``run_words`` every repeated run of lines with more words
    goes as well, wherever the boundaries fall, single lines among them; a run that overlaps its own first place goes from where that ends.

    Other columns pass through untouched whatever their names. ``stats`` adds ``removed_passages`` (places taken out, which may overlap)
    and ``removed_lines``; a column of ``docs`` with such a name gives way to it.
    """
    whole = docs.select(packed(docs, (text_col,)).alias("doc"), F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("t"))
    places = saved(passages(whole.select("d", "th", "t").where("t is not null"), run_words))
    seen = places.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "s", "e")).alias("f"))
    first = saved(seen.where("n > 1").select("h", F.col("f.d").alias("fd"), F.col("f.th").alias("fth"), F.col("f.e").alias("fe")))
    # sort-merge joins at every size: the plan, and with it the disk, does not change
    hits = places.join(first.hint("merge"), "h").withColumn("c", F.expr(CUT))
    drop = saved(hits.groupBy("d", "th").agg(F.collect_set(F.struct("h", "s", "e", "c")).alias("v")))
    joined = saved(_with(whole, drop))
    wrong = _differing(joined.where("size(v) > 0").select("t", "v"))
    if wrong.head(1):
        left, again = joined.select("d", "th", F.explode("v").alias("r")).join(wrong, F.col("r.h") == wrong.h, "left_anti"), _grouped_by_text(whole, places, wrong)
        before, joined = joined, saved(_with(joined.drop("v"), left.unionByName(again).groupBy("d", "th").agg(F.collect_set("r").alias("v"))))
        discard(before, again)
    discard(places, first, drop, wrong)
    gone = "array_distinct(flatten(transform(filter(v, r -> r.c <= r.e), r -> sequence(r.c, r.e))))"
    out = joined.withColumn("lines", F.expr("if(size(v) > 0, split(t, '\\n', -1), null)")).withColumn("gone", F.expr(gone))
    out = out.withColumn("rest", F.expr("array_except(sequence(0, size(lines) - 1), gone)"))
    text = F.expr("if(coalesce(size(gone), 0) < 1, t, array_join(transform(rest, i -> lines[i]), '\\n'))")
    # the generator holds filters back: pushed down they would be copied into the lambdas
    out = out.withColumn("new", F.explode_outer(F.array(text)))
    cols = unpacked(docs, "doc", {text_col: F.col("new")})
    if stats:
        names = ("removed_passages", "removed_lines")
        cols = [c for c, name in zip(cols, docs.columns, strict=True) if name.lower() not in names]
        cols += [F.expr("coalesce(size(filter(v, r -> r.c <= r.e)), 0)").alias(names[0]), F.expr("greatest(0, coalesce(size(gone), 0))").alias(names[1])]
    return out.select(*cols)


def _with(rows: DataFrame, drop: DataFrame) -> DataFrame:
    d = drop.select(F.col("d").alias("dd"), F.col("th").alias("dth"), "v")
    return rows.join(d.hint("merge"), F.col("d").eqNullSafe(F.col("dd")) & (F.col("th") == F.col("dth")), "left").drop("dd", "dth")
