"""Fuzzy score of a name for a pattern, as column expressions.

Rules, the first that applies: an empty pattern scores 0; an empty name, or a pattern longer than the name, does not match;
equal but for case scores 1000; a prefix but for case scores 500 + max(0, 100 - surplus length); else the pattern is
matched as a leftmost subsequence, each byte earning 10 right after the previous match, 20 at a word boundary and 5
in the same case, less a quarter of the name's length, 1 at least. No match is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import LOWER, UPPER, ascii_lower, bytes_as_chars, col


def _byte_lower(pattern: str) -> tuple[str, str]:
    raw = pattern.encode().decode("latin-1")
    return raw, raw.translate(str.maketrans(UPPER, LOWER))


def _starts_word(raw: Column, at: Column) -> Column:
    prev, here = F.substring(raw, at - 1, F.lit(1)), F.substring(raw, at, F.lit(1))
    return (at == 1) | prev.isin("_", ":") | (prev.between("a", "z") & here.between("A", "Z"))


def _word_start(at: str) -> str:
    """The same as text, for the raw name in ``__raw``."""
    prev = f"substring(__raw, {at} - 1, 1)"
    return f"{at} = 1 OR {prev} IN ('_', ':') OR ({prev} BETWEEN 'a' AND 'z' AND substring(__raw, {at}, 1) BETWEEN 'A' AND 'Z')"


def score(name: Column | str, pattern: str) -> Column:
    """Score for one pattern known when the query is planned, as a single expression."""
    if not pattern:
        return F.when(col(name).isNotNull(), F.lit(0))
    raw_p, low_p = _byte_lower(pattern)
    n = len(raw_p)
    raw = bytes_as_chars(name)
    low = ascii_lower(raw)
    size = F.length(raw)
    return (
        F.when(size < n, F.lit(None).cast("int"))
        .when((size == n) & (low == F.lit(low_p)), F.lit(1000))
        .when(F.startswith(low, F.lit(low_p)), 500 + F.greatest(F.lit(0), 100 - (size - n)))
        .otherwise(_subsequence(raw, low, size, F.lit(raw_p), F.lit(low_p), n))
    ).cast("int")


def _subsequence(raw: Column, low: Column, size: Column, raw_p: Column, low_p: Column, n: int | Column) -> Column:
    """Greedy leftmost match, folded over the pattern's positions; state: last position (0: missed), sum."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(True).alias("ok"))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(low_p, i, F.lit(1))
        at = F.when(acc["ok"], F.call_function("locate", c, low, acc["p"] + 1)).otherwise(0)
        earned = (
            F.when((i > 1) & (at == acc["p"] + 1), 10).otherwise(0)
            + F.when(_starts_word(raw, at), 20).otherwise(0)
            + F.when(F.substring(raw, at, F.lit(1)) == F.substring(raw_p, i, F.lit(1)), 5).otherwise(0)
        )
        return F.struct(at.cast("int").alias("p"), (acc["s"] + F.when(at > 0, earned).otherwise(0)).cast("int").alias("s"), (acc["ok"] & (at > 0)).alias("ok"))

    steps = F.sequence(F.lit(1), F.lit(n) if isinstance(n, int) else n)
    return F.aggregate(steps, start, step, lambda acc: F.when(acc["ok"], F.greatest(F.lit(1), acc["s"] - F.floor(size / 4).cast("int"))))


#: Patterns of more bytes are folded instead of unrolled.
UNROLL = 48


def with_score(rows: DataFrame, pattern: str, name: str = "name", out: str = "score") -> DataFrame:
    """``rows`` with a column ``out``, the score for a literal pattern."""
    return with_scores(rows, {out: pattern}, name)


def with_scores(rows: DataFrame, patterns: dict[str, str], name: str = "name") -> DataFrame:
    """One column for each of some literal patterns: a chain of ``locate``, one projection for each byte, all patterns side by side.

    Every link is guarded, as a miss would otherwise restart the search at the front. Each position is used
    several times by the next link, so Catalyst keeps the projections apart and the plan grows linearly; all of them run
    in one generated stage.
    """
    chained = {out: _byte_lower(p) for out, p in patterns.items() if 0 < len(p.encode()) <= UNROLL}
    cols = [F.col(f"`{c}`") for c in rows.columns if c not in patterns]
    others = [score(name, p).alias(out) for out, p in patterns.items() if out not in chained]
    if not chained:
        return rows.select(*cols, *others)
    low, size = F.col("__low"), F.length("__raw")
    d = rows.select(*cols, *others, bytes_as_chars(name).alias("__raw")).withColumn("__low", ascii_lower("__raw"))
    # as texts, since building thousands of column objects takes longer than running them
    kept = [f"`{c}`" for c in d.columns]
    for i in range(max(len(p) for p, _ in chained.values()) + 1):
        step = []
        for k, (raw_p, low_p) in enumerate(chained.values()):
            here, before = f"__p{k}_{i - 1}", f"__p{k}_{i - 2}"
            if i < len(raw_p):
                at = f"locate(chr({ord(low_p[i])}), __low, {here if i else 0} + 1)"
                step.append(f"{f'if({here} > 0, {at}, 0)' if i else at} AS __p{k}_{i}")
            if 0 < i <= len(raw_p):
                gain = f"if({_word_start(here)}, 20, 0) + if(substring(__raw, {here}, 1) = chr({ord(raw_p[i - 1])}), 5, 0)"
                if i > 1:
                    gain += f" + if({here} = {before} + 1, 10, 0) + __s{k}_{i - 2}"
                step += [f"{gain} AS __s{k}_{i - 1}", here]
            elif i > len(raw_p):
                step += [f"__s{k}_{len(raw_p) - 1}", f"__p{k}_{len(raw_p) - 1}"]
        d = d.selectExpr(*kept, *step)

    def value(k: int, raw_p: str, low_p: str) -> Column:
        n = len(raw_p)
        return (
            F.when(size < n, F.lit(None).cast("int"))
            .when((size == n) & (low == F.lit(low_p)), F.lit(1000))
            .when(F.startswith(low, F.lit(low_p)), 500 + F.greatest(F.lit(0), 100 - (size - n)))
            .when(F.col(f"__p{k}_{n - 1}") > 0, F.greatest(F.lit(1), F.col(f"__s{k}_{n - 1}") - F.floor(size / 4).cast("int")))
        ).cast("int")

    done = {out: value(k, *p).alias(out) for k, (out, p) in enumerate(chained.items())}
    return d.select(*cols, *(done.get(out, F.col(f"`{out}`")) for out in patterns))


def score_column(name: Column | str, pattern: Column | str) -> Column:
    """Score for a column of patterns, for batches of queries."""
    raw, raw_p = bytes_as_chars(name), bytes_as_chars(pattern)
    low, low_p, size, n = ascii_lower(raw), ascii_lower(raw_p), F.length(raw), F.length(raw_p)
    return (
        F.when(n == 0, F.when(size.isNotNull(), F.lit(0)))
        .when(size < n, F.lit(None).cast("int"))
        .when((size == n) & (low == low_p), F.lit(1000))
        .when(F.startswith(low, low_p), 500 + F.greatest(F.lit(0), 100 - (size - n)))
        .otherwise(_subsequence(raw, low, size, raw_p, low_p, n))
    ).cast("int")


def scored_pairs(pairs: DataFrame, longest: int, longest_file: int) -> DataFrame:
    """``pairs`` with columns ``name, file`` and patterns ``qname, qfile``: only those whose file and name match, with ``score``.

    The chain of ``locate`` of ``with_scores``, for columns of patterns of at most ``longest`` bytes: in one generated stage, without lambdas
    or regular expressions. Beyond a pattern's end its last position is handed on. Generators hand on what matches; filters would be pushed
    down and copy the chain.
    """
    cols = [f"`{c}`" for c in pairs.columns]
    text, low = (lambda c: f"decode(encode({c}, 'UTF-8'), 'ISO-8859-1')"), (lambda x: f"translate({x}, '{UPPER}', '{LOWER}')")

    def link(out: str, i: int) -> str:
        prev = f"{out}{i - 1}"
        at = f"locate(substring(__q, {i}, 1), __t, {prev if i > 1 else 0} + 1)"
        return f"if(length(__q) >= {i}, {f'if({prev} > 0, {at}, 0)' if i > 1 else at}, {prev if i > 1 else 1}) AS {out}{i}"

    d = pairs
    if longest_file:
        d = d.selectExpr(*cols, f"{low(text('file'))} AS __t", f"{low(text('qfile'))} AS __q")
        for i in range(1, longest_file + 1):
            d = d.selectExpr(*cols, "__t", "__q", link("__f", i))
        d = d.selectExpr(*cols, f"explode(if(__f{longest_file} > 0, array(0), null)) AS __go")
    if not longest:
        return d.selectExpr(*cols, "0 AS score")
    d = d.selectExpr(*cols, f"{text('name')} AS __raw", f"{text('qname')} AS __rq").selectExpr(*cols, "__raw", "__rq", f"{low('__raw')} AS __t", f"{low('__rq')} AS __q")
    for i in range(1, longest + 2):
        step, here = [link("__p", i)] if i <= longest else [], f"__p{i - 1}"
        if i > 1:
            gain = f"if({_word_start(here)}, 20, 0) + if(substring(__raw, {here}, 1) = substring(__rq, {i - 1}, 1), 5, 0)" + (f" + if({here} = __p{i - 2} + 1, 10, 0)" if i > 2 else "")
            step += [f"{f'__s{i - 2}' if i > 2 else 0} + if(length(__rq) >= {i - 1}, {gain}, 0) AS __s{i - 1}", here]
        d = d.selectExpr(*cols, "__raw", "__rq", "__t", "__q", *step)
    value = f"""CASE WHEN __q = '' THEN 0 WHEN length(__t) < length(__q) THEN NULL WHEN __t = __q THEN 1000
      WHEN startswith(__t, __q) THEN 500 + greatest(0, 100 - (length(__t) - length(__q))) WHEN __p{longest} > 0 THEN greatest(1, __s{longest} - cast(length(__t) div 4 AS int)) END"""
    d = d.selectExpr(*cols, f"cast({value} AS int) AS __v")
    return d.selectExpr(*cols, "explode(if(__v IS NOT NULL, array(__v), null)) AS score")


def contains_subsequence(text: Column | str, pattern: str) -> Column:
    """Whether the pattern's bytes occur in order, in any ASCII case: one regular expression, no score."""
    _, low_p = _byte_lower(pattern)
    if not low_p:
        return col(text).isNotNull()
    return ascii_lower(bytes_as_chars(text)).rlike("(?s)^" + "".join(f"[^\\x{ord(c):02x}]*+\\x{ord(c):02x}" for c in low_p))


def subsequence_regex(pattern: Column | str) -> Column:
    """The same expression for a column of patterns, to be matched with ``ascii_lower(bytes_as_chars(...))``. Each step is
    possessive, so a match takes one pass over the text."""
    codes = F.transform(F.filter(F.split(ascii_lower(bytes_as_chars(pattern)), ""), lambda c: c != ""), lambda c: F.hex(F.encode(c, "ISO-8859-1")))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(codes, lambda h: F.concat(F.lit("[^\\x"), h, F.lit("]*+\\x"), h)), ""))
