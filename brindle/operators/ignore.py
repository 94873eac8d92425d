"""Ignore rules: text -> rules -> one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import col, normal_path


@dataclass(frozen=True)
class Rule:
    """A directory prefix (``build/*`` keeps ``build/``) or an exact path."""

    pattern: str
    is_glob: bool


def normalised(path: str) -> str:
    path = path.replace("\\", "/")
    return path[2:] if path.startswith("./") else path


def parse_rules(text: str) -> list[Rule]:
    """One rule a line; a trailing CR, blank lines and lines that begin with ``#`` go; nothing is trimmed."""
    out = []
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line and line[0] != "#":
            p = normalised(line)
            out.append(Rule(p[:-1], True) if p.endswith("/*") else Rule(p, False))
    return out


def parsed_rules(text: Column) -> Column:
    """The same for a column of file texts: an array of ``(pattern, is_glob)``."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    paths = F.transform(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), normal_path)
    return F.transform(paths, lambda p: F.struct(F.when(F.endswith(p, F.lit("/*")), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p).alias("pattern"), F.endswith(p, F.lit("/*")).alias("is_glob")))


def is_ignored(path: Column | str, rules: list[Rule]) -> Column:
    """Any rule matches. Exact rules become one membership test, prefixes a chain of prefix tests."""
    p = normal_path(col(path))
    exact = [r.pattern for r in rules if not r.is_glob]
    tests = [F.startswith(p, F.lit(r.pattern)) for r in rules if r.is_glob] + ([p.isin(*exact)] if exact else [])
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def not_ignored(files: DataFrame, rules: list[Rule], path: str = "path") -> DataFrame:
    return files.where(~is_ignored(path, rules))


def not_ignored_by(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``files`` that no rule of a table ``(pattern, is_glob)`` ignores, for any number of rules.

    A prefix rule ends with a slash, so it is one of a path's ancestors: each path is exploded into its ancestors and itself, which meet the rules in a hash
    join (Spark broadcasts the rules while they are small). Paths are compared once, however many rows have them.
    """
    p = normal_path(F.col(f"`{path}`"))
    paths = files.select(F.col(f"`{path}`").alias("path"), p.alias("p")).distinct()
    slashes = F.filter(F.sequence(F.lit(1), F.length("p")), lambda i: F.substring(F.col("p"), i, F.lit(1)) == "/")
    keys = F.concat(F.transform(slashes, lambda i: F.struct(F.substring(F.col("p"), F.lit(1), i).alias("pattern"), F.lit(True).alias("is_glob"))), F.array(F.struct(F.col("p").alias("pattern"), F.lit(False).alias("is_glob"))))
    hit = paths.where("p <> ''").select("path", F.explode(keys).alias("k")).select("path", "k.*").join(rules.select("pattern", "is_glob").distinct(), ["pattern", "is_glob"], "left_semi")
    return files.join(hit.select(F.col("path").alias("__ignored")).distinct(), F.col(f"`{path}`") == F.col("__ignored"), "left_anti")
