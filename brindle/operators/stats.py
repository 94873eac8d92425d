"""Counts and reports over the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import col
from brindle.model import SLOWEST


def counts(declarations: DataFrame, records: DataFrame) -> DataFrame:
    """One row: declarations, files that have some, and recorded files."""
    d = declarations.agg(F.count("*").alias("declarations"), F.count_distinct("file").alias("files_with_declarations"))
    return d.crossJoin(records.agg(F.count("*").alias("files")))


def slowest(parsed: DataFrame, n: int = SLOWEST) -> DataFrame:
    """The files that took longest, ties by path."""
    return parsed.orderBy(F.desc("seconds"), "path").limit(n)


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))


def deduplicated(captures: DataFrame) -> DataFrame:
    """One capture for each file and offset."""
    return captures.dropDuplicates(["file", "byte_offset"])


def line_of(content: Column | str, offset: Column | str) -> Column:
    """1 + line feeds before a byte offset of a text column."""
    head = F.substring(F.decode(F.encode(col(content), "UTF-8"), "ISO-8859-1"), F.lit(1), col(offset))
    return 1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
