"""Search that reads only what can reach the result: names clustered by length and in order, with bounds of the score for each length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.score import _byte_lower, with_score
from brindle.functions.text import ascii_lower, bytes_as_chars
from brindle.model import DEFAULT_LIMIT
from brindle.plans.search import QuerySpec, candidates, compile_query, ranked

#: Bytes of a name that share a band, rows of a page (what the reader can skip), and the share of the rows that looks may read.
BAND, PAGE_ROWS, LOOKS = 8, 1024, 1 / 8
CLUSTERED = "name string, kind string, file string, line int, ord long, low string, band int"


def save_clustered(declarations: DataFrame, folder: str, page_rows: int = PAGE_ROWS) -> None:
    """Write the declarations by bands of name length, within a band in order of the folded name, in pages of ``page_rows`` rows with statistics.

    A band is a folder, so a search leaves whole bands out; within a band an equal or beginning name is found by the pages' bounds.
    """
    low = ascii_lower(bytes_as_chars("name"))
    rows = declarations.withColumn("low", low).withColumn("band", F.expr(f"cast(length(low) div {BAND} as int)"))
    rows = rows.repartitionByRange("band", "low").sortWithinPartitions("band", "low")
    rows.select(*[c.split()[0] for c in CLUSTERED.split(", ")]).write.option("parquet.page.row.count.limit", page_rows).partitionBy("band").mode("overwrite").parquet(folder)


@dataclass
class Clustered:
    """A table that ``save_clustered`` wrote, with the rows of each band, of which there are few."""

    rows: DataFrame
    bands: dict[int, int]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Clustered:
        rows = spark.read.schema(CLUSTERED).parquet(folder)
        return cls(rows, {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()})


def best_subsequence(pattern_bytes: int, name_bytes: int) -> int:
    """The most that a name of so many bytes or more can score unless the pattern begins it: every byte at a word's begin, in its case and, but
    for the first, right behind the one before."""
    return max(1, 35 * pattern_bytes - 10 - name_bytes // 4)


def _best(rows: DataFrame, spec: QuerySpec, limit: int, reads: list[int] | None) -> list[int]:
    found = candidates(rows, spec).select("score").orderBy(F.desc("score")).limit(limit)
    scores = [r["score"] for r in found.collect()]
    if reads is not None:
        reads.append(rows_read(found))
    return scores


def search_clustered(table: Clustered, text: str | None, limit: int = DEFAULT_LIMIT, reads: list[int] | None = None) -> DataFrame:
    """``search`` over a clustered table, with the same rows and the same ties.

    Names that begin with the pattern are found by their order; all others score at most ``best_subsequence``, which falls with the length. So bands are looked
    into from the shortest on while that takes no more than ``LOOKS`` of the rows, until the last of ``limit`` scores is above the bound of the bands left; then
    one plan reads what may still be in the result. A text without a name part, for which all rows score alike, and one with more than 2^20 results are searched as ``search`` does.
    ``reads`` gets the rows that each look has read.
    """
    spec, limit = compile_query(text), limit if limit > 0 else DEFAULT_LIMIT
    _, low = _byte_lower(spec.name)
    rows, size, bands = table.rows, len(low), sorted(table.bands)
    if not low or limit > 1 << 20:
        return _top(candidates(rows, spec), limit)
    begins = rows.where(F.col("low").startswith(low) & (F.col("band") >= size // BAND))
    others = rows.where(~F.col("low").startswith(low))
    bands = [b for b in bands if (b + 1) * BAND > size]
    scores = _best(begins, spec, limit, reads)
    last = lambda: scores[limit - 1] if len(scores) >= limit else 0
    bound = lambda i: best_subsequence(size, max(size, bands[i] * BAND))
    seen, looked = 0, 0
    while seen < len(bands) and bound(seen) >= max(1, last()):
        looked += table.bands[bands[seen]]
        if looked > LOOKS * sum(table.bands.values()):
            break
        scores = sorted(scores + _best(others.where(F.col("band") == bands[seen]), spec, limit, reads), reverse=True)[:limit]
        seen += 1
    while seen < len(bands) and bound(seen) >= max(1, last()):
        seen += 1
    found = candidates(begins, spec)
    if seen:
        found = found.unionByName(candidates(others.where(F.col("band").isin(bands[:seen])), spec))
    return _top(found, limit)


def _top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(*ranked(rows)).limit(limit).select("name", "kind", "file", "line", "score")


def rows_read(run: DataFrame) -> int:
    """Rows that the scans of a plan gave when it ran; ``run`` must have been collected."""
    plan = run._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            inner = leaf.plan().collectLeaves()
            total += sum(inner.apply(k).metrics().apply("numOutputRows").value() for k in range(inner.length()) if inner.apply(k).metrics().contains("numOutputRows"))
        elif leaf.metrics().contains("numOutputRows"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total
