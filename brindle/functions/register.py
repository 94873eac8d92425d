"""The functions under names for SQL: temporary functions of a session without Python in them, and one table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import LOWER, UPPER
from brindle.model import KINDS

_KINDS = ", ".join(f"'{k}'" for k in KINDS)


def _low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _raw(x: str) -> str:
    return f"decode(encode({x}, 'UTF-8'), 'ISO-8859-1')"


#: The rules of the score, for one name and one pattern: positions first (-1 from the first miss on), then the sum over them.
_STEP = f"coalesce(nullif(locate(substring({_low(_raw('pattern'))}, i, 1), {_low(_raw('name'))}, element_at(acc, -1) + 1), 0), -1)"
_POSITIONS = f"aggregate(sequence(1, octet_length(pattern)), array(0), (acc, i) -> array_append(acc, if(element_at(acc, -1) < 0, -1, {_STEP})))"
_GAIN = f"""aggregate(sequence(1, octet_length(pattern)), 0, (s, i) -> s + if(i > 1 AND ps[i] = ps[i - 1] + 1, 10, 0)
  + if(ps[i] = 1 OR substring({_raw("name")}, ps[i] - 1, 1) IN ('_', ':') OR (substring({_raw("name")}, ps[i] - 1, 1) BETWEEN 'a' AND 'z' AND substring({_raw("name")}, ps[i], 1) BETWEEN 'A' AND 'Z'), 20, 0)
  + if(substring({_raw("name")}, ps[i], 1) = substring({_raw("pattern")}, i, 1), 5, 0))"""
_SCORE = f"""CASE WHEN name IS NULL OR pattern IS NULL THEN NULL WHEN pattern = '' THEN 0 WHEN octet_length(name) < octet_length(pattern) THEN NULL
  WHEN {_low("name")} = {_low("pattern")} THEN 1000
  WHEN startswith({_low("name")}, {_low("pattern")}) THEN 500 + greatest(0, 100 - (octet_length(name) - octet_length(pattern)))
  ELSE transform(array({_POSITIONS}), ps -> if(element_at(ps, -1) < 0, NULL, greatest(1, {_GAIN} - cast(octet_length(name) div 4 AS INT))))[0] END"""

FUNCTIONS = {
    "ascii_lower(s STRING) RETURNS STRING": _low("s"),
    "normal_path(p STRING) RETURNS STRING": "regexp_replace(translate(p, chr(92), '/'), '^[.]/', '')",
    "file_extension(p STRING) RETURNS STRING": "regexp_extract(p, '(?:^|/)[^/]+[.]([^./]*)$', 1)",
    "query_tokens(s STRING) RETURNS ARRAY<STRING>": "filter(split(s, ' '), x -> x <> '')",
    "is_file_token(s STRING) RETURNS BOOLEAN": "instr(s, '/') > 0 OR instr(s, chr(92)) > 0 OR instr(s, '.') > 0",
    "kind_of(s STRING) RETURNS STRING": f"if({_low('s')} IN ({_KINDS}), {_low('s')}, NULL)",
    "fuzzy_score(name STRING, pattern STRING) RETURNS INT": _SCORE,
}


class ExtractDeclarations:
    """The declarations of one source, by offset; null or what cannot be read has none."""

    def eval(self, content: bytes):
        from brindle.operators.extract import scan

        try:
            yield from scan(bytes(content)) if content is not None else ()
        except RecursionError:
            return


def register(spark: SparkSession) -> list[str]:
    """Registers ``ascii_lower, normal_path, file_extension, query_tokens, is_file_token, kind_of`` and ``fuzzy_score``, and the table function
    ``extract_declarations(content)`` (``name, kind, line, byte_offset, byte_end``) for use behind ``LATERAL``; returns the names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("extract_declarations", F.udtf(ExtractDeclarations, returnType="name string, kind string, line int, byte_offset int, byte_end int", useArrow=True))
    return [*(h.split("(")[0] for h in FUNCTIONS), "extract_declarations"]
