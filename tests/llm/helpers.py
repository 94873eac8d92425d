"""A small hostile documents table: nulls, empty and long texts, repeated rows and ids, clashing extra columns."""

#: Extra columns with names that operators use for themselves, or for results, each with its value.
EXTRA = {"t": "clash", "id": 99, "block": 3, "fp": 4, "k": "k", "label": 1}
EXTRA |= {n: f"own {n}" for n in ("_lines", "_text", "_ends", "_facts", "_roll", "__text", "__h0", "doc", "d", "th", "v", "h", "wid", "c0", "lines", "facts", "new", "gone", "lang_best", "lang_log", "_")}
RESULTS = {n: f"own {n}" for n in ("score", "lang_pred", "n_tokens", "removed_lines", "ids")}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {'string' if isinstance(x, str) else 'long'}" for n, x in (EXTRA | RESULTS).items())
LONG = " ".join(f"word{i % 37} and\nmore" for i in range(4000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "s"),
    (2, "The quick brown fox jumps over the lazy dog", "en", "s"),
    (2, "The quick brown fox jumps over the lazy dog", "en", "s"),
    (2, "another text under the same id", "en", None),
    (3, None, "en", None),
    (4, "", None, None),
    (5, "   \n\t ", "de", None),
    (None, "no id here, alas", "en", None),
    (None, None, None, None),
    (6, LONG, "en", "s"),
    (7, "der schnelle braune Fuchs springt über den faulen Hund", "de", "s"),
    (8, "word", "de", "s"),
    (9, "ÀÉ ẞ ﬁ 梦 😀 <|endoftext|> <|im_start|>  double  blanks   x", "fr", "s"),
    (10, "12345 --- 678", "fr", "s"),
]


def rows():
    return [(*r, None, *EXTRA.values(), *RESULTS.values()) for r in ROWS]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def assert_extras(rows, but=()):
    """Every extra column that is no result has the value it came with."""
    for r in rows:
        assert {n: r[n] for n in EXTRA | RESULTS if n not in but} == {n: x for n, x in (EXTRA | RESULTS).items() if n not in but}
