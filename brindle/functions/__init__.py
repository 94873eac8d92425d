"""Column functions: text, fuzzy score, lenient JSON."""

from brindle.functions.score import score, score_column
from brindle.functions.text import ascii_lower, bytes_as_chars, equals_ignore_case, extension, is_file_token, kind_name, kind_of, normal_path, tokens

__all__ = ["ascii_lower", "bytes_as_chars", "equals_ignore_case", "extension", "is_file_token", "kind_name", "kind_of", "normal_path", "score", "score_column", "tokens"]
