"""Text, number and URL helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import col

SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column | str) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(col(text)), SPACES), lambda w: w != "")


def python_round(digits: int = 2):
    """Rounding of the exact binary value, half to even, as Python does it."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(float(v), digits))

    return run


def percent_text(x: Column | str) -> Column:
    return F.concat(F.format_number(col(x) * 100, 2), F.lit("%"))


def without_blank_lines(code: Column | str) -> Column:
    return F.regexp_replace(col(code), "\n+", "\n")


def text_lengths(code: Column | str) -> dict[str, Column]:
    """Lengths of a text, without blanks, and its number of lines."""
    c = col(code)
    lines = F.size(F.split(c, "\n")) - F.when(c.endswith("\n") | (c == ""), 1).otherwise(0)
    return {
        "content_len": F.length(c).cast("long"),
        "content_len_without_blank": F.length(F.translate(c, " \n\t", "")).cast("long"),
        "count_lines_without_blank_lines": lines.cast("long"),
    }


def list_text(items: Column | str) -> Column:
    """A list of strings as Python writes it, with single quotes."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(items), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def parse_list_text(text: Column | str) -> Column:
    """The strings of such a list: split at comma and space, less one character at both ends."""
    inner = F.substring(col(text), 2, 2**31 - 1)
    inner = F.left(inner, F.greatest(F.length(inner) - 1, F.lit(0)))
    items = F.transform(F.split(inner, ", "), lambda x: F.left(F.substring(x, 2, 2**31 - 1), F.greatest(F.length(x) - 2, F.lit(0))))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(items)


def matrix_text(matrix: Column | str) -> Column:
    return F.regexp_replace(F.to_json(col(matrix)), ",", ", ")


def parse_matrix_text(text: Column | str) -> Column:
    return F.from_json(col(text), "array<array<array<bigint>>>")


def url_parts(url: Column | str) -> Column:
    return F.split(F.regexp_replace(col(url), "/+$", ""), "/")


def host_url(url: Column | str, host: str = "github.com") -> Column:
    """struct(kind, owner, repo, branch, path) of a link to the host; null for other URLs.

    kind is repo (owner and name), content (a path in a branch) or other.
    """
    p = url_parts(url)
    n = F.size(p)
    valid = (n >= 3) & F.get(p, F.lit(0)).isin("https:", "http:") & (F.get(p, F.lit(1)) == "") & (F.get(p, F.lit(2)) == host)
    content = n > 7
    kind = F.when(n == 5, "repo").when(content, "content").otherwise("other")
    owner = F.when((n == 5) | content, F.get(p, F.lit(3)))
    repo = F.when((n == 5) | content, F.get(p, F.lit(4)))
    return F.when(valid, F.struct(
        kind.alias("kind"), owner.alias("owner"), repo.alias("repo"), F.when(content, F.get(p, F.lit(6))).alias("branch"),
        F.when(content, F.array_join(F.slice(p, 8, F.greatest(n - 7, F.lit(0))), "/")).alias("path"),
    ))
