"""From works (path and source) to feature rows.

Front ends are registered by extension; a front end has ``decode(bytes)`` and
``extract(code, path)``. Parsing runs in Arrow batches; all else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from . import c_source, html_tree, python_source

_front_ends: dict[str, ModuleType] = {"py": python_source, "cpp": c_source, "html": html_tree}


def register(extension: str, front_end: ModuleType) -> None:
    """Add a language."""
    _front_ends[extension] = front_end


def front_end(extension: str) -> ModuleType:
    if extension not in _front_ends:
        raise ValueError(f"no front end for '{extension}'")
    return _front_ends[extension]


def features_from_works(works: DataFrame, extension: str) -> DataFrame:
    """One feature row for each work that can be parsed and has nodes.

    ``works`` has filepath, code, modify_date and collection_id; a work is its
    path, so of works with one path a single one is kept.
    """
    language = front_end(extension)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, code, date, collection in batch[["filepath", "code", "modify_date", "collection_id"]].itertuples(index=False):
                found = language.extract(code, path) if code is not None else None
                if found is not None and found["count_of_nodes"]:
                    rows.append({"filepath": path, "modify_date": date, "collection_id": collection} | _plain(found))
            yield pd.DataFrame(rows, columns=FEATURES.names)

    return works.dropDuplicates(["filepath"]).mapInPandas(run, FEATURES)


def _plain(found: dict) -> dict:
    out = dict(found)
    out["structure"] = [{"depth": d, "uid": u} for d, u in found["structure"]]
    out["tokens_pos"] = [{"lineno": a, "col_offset": b} for a, b in found["tokens_pos"]]
    return out


def decode_udf(extension: str) -> Column:
    """Column function from file contents to text; null where the file can't be read."""
    language = front_end(extension)

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: language.decode(bytes(b)))

    return run


def text_features(df: DataFrame, key: str, text: str, collection: str | None = None) -> DataFrame:
    """Feature rows of prose: words as tokens, punctuation as operators, function
    words as keywords, and words with digits as literals. All built-in functions."""
    from ..functions.counters import count_map
    from ..functions.text import words

    marks = list(".,;:!?")
    function_words = "the of and to in a is that it for on was as with be by are this at from".split()
    t = words(F.col(text))
    df = df.select(F.col(key).cast("string").alias("filepath"), (F.col(collection) if collection else F.lit(None).cast("string")).alias("collection_id"), t.alias("tokens"), F.col(text).alias("_text"))
    present = F.filter(F.array(*[F.struct(F.lit(m).alias("k"), (F.length("_text") - F.length(F.replace("_text", F.lit(m)))).cast("int").alias("v")) for m in marks]), lambda x: x["v"] > 0)
    # Filtered first, or each item's count would filter the tokens again.
    chosen = df.select("filepath", "collection_id", "tokens", F.map_from_entries(present).alias("operators"), F.filter("tokens", lambda w: w.isin(function_words)).alias("_k"), F.filter("tokens", lambda w: w.rlike("[0-9]")).alias("_l"))
    return chosen.select("filepath", "collection_id", "tokens", "operators", count_map("_k").alias("keywords"), count_map("_l").alias("literals"))
