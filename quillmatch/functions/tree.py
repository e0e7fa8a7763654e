"""Similarity of trees given as depths in pre-order. Labels play no part."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import col

Ratio = tuple[int, int]
Depths = tuple[int, ...]


def children_indexes(depths: Sequence[int]) -> list[int]:
    """Places of the nodes that stand as high as the first."""
    return [i for i, d in enumerate(depths) if d == depths[0]]


def subtrees(depths: Depths) -> list[Depths]:
    """The segments that begin at the children, roots included, counted from depth 0."""
    at = [*children_indexes(depths), len(depths)] if depths else [0]
    return [tuple(d - depths[0] for d in depths[a:b]) for a, b in zip(at, at[1:])]


def best_cell(matrix) -> tuple[int, int]:
    """Place of the largest ratio, the first by rows; (0, 0) if there is none."""
    best, place = 0.0, (0, 0)
    for i, row in enumerate(matrix):
        for j, (num, den) in enumerate(row):
            if den and num / den > best:
                best, place = num / den, (i, j)
    return place


def assign(matrix) -> tuple[Ratio, list[tuple[int, int]]]:
    """Greedy pairs of rows and columns, the largest ratio first; the ratio begins
    as 1 / 1 and takes in numerators and denominators of the cells taken."""
    cells = sorted(((-num / den, i, j) for i, row in enumerate(matrix) for j, (num, den) in enumerate(row) if den))
    rows: set[int] = set()
    columns: set[int] = set()
    num, den, taken = 1, 1, []
    for _, i, j in cells:
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            taken.append((i, j))
            num += int(matrix[i][j][0])
            den += int(matrix[i][j][1])
    return (num, den), taken


def unmatched_size(parts: Sequence[Sequence], used: set[int]) -> int:
    """Nodes of the subtrees that have no partner."""
    return sum(len(p) for k, p in enumerate(parts) if k not in used)


@lru_cache(maxsize=200_000)
def _ratio(a: Depths, b: Depths) -> Ratio:
    if not a or not b:
        return 1, 1 + len(a) + len(b)
    return _cells(a, b)[0]


def _cells(a: Depths, b: Depths) -> tuple[Ratio, list[list[Ratio]]]:
    left, right = subtrees(a), subtrees(b)
    matrix = [[_ratio(_inner(x), _inner(y)) for y in right] for x in left]
    (num, den), taken = assign(matrix)
    if len(left) > len(right):
        den += unmatched_size(left, {i for i, _ in taken})
    elif len(right) > len(left):
        den += unmatched_size(right, {j for _, j in taken})
    return (num, den), matrix


def _inner(segment: Depths) -> Depths:
    rest = segment[1:]
    return tuple(d - rest[0] for d in rest) if rest else ()


def struct_compare(a: Sequence[int], b: Sequence[int]) -> tuple[Ratio, list[list[Ratio]]]:
    """((numerator, denominator), matrix of the children's ratios)."""
    if not len(a) or not len(b):
        return _ratio(tuple(a), tuple(b)), []
    deepest = max(max(a), max(b))
    if sys.getrecursionlimit() < 10 * deepest + 1000:
        sys.setrecursionlimit(10 * deepest + 1000)
    return _cells(tuple(int(d) - int(a[0]) for d in a), tuple(int(d) - int(b[0]) for d in b))


RESULT = "num long, den long, compliance_matrix array<array<array<long>>>"


def struct_compare_udf():
    """Arrow UDF over two columns of depths; equal subtrees of a batch are compared once."""

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [struct_compare(x.tolist(), y.tolist()) for x, y in zip(a, b)]
        return pd.DataFrame({
            "num": [r[0] for r, _ in out], "den": [r[1] for r, _ in out],
            "compliance_matrix": [[[list(c) for c in row] for row in m] for _, m in out],
        })

    return run


def depths(structure: Column | str, max_depth: int | None = None) -> Column:
    """Depths of a structure's nodes, those above ``max_depth`` only."""
    s = col(structure)
    s = s if max_depth is None else F.filter(s, lambda x: x["depth"] <= max_depth)
    return F.transform(s, lambda x: x["depth"])


def structure_sha256(structure: Column | str) -> Column:
    """SHA-256 of the list of node ids, written as ``[0, 1, 2]``."""
    ids = F.array_join(F.transform(col(structure), lambda x: x["uid"].cast("string")), ", ")
    return F.sha2(F.concat(F.lit("["), ids, F.lit("]")), 256)
