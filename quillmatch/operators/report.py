"""Report figures from compare_info rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_round
from ..schema import DEFAULT_THRESHOLD

MOST_HEADS = 3


def percent_matrix(matrix) -> list[list[float]]:
    """Ratios as percentages with two digits."""
    return [[round(int(num) / int(den) * 100, 2) for num, den in row] for row in matrix]


def percent_matrix_column(matrix: Column | str, scale: bool = True) -> Column:
    m = F.col(matrix) if isinstance(matrix, str) else matrix
    return F.transform(m, lambda row: F.transform(row, lambda c: c[0].cast("double") / c[1] * (100 if scale else 1)))


def most_similar(cells, threshold: float = DEFAULT_THRESHOLD, below: bool = True, n: int = MOST_HEADS) -> list[tuple[str, float]]:
    """Of (head, percent) cells in their order, those to list, the largest first.

    A cell at the threshold is listed while fewer than n are; after that it has to
    beat the weakest one listed (the earliest of equal ones), which it replaces.
    With ``below`` the first cell is listed whatever its percent. Any other cell
    under the threshold can only replace a single listed one that it beats. A head
    met again takes the new percent. Equal percents keep the order of listing."""
    listed: dict[str, float] = {}
    for head, percent in cells:
        weakest = min(listed, key=listed.__getitem__, default=None)
        if percent >= threshold:
            rival = weakest if len(listed) >= n else None
        elif weakest is None and below:
            rival = None
        elif len(listed) == 1:
            rival = weakest
        else:
            continue
        if rival is not None:
            if percent <= listed[rival]:
                continue
            del listed[rival]
        listed[head] = percent
    return sorted(listed.items(), key=lambda cell: cell[1], reverse=True)


def same_functions(first: list[str], second: list[str], percents, threshold: float = DEFAULT_THRESHOLD, below: bool = True, n: int = MOST_HEADS) -> dict[str, list[tuple[str, float]]]:
    """For each head of the first work the (head, percent) of the second that are most alike."""
    return {head: most_similar(zip(second, row), threshold, below, n) for head, row in zip(first, percents)}


SAME = "path string, other_path string, n_heads int, head string, other_head string, percent double, rank int"


def same_heads(compare_info: DataFrame, threshold: int = DEFAULT_THRESHOLD, below: bool = True, n: int = MOST_HEADS) -> DataFrame:
    """A row for each listed head, in both directions of a pair. The fold over the
    columns of the matrix is sequential by definition, so it runs in Arrow batches.
    A head without listed heads has one row with null other_head."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                matrix = percent_matrix([[list(c) for c in row] for row in r.matrix])
                one, two = list(r.first_heads), list(r.second_heads)
                for path, other, a, b, m in ((r.first_path, r.second_path, one, two, matrix), (r.second_path, r.first_path, two, one, [list(x) for x in zip(*matrix)])):
                    for head, found in same_functions(a, b, m, threshold, below, n).items():
                        rows += [(path, other, len(a), head, o, p, k) for k, (o, p) in enumerate(found)] or [(path, other, len(a), head, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "other_path", "n_heads", "head", "other_head", "percent", "rank"])

    slim = compare_info.select("first_path", "second_path", "first_heads", "second_heads", F.col("structure.compliance_matrix").alias("matrix"))
    return slim.mapInPandas(run, SAME)


def head_elements(same: DataFrame) -> DataFrame:
    """Per (path, other_path, head): the largest percent and the number of listed heads."""
    return same.where("other_head is not null").groupBy("path", "other_path", "head").agg(F.max("percent").alias("percent"), F.count("*").alias("cnt_elements"))


def resulting_percentages(same: DataFrame, rounded: bool = True) -> DataFrame:
    """Per path: the sum over heads of the largest percent, over the number of heads."""
    best = same.where("other_head is not null and percent > 0").groupBy("path", "head").agg(F.max("percent").alias("percent"))
    sums = best.groupBy("path").agg(F.sum("percent").alias("total"))
    listed = same.where("other_head is not null").groupBy("path").agg(F.lit(1).alias("one"))
    heads = same.groupBy("path").agg(F.max("n_heads").alias("cnt_head_nodes"))
    out = listed.join(heads, "path").join(sums, "path", "left").withColumn("same_percentage", F.coalesce("total", F.lit(0.0)) / F.col("cnt_head_nodes"))
    return out.select("path", "cnt_head_nodes", (python_round()("same_percentage") if rounded else F.col("same_percentage")).alias("same_percentage"))


def sources_total(percentages: DataFrame, prefix: str, rounded: bool = True) -> DataFrame:
    """Mean percentage of the paths with a prefix; 0.0 without any."""
    mean = percentages.where(F.col("path").startswith(prefix)).agg(F.coalesce(F.avg("same_percentage"), F.lit(0.0)).alias("total_similarity"))
    return mean.select(python_round()("total_similarity").alias("total_similarity")) if rounded else mean


def general_total(infos: DataFrame, firsts: DataFrame, seconds: DataFrame, rounded: bool = True) -> DataFrame:
    """Mean over the first paths of the largest weighted average with any second path, in percent.

    ``infos`` has first_path, second_path (in order) and weighted_average;
    ``firsts`` and ``seconds`` have path. Equal paths meet by a join on both."""
    rows = infos.select(F.col("first_path").alias("p"), F.col("second_path").alias("q"), "weighted_average")
    both = rows.unionByName(rows.select(F.col("q").alias("p"), F.col("p").alias("q"), "weighted_average"))
    f, s = firsts.select(F.col("path").alias("fp")).distinct(), seconds.select(F.col("path").alias("sp")).distinct()
    best = f.join(both.join(s, F.col("q") == F.col("sp")), F.col("fp") == F.col("p"), "left").groupBy("fp").agg(F.greatest(F.coalesce(F.max("weighted_average"), F.lit(0.0)), F.lit(0.0)).alias("best"))
    out = best.agg(F.coalesce(F.sum("best") / F.count("*") * 100, F.lit(0.0)).alias("total_similarity"))
    return out.select(python_round()("total_similarity").alias("total_similarity")) if rounded else out


def unique_paths(infos: DataFrame) -> tuple[DataFrame, DataFrame]:
    return infos.select(F.col("first_path").alias("path")).distinct(), infos.select(F.col("second_path").alias("path")).distinct()


def under_roots(infos: DataFrame, first_root: str | None, second_root: str | None) -> DataFrame:
    """Pairs whose paths begin with the two roots, in order of the roots; both or none."""
    if bool(first_root) != bool(second_root):
        raise ValueError("give both roots or none")
    if not first_root:
        return infos
    a, b = sorted((str(first_root), str(second_root)))
    return infos.where(F.col("first_path").startswith(a) & F.col("second_path").startswith(b))


def compliance_long(infos: DataFrame) -> DataFrame:
    """A row for each cell of the matrix with its heads and its ratio."""
    rows = infos.select("first_path", "second_path", "first_heads", "second_heads", F.posexplode("structure.compliance_matrix").alias("i", "row"))
    cells = rows.select("*", F.posexplode("row").alias("j", "cell"))
    return cells.select("first_path", "second_path", "i", "j", F.get("first_heads", F.col("i")).alias("first_head"), F.get("second_heads", F.col("j")).alias("second_head"), (F.get("cell", F.lit(0)) / F.get("cell", F.lit(1))).alias("ratio"))


def compliance_table(row) -> pd.DataFrame:
    """The matrix of one compare_info row as a table labelled by the heads."""
    cells = [[cell[0] / cell[1] for cell in line] for line in row["structure"]["compliance_matrix"] or []]
    if not cells:
        return pd.DataFrame()
    pad = lambda names, size: [*names, *[""] * size][:size]
    return pd.DataFrame(cells, index=pad(row["first_heads"], len(cells)), columns=pad(row["second_heads"], len(cells[0])), dtype=object)
