"""HTML reports."""

from __future__ import annotations

import os
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..schema import DEFAULT_THRESHOLD, REPORT_TYPES

WORDS = {
    "en": {
        "general": "Similar works", "sources": "Sources of works", "first": "First work", "second": "Second work", "date": "Modified", "metric": "Metric", "value": "Value",
        "jakkar": "N-gram overlap", "operators": "Operators", "keywords": "Keywords", "literals": "Literals", "weighted_average": "Weighted average", "structure": "Structure",
        "part": "Part", "similar": "Similar parts", "total": "Total similarity of {}", "same": "Taken from other works", "threshold": "Threshold",
    },
    "ru": {
        "general": "Похожие работы", "sources": "Источники работ", "first": "Первая работа", "second": "Вторая работа", "date": "Изменено", "metric": "Метрика", "value": "Значение",
        "jakkar": "Совпадение N-грамм", "operators": "Операторы", "keywords": "Ключевые слова", "literals": "Литералы", "weighted_average": "Взвешенное среднее", "structure": "Структура",
        "part": "Часть", "similar": "Похожие части", "total": "Общее сходство {}", "same": "Взято из других работ", "threshold": "Порог",
    },
}
STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #bbb;padding:.2em .6em;text-align:left}.high{color:#b00;font-weight:bold}"


def _table(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line(map(escape, head), "th") + "".join(line(r, "td") for r in rows) + "</table>"


def _percent(value: float, threshold: float) -> str:
    return f'<span class="high">{value:.2f}%</span>' if value >= threshold else f"{value:.2f}%"


def _page(title: str, parts: list[str], language: str) -> str:
    return f'<!DOCTYPE html><html lang="{language}"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'


def _similar(heads: list, threshold: float) -> list[list[str]]:
    return [[escape(head), "<br>".join(f"{escape(o)} {_percent(p, threshold)}" for o, p in found)] for head, found in heads]


def general_report(infos: DataFrame, threshold: int = DEFAULT_THRESHOLD, language: str = "en", roots: tuple[str, str] | None = None) -> str:
    """A block for each pair. Heads are listed by the default threshold and marked by the one given."""
    t = WORDS[language]
    parts = [f"<p>{t['threshold']}: {threshold}%</p>"]
    if roots:
        firsts, seconds = report.unique_paths(infos)
        flat = infos.select("first_path", "second_path", F.col("fast.weighted_average").alias("weighted_average"))
        for root, total in zip(roots, (report.general_total(flat, firsts, seconds), report.general_total(flat, seconds, firsts))):
            parts.append(f"<p>{escape(t['total'].format(root))}: {total.first()[0]}%</p>")
    for r in infos.orderBy("first_path", "second_path").toLocalIterator():
        matrix = report.percent_matrix(r["structure"]["compliance_matrix"])
        metrics = [[t[k], _percent(r["fast"][k] * 100, threshold)] for k in ("jakkar", "operators", "keywords", "literals", "weighted_average")]
        metrics.append([t["structure"], _percent(r["structure"]["similarity"] * 100, threshold)])
        parts.append("<hr>" + _table([t["first"], t["date"], t["second"], t["date"]], [[escape(x or "") for x in (r["first_path"], r["first_modify_date"], r["second_path"], r["second_modify_date"])]]))
        parts.append(_table([t["metric"], t["value"]], metrics))
        for a, b, m in ((r["first_heads"], r["second_heads"], matrix), (r["second_heads"], r["first_heads"], list(zip(*matrix)))):
            parts.append(_table([t["part"], t["similar"]], _similar(list(report.same_functions(a, b, m).items()), threshold)))
    return _page(t["general"], parts, language)


def sources_report(infos: DataFrame, threshold: int = DEFAULT_THRESHOLD, language: str = "en", roots: tuple[str, str] | None = None) -> str:
    """A block for each work with all works that share parts with it."""
    t = WORDS[language]
    same = report.same_heads(infos, threshold, below=False).persist()
    percentages = report.resulting_percentages(same).persist()
    parts = [f"<p>{t['threshold']}: {threshold}%</p>"]
    for root in roots or ():
        parts.append(f"<p>{escape(t['total'].format(root))}: {report.sources_total(percentages, root).first()[0]}%</p>")
    rows = same.where("other_head is not null").join(percentages, "path").orderBy("path", "other_path", "head", "rank").toLocalIterator()
    path = other = None
    block: list[tuple[str, list]] = []

    def flush():
        if block:
            parts.append(_table([t["part"], t["similar"]], _similar(block, threshold)))
            block.clear()

    for r in rows:
        if r["path"] != path or r["other_path"] != other:
            flush()
            if r["path"] != path:
                parts.append(f"<hr><h2>{escape(r['path'])}</h2><p>{t['same']}: {_percent(r['same_percentage'], threshold)}</p>")
            path, other = r["path"], r["other_path"]
            parts.append(f"<h3>{escape(other)}</h3>")
        if not block or block[-1][0] != r["head"]:
            block.append((r["head"], []))
        block[-1][1].append((r["other_head"], r["percent"]))
    flush()
    return _page(t["sources"], parts, language)


def html_report_create(infos: DataFrame, path: str, report_type: str = "general", threshold: int = DEFAULT_THRESHOLD, language: str = "en", first_root: str | None = None, second_root: str | None = None) -> str:
    """Write a report; a directory gets a file with the type's usual name. Returns the path."""
    if report_type not in REPORT_TYPES:
        raise ValueError("Invalid report type.")
    chosen = report.under_roots(infos, first_root, second_root)
    roots = tuple(sorted((str(first_root), str(second_root)))) if first_root else None
    if os.path.isdir(path):
        path = os.path.join(path, "report.html" if report_type == "general" else "sources.html")
    text = (general_report if report_type == "general" else sources_report)(chosen, threshold, language, roots)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
