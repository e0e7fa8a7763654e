"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import decontaminate, quality

_SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


def quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    bins = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality.COMMON_WORDS.items())
    count = lambda c: f"length(regexp_replace(t, '[^{c}]', '', 'g'))"
    classes = [count("a-z"), count(r" \t\n\x0B\f\r"), count("A-Z"), count("0-9"), count("#*$%&|<>")]
    ascii_left = r"length(regexp_replace(t, '[^\x21-\x7E]|[a-zA-Z0-9#*$%&|<>]', '', 'g'))"
    js = lambda p, q: f"""sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z:
        (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0.0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0.0 END))) / 2))"""  # noqa: E731
    share = lambda x: f"list_transform({x}, lambda c: c / 1000000.0::DOUBLE)"
    rest = lambda x: f"list_append({x}, greatest(0, 1000000 - list_sum({x})))"
    n_bins = max(map(len, quality.COMMON_WORDS.values()))
    n_classes = len(quality.CLASSES) + 1
    mean = lambda c, n: ", ".join(f"CAST(floor(sum({c}[{k + 1}]) / count(*)) AS BIGINT)" for k in range(n))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_SPLIT.format('t')} AS w, length(t) AS n_all, CASE lang {bins} END AS bins,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM d),
    c AS (SELECT *, [{', '.join(classes)}, {ascii_left}] AS six FROM w),
    f AS (SELECT *, len(w) AS n_words, CASE WHEN n_all > 0 THEN list_transform(list_append(six, n_all - list_sum(six)), lambda x: CAST(floor(x * 1000000 / n_all) AS BIGINT)) END AS classes,
      CASE WHEN len(w) > 0 THEN list_transform(bins, lambda b: CAST(floor(len(list_filter(w, lambda x: lower(x) = b)) * 1000000 / len(w)) AS BIGINT)) END AS listed FROM c),
    win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM w WHERE len(w) >= 8),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
    rep AS (SELECT r, sum(n) AS n FROM (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM twice) GROUP BY r),
    b AS (SELECT f.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM f LEFT JOIN rep USING (r)),
    g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
    ref AS (SELECT lang AS ref_lang, [{mean('classes', n_classes)}] AS ref_classes, CASE WHEN any_value(bins) IS NOT NULL THEN [{mean('listed', n_bins)}] END AS ref_listed FROM g WHERE NOT base_failed GROUP BY lang),
    j AS (SELECT g.*, {js(share('classes'), share('ref_classes'))} AS cd, {js(share(rest('listed')), share(rest('ref_listed')))} AS wd FROM g LEFT JOIN ref ON lang IS NOT DISTINCT FROM ref_lang)
    SELECT doc_id, n_words, CAST(n_all - six[2] AS BIGINT) AS word_chars, CAST(six[5] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT (n_words >= {limits.min_words} AND (coalesce(cd > {limits.max_class_distance}::DOUBLE + {limits.slack}::DOUBLE / sqrt(greatest(n_words, 1)), false)
        OR coalesce(wd > {limits.max_word_distance}::DOUBLE + {limits.slack}::DOUBLE / sqrt(greatest(n_words, 1)), false))) AS kept,
      round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM j"""


def _bare(table: str, key: str) -> str:
    return f"""SELECT *, list_transform(raw, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}+\\-]+|[^\\p{{L}}\\p{{N}}%]+$', '', 'g')) AS bare
        FROM (SELECT {key}, list_filter({_SPLIT.format("coalesce(text, '')")}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS raw FROM {table})"""


_NAME = "i > 1 AND NOT regexp_matches(raw[i - 1], '[.!?:]$') AND regexp_matches(bare[i], '^\\p{Lu}\\p{Ll}+$')"


def _templates(table: str, key: str) -> str:
    units = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
    return f"""SELECT {key}, list_transform(bare, lambda x: lower(x)) AS plain, list_transform(range(1, len(bare) + 1), lambda i:
        CASE WHEN regexp_matches(bare[i], '{decontaminate.NUMBER}') THEN '<num>' WHEN lower(bare[i]) IN ({units}) THEN '<unit>'
        WHEN ({_NAME}) OR list_contains(names, lower(bare[i])) THEN '<name>' ELSE lower(bare[i]) END) AS shape FROM ({_bare(table, key)}), names"""


def decontaminate_sql(options: decontaminate.Options = decontaminate.Options()) -> str:
    n = options.window
    return f"""WITH words AS (SELECT unnest(bare) AS x, unnest(list_transform(range(1, len(bare) + 1), lambda i: {_NAME})) AS name FROM ({_bare('benchmark', 'item_id')})),
    names AS (SELECT coalesce(list(w), []) AS names FROM (SELECT lower(x) AS w FROM words GROUP BY lower(x) HAVING bool_or(name) AND NOT bool_or(regexp_matches(x, '^\\p{{Ll}}')))),
    items AS ({_templates('benchmark', 'item_id')}),
    iw AS (SELECT item_id, least({n}, len(shape)) AS size, unnest(range(1, len(shape) - least({n}, len(shape)) + 2)) AS pos, shape, plain FROM items WHERE len(shape) >= {options.min_words}),
    ix AS (SELECT item_id, size, pos, shape[pos:pos + size - 1] AS s, plain[pos:pos + size - 1] AS p FROM iw),
    iy AS (SELECT *, array_to_string(s, chr(31)) AS k, count(*) OVER (PARTITION BY item_id) AS item_windows FROM ix WHERE len(list_filter(s, lambda x: NOT starts_with(x, '<'))) >= least({options.min_plain}, size)),
    docs AS ({_templates('documents', 'doc_id')}),
    dw AS (SELECT doc_id, z.size, unnest(range(1, len(shape) - z.size + 2)) AS pos, shape, plain FROM docs, (SELECT DISTINCT size FROM iy) z WHERE len(shape) >= z.size),
    dx AS (SELECT doc_id, size, pos, array_to_string(shape[pos:pos + size - 1], chr(31)) AS k, plain[pos:pos + size - 1] AS p FROM dw),
    met AS (SELECT doc_id, item_id, iy.pos, dx.pos - iy.pos AS shift, item_windows, dx.p = iy.p AS exact, s, iy.p AS ip, dx.p AS dp FROM dx JOIN iy ON dx.k = iy.k AND dx.size = iy.size),
    slots AS (SELECT doc_id, item_id, shift, unnest(s) AS s, unnest(ip) AS i, unnest(dp) AS d FROM met),
    mixed AS (SELECT DISTINCT doc_id, item_id, shift FROM (SELECT doc_id, item_id, shift FROM slots WHERE starts_with(s, '<') GROUP BY doc_id, item_id, shift, s, i HAVING min(d) <> max(d))),
    good AS (SELECT doc_id, item_id, pos, max(item_windows) AS item_windows, max(CAST(exact AS BIGINT)) AS exact FROM met WHERE (doc_id, item_id, shift) NOT IN (SELECT doc_id, item_id, shift FROM mixed) GROUP BY ALL)
    SELECT doc_id, item_id, count(*) AS n_windows, max(item_windows) AS item_windows, CAST(sum(exact) AS BIGINT) AS n_exact FROM good GROUP BY doc_id, item_id HAVING count(*) >= {options.coverage}::DOUBLE * max(item_windows)"""
