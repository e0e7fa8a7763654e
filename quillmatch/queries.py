"""Registered queries of the similarity engine over the driver's tables, and the
equivalent SQL.

The tables hold prose and pages instead of sources, so a document (or benchmark
item) is a work whose words are its tokens, its ``source`` is its collection,
and a page's tags are its syntax tree. Copies are folded into classes first: the
smallest doc_id with the same words stands for all, and ``doc_classes`` gives
the members, so no group of copies is expanded into pairs. Only the queries named
``..._all`` expand them: they return every pair of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import counters, grams, sequence, survey, text, tree
from .operators import compare, extract, pairs, python_source, report
from .plans import check
from .scratch import written
from .sources import files, store

MARKS = list(".,;:!?")
FUNCTION_WORDS = "the of and to in a is that it for on was as with be by are this at from".split()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # One small file is one split; deal its rows out before anything costly.
    few = spark.sparkContext.defaultParallelism
    return df.repartition(few) if name in ("documents", "pages") and len(df.inputFiles()) < few else df


def _worded(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), text.words(F.coalesce(F.col("text"), F.lit(""))).alias("w"), *more)


def _class_key(words: Column | str) -> Column:
    return F.sha2(F.array_join(words, " "), 256)


def doc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id that has the same words."""
    keyed = _worded(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("id").alias("doc_id"), _class_key("w").alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(least, "key").select("doc_id", "class_id", "class_size")


def _class_features(spark: SparkSession, sf_dir: str, per_source: bool = False, *counters_: str) -> tuple[DataFrame, DataFrame]:
    """(path and tokens of all documents, under the key of their class, so that copies are one
    work; for each class its key, the path of its smallest document, collection and
    counters). No text is shuffled to choose the document that stands for its copies."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    f = extract.text_features(docs, "doc_id", "text", "source")
    key = _class_key("tokens")
    # Rows without a source are in no pair across sources.
    keyed = f.where("collection_id is not null").withColumn("key", F.concat_ws(" ", key, "collection_id")) if per_source else f.withColumn("key", key)
    row = F.struct(F.col("filepath").cast("bigint").alias("doc_id"), "collection_id", *counters_)
    least = keyed.select("key", row.alias("row")).groupBy("key").agg(F.min_by("row", "row.doc_id").alias("row"))
    # The path is the number itself: padded to a width, longer ids would be one and negative ones none.
    classes = least.select("key", F.col("row.doc_id").alias("filepath"), *[f"row.{c}" for c in ("collection_id", *counters_)])
    return keyed.select(F.col("key").alias("filepath"), "tokens"), classes.persist()


def _features(docs: DataFrame, collection: str | None = None) -> DataFrame:
    padded = docs.withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0")).withColumn("text", F.coalesce("text", F.lit("")))
    return extract.text_features(padded, "path", "text", collection).persist()


def _ids(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("first").cast("bigint").alias("first_id"), F.col("second").cast("bigint").alias("second_id"), *more)


def doc_ngrams_distinct(spark, sf_dir):
    rows = _worded(_table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("id").alias("doc_id"), F.size("w").cast("bigint").alias("n_tokens"), F.size(grams.hashed_ngrams("w", 3)).cast("bigint").alias("n_grams"), F.size(grams.hashed_ngrams("w", 3, True)).cast("bigint").alias("n_distinct"))


def doc_ngram_top(spark, sf_dir):
    rows = _worded(_table(spark, sf_dir, "documents"), "doc_id").select(F.explode(F.transform(grams.ngrams("w", 3), lambda g: F.array_join(g, " "))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "gram").limit(20)


def _jaccard(found: DataFrame, least: float) -> DataFrame:
    j = F.col("n_common").cast("double") / (F.col("n_first") + F.col("n_second") - F.col("n_common"))
    return found.withColumn("jaccard", j).where(F.col("jaccard") >= least)


def doc_jaccard_pairs(spark, sf_dir):
    features, classes = _class_features(spark, sf_dir)
    found = pairs.shared_grams(features, 0.5, names=classes)
    return _ids(_jaccard(found, 0.5), "n_common", "jaccard")


def doc_jaccard_cross_source(spark, sf_dir):
    features, classes = _class_features(spark, sf_dir, True)
    found = pairs.shared_grams(features, 0.5, mode="one_to_one", names=classes)
    return _ids(_jaccard(found, 0.5), "n_common", "jaccard")


def doc_vs_benchmark_containment(spark, sf_dir):
    g = lambda df, key: _worded(df, key).select("id", F.explode(F.array_distinct(F.transform(grams.ngrams("w", 3), lambda x: F.array_join(x, " ")))).alias("gram"))
    items = g(_table(spark, sf_dir, "benchmark"), "item_id")
    sizes = items.groupBy("id").agg(F.count("*").alias("n_item"))
    docs = g(_table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("id", "doc_id")
    met = docs.join(items, "gram").groupBy("doc_id", "id").agg(F.count("*").alias("n_common"))
    out = met.join(sizes, "id").withColumn("containment", F.col("n_common").cast("double") / F.col("n_item"))
    return out.where("containment >= 0.5").select("doc_id", F.col("id").alias("item_id"), "n_common", "containment")


def _counts(spark, sf_dir, name: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    rows = extract.text_features(docs, "doc_id", "text")
    return rows.select(F.col("filepath").cast("bigint").alias("doc_id"), F.explode_outer(name).alias("item", "n")).where("item is not null").select("doc_id", "item", F.col("n").cast("bigint").alias("n"))


def doc_counter_marks(spark, sf_dir):
    return _counts(spark, sf_dir, "operators")


def doc_counter_keywords(spark, sf_dir):
    return _counts(spark, sf_dir, "keywords")


def doc_counter_literals(spark, sf_dir):
    return _counts(spark, sf_dir, "literals")


COUNTERS = ("operators", "keywords", "literals")


def _compared(found: DataFrame, features: DataFrame, threshold: int | None, n: int = 3, weights=counters.DEFAULT_WEIGHTS) -> DataFrame:
    """(first, second, fast) of the pairs at or above the threshold."""
    columns = compare.side_columns(found, ("tokens", *COUNTERS))
    done = compare.fast_compare(compare.with_sides(found, features, columns), n, weights)
    return done.where(compare.passes(threshold, F.col("fast.weighted_average")))


def _compared_classes(spark, sf_dir, threshold: int, n: int = 3, weights=counters.DEFAULT_WEIGHTS) -> DataFrame:
    features, classes = _class_features(spark, sf_dir, False, *COUNTERS)
    found = pairs.scored_candidates(features, threshold, n, weights=weights, names=classes)
    return _ids(_compared(found, classes, threshold, n, weights), "fast.*")


#: Rows that a class is gathered in at least, and documents in each of them at most.
SALTS, MEMBERS = 64, 1000


def _member_blocks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(class_id, block, ids, shares): the documents of each class in arrays, named by their
    least; and whether copies share an n-gram. No task gathers a whole class."""
    docs = _worded(_table(spark, sf_dir, "documents"), "doc_id").select("id", _class_key("w").alias("key"), (F.size("w") >= n).alias("shares"))
    parts = docs.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.collect_list("id").alias("ids"), F.first("shares").alias("shares"))
    parts = written(parts.where(F.size("ids") > 0), "members")
    least = parts.groupBy("key").agg(F.min(F.array_min("ids")).alias("class_id"))
    cut = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(MEMBERS)), lambda k: F.slice("ids", k, MEMBERS))
    blocks = parts.join(least, "key").select("class_id", "shares", F.explode(cut).alias("ids"))
    return written(blocks.select("class_id", F.array_min("ids").alias("block"), "ids", "shares"), "blocks")


def _compared_documents(spark, sf_dir, threshold: int, n: int = 3, weights=counters.DEFAULT_WEIGHTS) -> DataFrame:
    """Every pair of documents at or above the threshold: a pair of classes stands for all
    pairs of their members, and copies with an n-gram are alike in every metric."""
    classes, blocks = _compared_classes(spark, sf_dir, threshold, n, weights), _member_blocks(spark, sf_dir, n)
    metrics = ("jakkar", "operators", "keywords", "literals")
    side = lambda k: blocks.select(*[F.col(c).alias(f"{c}_{k}") for c in ("class_id", "block", "ids", "shares")])
    columns = ("block_a", "ids_a", "block_b", "ids_b", *metrics, "weighted_average")
    across = classes.join(side("a"), F.col("first_id") == F.col("class_id_a")).join(side("b"), F.col("second_id") == F.col("class_id_b")).select(*columns)
    inside = side("a").where("shares_a").join(side("b"), (F.col("class_id_a") == F.col("class_id_b")) & (F.col("block_a") <= F.col("block_b")))
    inside = inside.where((F.col("block_a") < F.col("block_b")) | (F.size("ids_a") > 1)).withColumns({m: F.lit(1.0) for m in metrics})
    inside = inside.withColumn("weighted_average", counters.weighted_average(list(metrics), weights)).where(compare.passes(threshold, F.col("weighted_average")))
    # Rows are made after they are dealt out, a million at most from each.
    dealt = across.union(inside.select(*columns)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block_a", "block_b")
    every = dealt.withColumn("a", F.explode("ids_a")).drop("ids_a").withColumn("b", F.explode("ids_b"))
    every = every.where((F.col("block_a") != F.col("block_b")) | (F.col("a") < F.col("b")))
    return every.select(F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("second_id"), *metrics, "weighted_average")


def doc_counter_metric_pairs(spark, sf_dir):
    features, classes = _class_features(spark, sf_dir, False, "operators")
    found = _jaccard(pairs.shared_grams(features, 0.5, names=classes), 0.5)
    sides = compare.with_sides(found.select("first", "second"), classes, ("operators",))
    return _ids(sides, counters.counter_metric(F.col("a.operators"), F.col("b.operators")).alias("metric"))


def doc_fast_compare(spark, sf_dir):
    return _compared_classes(spark, sf_dir, 65)


def doc_fast_compare_all(spark, sf_dir):
    """:func:`doc_fast_compare` of all documents, copies too."""
    return _compared_documents(spark, sf_dir, 65)


def doc_fast_compare_weights(spark, sf_dir):
    return _compared_classes(spark, sf_dir, 90, weights=(0.5, 0.6, 0.7, 0.8))


def doc_fast_compare_bigrams(spark, sf_dir):
    return _compared_classes(spark, sf_dir, 75, n=2)


def doc_fast_compare_bigrams_all(spark, sf_dir):
    """:func:`doc_fast_compare_bigrams` of all documents, copies too."""
    return _compared_documents(spark, sf_dir, 75, n=2)


def _benchmark_features(spark, sf_dir):
    return _features(_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


def benchmark_compare_ignore_threshold(spark, sf_dir):
    features = _benchmark_features(spark, sf_dir)
    return _ids(_compared(pairs.scored_candidates(features, None), features, None), "fast.*")


def imprints(spark, sf_dir):
    rows = _worded(_table(spark, sf_dir, "documents"), "doc_id").select("id", F.transform("w", lambda x: F.length(x)).alias("h"))
    out = rows.withColumn("marks", grams.imprints("h"))
    return out.select(F.col("id").alias("doc_id"), F.size("h").cast("bigint").alias("n"), F.array_join(F.transform("marks", lambda x: x.cast("string")), ",").alias("imprints"))


def levenshtein_names(spark, sf_dir):
    names = _table(spark, sf_dir, "nation").select("n_name")
    both = names.select(F.col("n_name").alias("a")).join(names.select(F.col("n_name").alias("b")), F.col("a") < F.col("b"))
    d = sequence.levenshtein_udf()("a", "b")
    return both.select("a", "b", d.cast("bigint").alias("distance"), (1 - d.cast("double") / F.greatest(F.length("a"), F.length("b"))).alias("similarity"))


def _neighbours(spark, sf_dir):
    """Benchmark items with the next one."""
    items = _worded(_table(spark, sf_dir, "benchmark"), "item_id")
    return items.join(items.select((F.col("id") - 1).alias("before"), F.col("id").alias("next_id"), F.col("w").alias("next_w")), F.col("id") == F.col("before"))


def lcs_neighbours(spark, sf_dir):
    rows = _neighbours(spark, sf_dir)
    return rows.select(F.col("id").alias("first_id"), F.col("next_id").alias("second_id"), sequence.lcs_udf()("w", "next_w").alias("lcs"), sequence.lcs_coefficient_udf()("w", "next_w").alias("coefficient"))


def lcs_golden(spark, sf_dir):
    rows = spark.createDataFrame([(1, "A G G T A B".split(), "G X T X A Y B".split()), (2, list("abcde"), list("abcde")), (3, list("abc"), [])], "id int, a array<string>, b array<string>")
    return rows.select("id", sequence.lcs_udf()("a", "b").alias("lcs"))


def gst_neighbours(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).withColumn("t", sequence.greedy_tiles_udf(3)("w", "next_w"))
    return rows.select(F.col("id").alias("first_id"), F.col("next_id").alias("second_id"), F.size("t.first").cast("bigint").alias("n_marked"))


def op_shift_users(spark, sf_dir):
    """Best overlap of the event types of each user and the next one."""
    events = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("ops"))
    after = events.select((F.col("user_id") - 1).alias("before"), F.col("ops").alias("next_ops"))
    rows = events.join(after, F.col("user_id") == F.col("before"))
    best = sequence.op_shift("ops", "next_ops")
    return rows.select("user_id", best.alias("x")).select("user_id", F.col("x.shift").cast("bigint").alias("shift"), F.col("x.value").cast("double").alias("value"))


def benchmark_structure(spark, sf_dir):
    """Words as nodes: ids in order of first appearance, and the hash of the id list."""
    rows = _worded(_table(spark, sf_dir, "benchmark"), "item_id")
    rows = rows.withColumn("u", F.array_distinct("w"))
    rows = rows.withColumn("structure", F.transform("w", lambda x: F.struct(F.lit(1).alias("depth"), (F.array_position("u", x) - 1).alias("uid"))))
    return rows.select(F.col("id").alias("item_id"), F.size("u").cast("bigint").alias("count_unodes"), tree.structure_sha256("structure").alias("sha256"))


def doc_unique_nodes(spark, sf_dir):
    """The dictionary of unique nodes, relationally: rank of the first position."""
    from pyspark.sql import Window

    words = _worded(_table(spark, sf_dir, "benchmark"), "item_id").select("id", F.posexplode("w").alias("pos", "node"))
    first = words.groupBy("id", "node").agg(F.min("pos").alias("pos"))
    uid = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1
    return first.select(F.col("id").alias("item_id"), "node", uid.cast("bigint").alias("uid"))


def _page_features(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    works = pages.select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("filepath"), F.coalesce("html", F.lit("")).alias("code"), F.lit("").alias("modify_date"), F.lit("pages").alias("collection_id"))
    return extract.features_from_works(works, "html")


def page_structure(spark, sf_dir):
    f = _page_features(spark, sf_dir)
    return f.select(F.col("filepath").cast("bigint").alias("page_id"), "sha256", F.col("count_of_nodes").cast("bigint").alias("n_nodes"), F.col("count_unodes").cast("bigint").alias("n_labels"), F.size(F.filter("structure", lambda x: x["depth"] <= 4)).cast("bigint").alias("n_upper"))


def _page_key() -> Column:
    return F.xxhash64("sha256", "tokens", *[F.sort_array(F.map_entries(c)) for c in ("operators", "keywords", "literals")])


def page_struct_compare(spark, sf_dir):
    """Pages whose tags overlap by 90 percent, compared by structure; pages of equal
    structure and counters are one class, which the smallest page stands for."""
    f = _page_features(spark, sf_dir).persist()
    first = f.withColumn("key", _page_key()).groupBy("key").agg(F.min("filepath").alias("filepath"))
    reps = f.join(first.select("filepath"), "filepath", "left_semi").persist()
    found = pairs.scored_candidates(reps, 90)
    done = compare.compare_pairs(found, reps, 90)
    return done.select(F.col("first_path").cast("bigint").alias("first_id"), F.col("second_path").cast("bigint").alias("second_id"), F.col("fast.weighted_average").alias("weighted_average"), F.col("structure.similarity").alias("similarity"))


# Small inputs with known results

FIRST = "def my_func(length, future):\n    future += length\n    print(future)\n    return future\n\n\nif True:\n    my_func(2, 3)\n"
SECOND = "def my_func(length, future, shifr):\n    future += length\n    print(shifr * future)\n    return future\n\n\nif True:\n    my_func(2, 3, \"Hello\")\n"
CONSTANTS = "INT_CONST: int = 10\nINT_CONST += 15\nFLOAT_CONST = 10.5\n\n\n" + FIRST


C_FIRST = "int gcd(int l, int r) {\n  if (r == 0)\n    return l;\n  return gcd(r, l % r);\n}\n"
C_SECOND = "int gcd(long a, long b)\n{\n  if (b == 0L) { return a; }\n  return gcd(b, a % b);\n}\n"


def c_features_golden(spark, sf_dir):
    works = spark.createDataFrame([("a.cpp", C_FIRST, "", "x"), ("b.cpp", C_SECOND, "", "x")], "filepath string, code string, modify_date string, collection_id string")
    f = extract.features_from_works(works, "cpp")
    return f.select("filepath", "count_of_nodes", "count_unodes", F.array_join("tokens", " ").alias("kinds"), F.array_join("head_nodes", " ").alias("heads"))


def python_features_golden(spark, sf_dir):
    works = spark.createDataFrame([("a.py", CONSTANTS, "", "x")], "filepath string, code string, modify_date string, collection_id string")
    f = extract.features_from_works(works, "py")
    return f.select("filepath", "count_of_nodes", "count_unodes", "sha256", F.array_join("head_nodes", " ").alias("heads"))


def _golden_info(spark):
    from .plans.check import compare_works

    return compare_works(spark, FIRST, SECOND)


def compare_works_golden(spark, sf_dir):
    r = _golden_info(spark)
    three = lambda c: F.round(c, 3)
    return r.select(*[three(f"fast.{c}").alias(c) for c in ("jakkar", "operators", "keywords", "literals", "weighted_average")], three("structure.similarity").alias("similarity"))


def compliance_long_golden(spark, sf_dir):
    return report.compliance_long(_golden_info(spark)).select("i", "j", "first_head", "second_head", F.round("ratio", 4).alias("ratio"))


def percent_matrix_golden(spark, sf_dir):
    m = report.percent_matrix_column("structure.compliance_matrix")
    rows = _golden_info(spark).select(F.posexplode(m).alias("i", "row")).select("i", F.posexplode("row").alias("j", "x"))
    return rows.select("i", "j", text.python_round()("x").alias("percent"))


def same_heads_golden(spark, sf_dir):
    return report.same_heads(_golden_info(spark)).select("path", "head", "other_head", "percent", "rank")


def struct_compare_golden(spark, sf_dir):
    rows = spark.createDataFrame([
        (1, [1, 2, 3, 3, 2, 3, 4, 3, 3, 4, 2], [1, 2, 2, 3, 4, 5, 4, 4, 4, 1, 2, 3, 3, 3, 2]),
        (2, [1, 2, 3, 2, 3, 4, 3, 4, 2, 3, 4, 3, 4, 2, 3], [1, 2, 3, 2, 3, 4, 3, 4, 5, 6, 5, 4, 2, 3, 4, 3, 4, 5, 4, 5]),
    ], "id int, a array<int>, b array<int>")
    return rows.select("id", tree.struct_compare_udf()("a", "b").alias("x")).select("id", "x.num", "x.den")


def resulting_percentages_golden(spark, sf_dir):
    rows = spark.createDataFrame([
        ("a.py", "b.py", 1, "f", "g", 80.0, 0), ("c.py", "d.py", 4, "f", "x", 95.0, 0), ("c.py", "e.py", 4, "f", "y", 80.0, 0), ("c.py", "d.py", 4, "g", "x", 88.0, 0), ("c.py", "e.py", 4, "h", None, None, None),
    ], report.SAME)
    return report.resulting_percentages(rows)


def sources_total_golden(spark, sf_dir):
    rows = spark.createDataFrame([("/usr/p/a.py", 80.0), ("/usr/p/b.py", 81.25), ("/home/c.py", 50.0)], "path string, same_percentage double")
    return report.sources_total(rows, "/usr/p")


def general_total(spark, sf_dir):
    """Total similarity of the benchmark with itself, from all its pairs."""
    found = benchmark_compare_ignore_threshold(spark, sf_dir)
    infos = found.select(F.col("first_id").cast("string").alias("first_path"), F.col("second_id").cast("string").alias("second_path"), "weighted_average")
    a, b = report.unique_paths(infos)
    return report.general_total(infos, a, b, rounded=False).select(F.round("total_similarity", 6).alias("total_similarity"))


# Relational operators


def report_prefix_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("first_path"), F.col("url").alias("second_path"), "page_id")
    return report.under_roots(pages, "https://", "https://").select("page_id")


def report_upsert(spark, sf_dir):
    old = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    new = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("value"))
    return store.upserted(old, new, ["doc_id"])


def cache_hit_miss(spark, sf_dir):
    """Turns whose cached version is still valid: those of users are in the cache."""
    works = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("filepath"), "role", F.length("text").cast("string").alias("modify_date"), F.lit("x").alias("collection_id"))
    cached = works.where("role = 'user'").drop("role")
    hits, misses = store.split_cached_works(works.drop("role"), cached)
    return hits.select("filepath", F.lit("hit").alias("state")).unionByName(misses.select("filepath", F.lit("miss").alias("state")))


def exit_code_fold(spark, sf_dir):
    code = check.exit_code(F.col("l_quantity") >= 50)
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(code.cast("bigint").alias("exit_code"))


def calc_iterations(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source").agg(pairs.iterations(F.count("*"), "many_to_many").alias("iterations"))


def url_parse_pages(spark, sf_dir):
    p = text.url_parts("url")
    return _table(spark, sf_dir, "pages").select("page_id", F.size(p).cast("bigint").alias("n_parts"), F.get(p, F.lit(0)).alias("protocol"), F.get(p, F.lit(2)).alias("host"))


def path_filter(spark, sf_dir):
    """Pages whose file has an extension (or lies at the host) and whose address ends so."""
    return _table(spark, sf_dir, "pages").where(files.accepts(F.concat("url", F.lit(".html")), None, "[0-9]+\\.html$")).select("page_id", "url")


def text_lengths(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    clean = text.without_blank_lines(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", clean.alias("c")).select("doc_id", *[v.alias(k) for k, v in text.text_lengths("c").items()])


def rolling_mean_20(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return survey.rolling_mean(events, "event_id", "cents", 20, "user_id").select("event_id", "rolling_mean")


def trend_linear(spark, sf_dir):
    """Slope of quantity by line number for each return flag; sums of whole numbers are exact."""
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").cast("bigint").alias("l_quantity"))
    return survey.linear_trend(rows, "l_linenumber", "l_quantity", "l_returnflag").select("l_returnflag", "slope")


def trend_powers(spark, sf_dir):
    """Factors of the fits by the second to fourth power alone, for each return flag."""
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").cast("bigint").alias("l_quantity"))
    out = None
    for power in (2, 3, 4):
        part = survey.power_trend(rows, "l_linenumber", "l_quantity", power, "l_returnflag").withColumn("power", F.lit(power))
        out = part if out is None else out.unionByName(part)
    return out


def same_heads_ties(spark, sf_dir):
    """Lists of heads with ties, evictions and percents under the threshold."""
    rows = spark.createDataFrame([
        ("a", "b", ["f", "g", "h", "i", "j"], ["p", "q", "r", "s", "t"], ([
            [[70, 100], [70, 100], [90, 100], [80, 100], [10, 100]],
            [[70, 100], [70, 100], [70, 100], [70, 100], [70, 100]],
            [[10, 100], [80, 100], [85, 100], [90, 100], [85, 100]],
            [[10, 100], [12, 100], [12, 100], [70, 100], [11, 100]],
            [[64, 100], [20, 100], [64, 100], [0, 100], [1, 100]],
        ],)),
    ], "first_path string, second_path string, first_heads array<string>, second_heads array<string>, structure struct<compliance_matrix:array<array<array<int>>>>")
    return report.same_heads(rows).where("path = 'a'").select("head", "other_head", "percent", "rank")


def page_classes(spark, sf_dir):
    """Every page with the smallest page of equal structure and counters, which stands for it in page_struct_compare."""
    keyed = _page_features(spark, sf_dir).select(F.col("filepath").cast("bigint").alias("page_id"), _page_key().alias("key"))
    least = keyed.groupBy("key").agg(F.min("page_id").alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(least, "key").select("page_id", "class_id", "class_size")


def doc_source_classes(spark, sf_dir):
    """Every document with the smallest one of its source that has the same words, which
    stands for it in doc_jaccard_cross_source."""
    keyed = _worded(_table(spark, sf_dir, "documents"), "doc_id", "source").select(F.col("id").alias("doc_id"), "source", _class_key("w").alias("key"))
    least = keyed.groupBy("key", "source").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    same = (keyed["key"] == least["key"]) & keyed["source"].eqNullSafe(least["source"])
    return keyed.join(least, same).select("doc_id", "class_id", "class_size")


def dedup_keep_last(spark, sf_dir):
    return survey.keep_last(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


def mean_by_length(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"), "n_chars")
    return survey.mean_by(docs, "n_lines", "n_chars")


QUERIES = {f.__name__: f for f in (
    doc_classes, doc_ngrams_distinct, doc_ngram_top, doc_jaccard_pairs, doc_jaccard_cross_source, doc_vs_benchmark_containment, doc_counter_marks, doc_counter_keywords,
    doc_counter_literals, doc_counter_metric_pairs, doc_fast_compare, doc_fast_compare_all, doc_fast_compare_weights, doc_fast_compare_bigrams, doc_fast_compare_bigrams_all, benchmark_compare_ignore_threshold, imprints,
    levenshtein_names, lcs_neighbours, lcs_golden, gst_neighbours, op_shift_users, benchmark_structure, doc_unique_nodes, page_structure, page_struct_compare,
    c_features_golden, python_features_golden, compare_works_golden, compliance_long_golden, percent_matrix_golden, same_heads_golden, struct_compare_golden, resulting_percentages_golden,
    sources_total_golden, general_total, report_prefix_filter, report_upsert, cache_hit_miss, exit_code_fold, calc_iterations, url_parse_pages, path_filter, text_lengths,
    rolling_mean_20, trend_linear, trend_powers, dedup_keep_last, mean_by_length, same_heads_ties, page_classes, doc_source_classes,
)}

# SQL

_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_WORDS = f"docs AS (SELECT doc_id, source, {_SPLIT} AS w FROM documents)"
_CLASSES = _WORDS + ", keyed AS (SELECT doc_id, source, w, sha256(array_to_string(w, ' ')) AS k FROM docs)"
_REPS = _CLASSES + ", reps AS (SELECT arg_min(w, doc_id) AS w, min(doc_id) AS id, CAST(NULL AS VARCHAR) AS source FROM keyed GROUP BY k)"
_EVERY = _WORDS + ", reps AS (SELECT doc_id AS id, w, CAST(NULL AS VARCHAR) AS source FROM docs)"
_SOURCE_REPS = _CLASSES + ", reps AS (SELECT arg_min(w, doc_id) AS w, min(doc_id) AS id, source FROM keyed GROUP BY k, source)"
_ITEM_REPS = f"reps AS (SELECT item_id AS id, {_SPLIT} AS w, CAST(NULL AS VARCHAR) AS source FROM benchmark)"


def _grams(n: int = 3) -> str:
    return f"""texts AS (SELECT DISTINCT id, source, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM reps),
    numbered AS (SELECT gram, CAST(row_number() OVER () AS INTEGER) AS number, count(*) AS df FROM texts GROUP BY gram),
    grams AS (SELECT id, source, number AS gram FROM texts JOIN numbered USING (gram)),
    sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id)"""


def _common(on: str = "a.id < b.id") -> str:
    return f"""common AS (SELECT a.id AS x, b.id AS y, count(*) AS n_common FROM grams a JOIN grams b ON a.gram = b.gram AND {on} GROUP BY a.id, b.id),
    j AS (SELECT x, y, n_common, CAST(n_common AS DOUBLE) / (p.n + q.n - n_common) AS jaccard FROM common JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y)"""


def _counter_table(name: str, key: str) -> str:
    rows = {
        "operators": "SELECT {key}, m AS item, len(t) - len(replace(t, m, '')) AS n FROM (SELECT {key}, coalesce(text, '') AS t, unnest([" + ", ".join(f"'{m}'" for m in MARKS) + "]) AS m FROM {table})",
        "keywords": "SELECT {key}, x AS item, count(*) AS n FROM (SELECT {key}, unnest({split}) AS x FROM {table}) WHERE x IN (" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + ") GROUP BY ALL",
        "literals": "SELECT {key}, x AS item, count(*) AS n FROM (SELECT {key}, unnest({split}) AS x FROM {table}) WHERE regexp_matches(x, '[0-9]') GROUP BY ALL",
    }[name]
    table = "documents" if key == "doc_id" else "benchmark"
    return f"SELECT {key} AS id, item, CAST(n AS BIGINT) AS n FROM ({rows.format(key=key, table=table, split=_SPLIT)}) WHERE n > 0"


def _metric(name: str, key: str, source: str) -> str:
    """CTEs <name> (x, y, v): the counter metric of the pairs in ``source``."""
    return f"""{name}_t AS ({_counter_table(name, key)}), {name}_s AS (SELECT id, sum(n) AS s FROM {name}_t GROUP BY id),
    {name}_m AS (SELECT x, y, sum(least(a.n, b.n)) AS m FROM {source} JOIN {name}_t a ON a.id = x JOIN {name}_t b ON b.id = y AND a.item = b.item GROUP BY x, y),
    {name}_v AS (SELECT p.x, p.y, CASE WHEN a.s IS NULL AND b.s IS NULL THEN 1.0::DOUBLE ELSE CAST(coalesce(m, 0) AS DOUBLE) / (coalesce(a.s, 0) + coalesce(b.s, 0) - coalesce(m, 0)) END AS v
      FROM {source} p LEFT JOIN {name}_s a ON a.id = p.x LEFT JOIN {name}_s b ON b.id = p.y LEFT JOIN {name}_m m ON m.x = p.x AND m.y = p.y)"""


def _fast(reps: str, key: str, threshold: int | None, n: int = 3, weights=counters.DEFAULT_WEIGHTS) -> str:
    w = [f"{x}::DOUBLE" for x in weights]
    every = "every AS (SELECT a.id AS x, b.id AS y, coalesce(j.jaccard, 0.0::DOUBLE) AS jaccard FROM reps a JOIN reps b ON a.id < b.id LEFT JOIN j ON j.x = a.id AND j.y = b.id)"
    chosen = every if threshold is None else "every AS (SELECT x, y, jaccard FROM j)"
    where = "" if threshold is None else f"WHERE weighted_average * 100.0::DOUBLE >= {threshold}"
    return f"""WITH {reps}, {_grams(n)}, {_common()}, {chosen},
    {_metric("operators", key, "every")}, {_metric("keywords", key, "every")}, {_metric("literals", key, "every")}
    SELECT * FROM (SELECT e.x AS first_id, e.y AS second_id, e.jaccard AS jakkar, o.v AS operators, k.v AS keywords, l.v AS literals,
      (e.jaccard * {w[0]} + o.v * {w[1]} + k.v * {w[2]} + l.v * {w[3]}) / ({w[0]} + {w[1]} + {w[2]} + {w[3]}) AS weighted_average
      FROM every e JOIN operators_v o ON o.x = e.x AND o.y = e.y JOIN keywords_v k ON k.x = e.x AND k.y = e.y JOIN literals_v l ON l.x = e.x AND l.y = e.y) {where}"""


ORACLE_SQL = {
    "doc_classes": f"WITH {_CLASSES}, m AS (SELECT k, min(doc_id) AS class_id, count(*) AS class_size FROM keyed GROUP BY k) SELECT doc_id, class_id, class_size FROM keyed JOIN m USING (k)",
    "doc_ngrams_distinct": f"WITH {_WORDS}, g AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM docs) SELECT doc_id, n AS n_tokens, CAST(len(g) AS BIGINT) AS n_grams, CAST(list_unique(g) AS BIGINT) AS n_distinct FROM g",
    "doc_ngram_top": f"WITH {_WORDS} SELECT gram, count(*) AS cnt FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM docs) GROUP BY gram ORDER BY cnt DESC, gram LIMIT 20",
    "doc_jaccard_pairs": f"WITH {_REPS}, {_grams()}, {_common()} SELECT x AS first_id, y AS second_id, n_common, jaccard FROM j WHERE jaccard >= 0.5",
    "doc_jaccard_cross_source": f"WITH {_SOURCE_REPS}, {_grams()}, {_common('a.source < b.source')} SELECT x AS first_id, y AS second_id, n_common, jaccard FROM j WHERE jaccard >= 0.5",
    "doc_vs_benchmark_containment": f"""WITH {_WORDS}, d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM docs), {_ITEM_REPS}, {_grams()}
        SELECT doc_id, id AS item_id, n_common, containment FROM (SELECT doc_id, g.id, count(*) AS n_common, CAST(count(*) AS DOUBLE) / any_value(s.n) AS containment FROM d JOIN texts g USING (gram) JOIN sizes s ON s.id = g.id GROUP BY doc_id, g.id) WHERE containment >= 0.5""",
    **{f"doc_counter_{q}": f"SELECT id AS doc_id, item, n FROM ({_counter_table(name, 'doc_id')})" for q, name in (("marks", "operators"), ("keywords", "keywords"), ("literals", "literals"))},
    "doc_counter_metric_pairs": f"WITH {_REPS}, {_grams()}, {_common()}, p AS (SELECT x, y FROM j WHERE jaccard >= 0.5), {_metric('operators', 'doc_id', 'p')} SELECT x AS first_id, y AS second_id, v AS metric FROM operators_v",
    "doc_fast_compare": _fast(_REPS, "doc_id", 65),
    "doc_fast_compare_all": _fast(_EVERY, "doc_id", 65),
    "doc_fast_compare_weights": _fast(_REPS, "doc_id", 90, weights=(0.5, 0.6, 0.7, 0.8)),
    "doc_fast_compare_bigrams": _fast(_REPS, "doc_id", 75, n=2),
    "doc_fast_compare_bigrams_all": _fast(_EVERY, "doc_id", 75, n=2),
    "benchmark_compare_ignore_threshold": _fast(_ITEM_REPS, "item_id", None),
    "imprints": f"WITH {_WORDS}, h AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS h FROM docs) SELECT doc_id, len(h) AS n, CASE WHEN len(h) >= 2 THEN array_to_string(list_transform(range(1, len(h) + 1, greatest(length(bin(len(h))) - 1, 1)), lambda i: CAST(h[i] AS VARCHAR)), ',') END AS imprints FROM h",
    "levenshtein_names": "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance, 1 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)) AS similarity FROM nation a JOIN nation b ON a.n_name < b.n_name",
    "lcs_golden": "SELECT * FROM (VALUES (1, 4::BIGINT), (2, 5::BIGINT), (3, 0::BIGINT)) t(id, lcs)",
    "op_shift_users": """WITH u AS (SELECT user_id, list(event_type ORDER BY event_id) AS ops FROM events GROUP BY user_id),
        p AS (SELECT a.user_id, CASE WHEN len(a.ops) > len(b.ops) THEN b.ops ELSE a.ops END AS s, CASE WHEN len(a.ops) > len(b.ops) THEN a.ops ELSE b.ops END AS l FROM u a JOIN u b ON b.user_id = a.user_id + 1),
        k AS (SELECT user_id, s, l, unnest(range(0, len(l))) AS shift FROM p),
        c AS (SELECT user_id, shift, len(s) + len(l) AS n, len(list_filter(range(1, least(len(s), len(l) - shift) + 1), lambda i: s[i] = l[i + shift])) AS same FROM k),
        v AS (SELECT user_id, shift, CAST(CAST(same AS DOUBLE) / (n - same) AS FLOAT) AS value FROM c)
        SELECT user_id, shift, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, shift) AS r FROM v) WHERE r = 1""",
    "benchmark_structure": f"""WITH {_ITEM_REPS}, w AS (SELECT id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM reps), f AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS uid FROM w GROUP BY id, x)
        SELECT w.id AS item_id, max(uid) + 1 AS count_unodes, sha256(concat('[', string_agg(CAST(uid AS VARCHAR), ', ' ORDER BY pos), ']')) AS sha256 FROM w JOIN f USING (id, x) GROUP BY w.id""",
    "doc_unique_nodes": f"WITH {_ITEM_REPS}, w AS (SELECT id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM reps) SELECT id AS item_id, x AS node, row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS uid FROM w GROUP BY id, x",
    "c_features_golden": """SELECT * FROM (VALUES ('a.cpp', 23, 10, '8 10 10 202 205 114 100 101 106 214 100 101 214 103 100 101 100 101 114 100 101 100 101', 'gcd'),
        ('b.cpp', 25, 10, '8 10 10 202 205 114 100 101 106 202 214 100 100 101 214 103 100 101 100 101 114 100 101 100 101', 'gcd')) t(filepath, count_of_nodes, count_unodes, kinds, heads)""",
    "python_features_golden": "SELECT 'a.py' AS filepath, 42::INTEGER AS count_of_nodes, 15::INTEGER AS count_unodes, 'cc112603b970b41f72e0488dcc6f9e26889a9298c752e61a25d3e10caf512e43' AS sha256, 'INT_CONST[1] INT_CONST[2] FLOAT_CONST[3] my_func[6] If[12]' AS heads",
    "compare_works_golden": "SELECT 0.737::DOUBLE AS jakkar, 0.667::DOUBLE AS operators, 1.0::DOUBLE AS keywords, 0.75::DOUBLE AS literals, 0.774::DOUBLE AS weighted_average, 0.824::DOUBLE AS similarity",
    "compliance_long_golden": "SELECT * FROM (VALUES (0, 0, 'my_func[1]', 'my_func[1]', 0.7917::DOUBLE), (0, 1, 'my_func[1]', 'If[7]', 0.3333::DOUBLE), (1, 0, 'If[7]', 'my_func[1]', 0.1852::DOUBLE), (1, 1, 'If[7]', 'If[7]', 0.8889::DOUBLE)) t(i, j, first_head, second_head, ratio)",
    "percent_matrix_golden": "SELECT * FROM (VALUES (0, 0, 79.17::DOUBLE), (0, 1, 33.33::DOUBLE), (1, 0, 18.52::DOUBLE), (1, 1, 88.89::DOUBLE)) t(i, j, percent)",
    "same_heads_golden": """SELECT * FROM (VALUES ('first', 'my_func[1]', 'my_func[1]', 79.17::DOUBLE, 0), ('first', 'If[7]', 'If[7]', 88.89::DOUBLE, 0), ('first', 'If[7]', 'my_func[1]', 18.52::DOUBLE, 1),
        ('second', 'my_func[1]', 'my_func[1]', 79.17::DOUBLE, 0), ('second', 'If[7]', 'If[7]', 88.89::DOUBLE, 0), ('second', 'If[7]', 'my_func[1]', 33.33::DOUBLE, 1)) t(path, head, other_head, percent, rank)""",
    "struct_compare_golden": "SELECT * FROM (VALUES (1, 6::BIGINT, 22::BIGINT), (2, 14::BIGINT, 23::BIGINT)) t(id, num, den)",
    "resulting_percentages_golden": "SELECT * FROM (VALUES ('a.py', 1, 80.0::DOUBLE), ('c.py', 4, 45.75::DOUBLE)) t(path, cnt_head_nodes, same_percentage)",
    "sources_total_golden": "SELECT 80.62::DOUBLE AS total_similarity",
    "report_prefix_filter": "SELECT page_id FROM pages WHERE starts_with(url, 'https://')",
    "report_upsert": "SELECT doc_id, n_chars AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, CAST(quality AS BIGINT) FROM labels",
    "cache_hit_miss": "SELECT concat_ws('/', conv_id, turn) AS filepath, CASE WHEN role = 'user' THEN 'hit' ELSE 'miss' END AS state FROM conversations",
    "exit_code_fold": "SELECT l_returnflag, l_linestatus, CAST(bit_or(CASE WHEN l_quantity >= 50 THEN 200 ELSE 0 END) AS BIGINT) AS exit_code FROM lineitem GROUP BY ALL",
    "calc_iterations": "SELECT source, CASE WHEN count(*) > 1 THEN count(*) * (count(*) - 1) // 2 ELSE 0 END AS iterations FROM documents GROUP BY source",
    "url_parse_pages": "WITH p AS (SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/') AS p FROM pages) SELECT page_id, len(p) AS n_parts, p[1] AS protocol, p[3] AS host FROM p",
    "path_filter": "SELECT page_id, url FROM pages WHERE regexp_matches(concat(url, '.html'), '[0-9]+\\.html$') AND regexp_matches(regexp_extract(concat(url, '.html'), '([^/]*)$', 1), '\\..*$')",
    "text_lengths": r"WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\n+', chr(10), 'g') AS c FROM documents) SELECT doc_id, length(c) AS content_len, length(translate(c, ' ' || chr(10) || chr(9), '')) AS content_len_without_blank, len(string_split(c, chr(10))) - CASE WHEN c = '' OR ends_with(c, chr(10)) THEN 1 ELSE 0 END AS count_lines_without_blank_lines FROM c",
    "rolling_mean_20": """WITH e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events), w AS (SELECT event_id, count(*) OVER o AS n, sum(cents) OVER o AS s FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT event_id, CASE WHEN n = 20 THEN CAST(s AS DOUBLE) / 20 END AS rolling_mean FROM w""",
    "trend_powers": "SELECT l_returnflag, p AS power, sum(pow(l_linenumber, p) * CAST(l_quantity AS BIGINT)) / sum(pow(l_linenumber, 2 * p)) AS factor FROM lineitem, (VALUES (2), (3), (4)) t(p) GROUP BY l_returnflag, p",
    "same_heads_ties": """SELECT * FROM (VALUES ('f', 'r', 90.0::DOUBLE, 0), ('f', 's', 80.0::DOUBLE, 1), ('f', 'q', 70.0::DOUBLE, 2), ('g', 'p', 70.0::DOUBLE, 0), ('g', 'q', 70.0::DOUBLE, 1), ('g', 'r', 70.0::DOUBLE, 2),
        ('h', 's', 90.0::DOUBLE, 0), ('h', 'r', 85.0::DOUBLE, 1), ('h', 't', 85.0::DOUBLE, 2), ('i', 's', 70.0::DOUBLE, 0), ('i', 'q', 12.0::DOUBLE, 1), ('j', 'p', 64.0::DOUBLE, 0)) t(head, other_head, percent, rank)""",
    "doc_source_classes": f"WITH {_CLASSES}, m AS (SELECT k, source, min(doc_id) AS class_id, count(*) AS class_size FROM keyed GROUP BY k, source) SELECT doc_id, class_id, class_size FROM keyed a JOIN m b ON a.k = b.k AND a.source IS NOT DISTINCT FROM b.source",
    "lcs_neighbours": f"""WITH RECURSIVE {_ITEM_REPS}, p AS (SELECT a.id AS x, b.id AS y, a.w AS a, b.w AS b FROM reps a JOIN reps b ON b.id = a.id + 1),
        t(x, y, i, line) AS (SELECT x, y, 0, list_transform(b, lambda z: 0) FROM p UNION ALL SELECT p.x, p.y, i + 1, list_transform(range(1, len(p.b) + 1), lambda j: greatest(line[j], coalesce(list_max(
            list_transform(list_filter(range(1, j + 1), lambda k: p.b[k] = p.a[i + 1]), lambda k: 1 + CASE WHEN k > 1 THEN line[k - 1] ELSE 0 END)), 0))) FROM t JOIN p USING (x, y) WHERE i < len(p.a))
        SELECT x AS first_id, y AS second_id, CAST(coalesce(line[len(b)], 0) AS BIGINT) AS lcs, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2 * CAST(coalesce(line[len(b)], 0) AS DOUBLE) / (len(a) + len(b)) ELSE 0.0::DOUBLE END AS coefficient
        FROM t JOIN p USING (x, y) WHERE i = len(a)""",
    "trend_linear": "WITH s AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS sx, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS sy, CAST(sum(l_linenumber * l_linenumber) AS DOUBLE) AS sxx, CAST(sum(l_linenumber * CAST(l_quantity AS BIGINT)) AS DOUBLE) AS sxy FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM s",
    "dedup_keep_last": "SELECT max(doc_id) AS doc_id, n_chars FROM documents GROUP BY n_chars",
    "mean_by_length": "SELECT CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(sum(n_chars) AS DOUBLE) / count(*) AS mean_value FROM documents GROUP BY 1",
}
ORACLE_SQL["general_total"] = f"""WITH c AS ({ORACLE_SQL["benchmark_compare_ignore_threshold"]}),
    b AS (SELECT first_id AS p, second_id AS q, weighted_average AS v FROM c UNION ALL SELECT second_id, first_id, weighted_average FROM c),
    m AS (SELECT p, max(v) AS best FROM b WHERE p IN (SELECT first_id FROM c) AND q IN (SELECT second_id FROM c) GROUP BY p)
    SELECT round(sum(coalesce(best, 0)) / count(*) * 100, 6) AS total_similarity FROM (SELECT DISTINCT first_id FROM c) f LEFT JOIN m ON m.p = f.first_id"""
