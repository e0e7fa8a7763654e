"""Types of the tables and the domains of settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Domains and defaults (fixed values)
EXTENSIONS = {"py": (r"\.py$",), "cpp": (r"\.cpp$", r"\.c$", r"\.h$")}
MODES = ("many_to_many", "one_to_one")
REPORT_TYPES = ("general", "sources")
REPORTS_EXTENSIONS = ("csv", "mongo")
LANGUAGES = ("en", "ru")
LOG_LEVELS = ("trace", "debug", "info", "warning", "error")
MAX_DEPTHS = (*range(3, 16), 999)
NGRAMS_LENGTHS = tuple(range(1, 11))
THRESHOLDS = tuple(range(50, 100))
SHORT_OUTPUTS = (0, 1, 2)
DEFAULT_THRESHOLD = 65
DEFAULT_NGRAMS = 3
DEFAULT_MAX_DEPTH = 999
DEFAULT_WEIGHTS = (1.0, 0.4, 0.4, 0.4)
CSV_COLUMNS = (
    "date", "first_modify_date", "first_sha256", "second_modify_date", "second_sha256", "first_path", "second_path", "first_heads", "second_heads",
    "jakkar", "operators", "keywords", "literals", "weighted_average", "struct_similarity", "compliance_matrix",
)

COUNTS = T.MapType(T.StringType(), T.IntegerType())
PLACE = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("uid", T.IntegerType())])
POSITION = T.StructType([T.StructField("lineno", T.IntegerType()), T.StructField("col_offset", T.IntegerType())])
MATRIX = T.ArrayType(T.ArrayType(T.ArrayType(T.LongType())))

WORK = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("modify_date", T.StringType()),
    T.StructField("collection_id", T.StringType()),
])

FEATURES = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("modify_date", T.StringType()),
    T.StructField("collection_id", T.StringType()),
    T.StructField("count_of_nodes", T.IntegerType()),
    T.StructField("head_nodes", T.ArrayType(T.StringType())),
    T.StructField("operators", COUNTS),
    T.StructField("keywords", COUNTS),
    T.StructField("literals", COUNTS),
    T.StructField("unodes", COUNTS),
    T.StructField("from_num", T.MapType(T.IntegerType(), T.StringType())),
    T.StructField("count_unodes", T.IntegerType()),
    T.StructField("structure", T.ArrayType(PLACE)),
    T.StructField("tokens", T.ArrayType(T.IntegerType())),
    T.StructField("tokens_pos", T.ArrayType(POSITION)),
])

FAST = T.StructType([T.StructField(n, T.DoubleType()) for n in ("jakkar", "operators", "keywords", "literals", "weighted_average")])
STRUCTURE = T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("compliance_matrix", MATRIX)])

COMPARE_INFO = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("first_path", T.StringType()),
    T.StructField("first_modify_date", T.StringType()),
    T.StructField("first_sha256", T.StringType()),
    T.StructField("first_heads", T.ArrayType(T.StringType())),
    T.StructField("second_path", T.StringType()),
    T.StructField("second_modify_date", T.StringType()),
    T.StructField("second_sha256", T.StringType()),
    T.StructField("second_heads", T.ArrayType(T.StringType())),
    T.StructField("fast", FAST),
    T.StructField("structure", STRUCTURE),
])


@dataclass(frozen=True)
class ExitCode:
    SUCCESS = 0
    INVALID = 1
    KEYBOARD = 1
    PARSER = 2
    QUERY = 3
    UNEXPECTED = 5
    FOUND_SIMILAR = 200
