"""Secret scans with a trigram inverted index.

From the syntax tree of each rule's pattern a Boolean query over trigrams is
derived: literals that every match must hold become conjunctions of their
trigrams, alternatives become disjunctions; what can't be told is true. Each
batch of documents is a shard with an inverted index: postings of the trigrams
that occur in any rule's query, over lower-cased bytes. A rule's query is
answered by intersecting and uniting postings, and the rule's pattern then
verifies the candidates. A rule without mandatory trigrams scans all documents.

Defined cases: null text counts as empty: no spans. Repeated rows get the same
spans. Where spans of several rules begin together, the rule listed first comes
first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common
from .spans import digest, joined, ordered

#: A query: True, a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose text must have ``least`` characters (0: the whole match).
    group: int = 0
    least: int = 0
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
MAX_STRINGS = 64


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """One of the strings occurs."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


class _Reader:
    """Reads a pattern's tree from left to right; keeps the strings that can stand
    directly before the current position, and the conditions found so far."""

    def __init__(self) -> None:
        self.strings = {""}
        self.found: list[Query] = []

    def cut(self) -> None:
        self.found.append(_of_strings(self.strings))
        self.strings = {""}

    def extend(self, choices: set[str]) -> None:
        if len(self.strings) * len(choices) > MAX_STRINGS:
            self.cut()
        self.strings = {a + b for a, b in product(self.strings, choices)}

    def read(self, tree) -> None:
        for op, arg in tree:
            name = str(op)
            exact = _exact([(op, arg)])
            if exact is not None:
                self.extend(exact)
            elif name == "SUBPATTERN":
                self.read(arg[3])
            elif name == "BRANCH":
                self.cut()
                self.found.append(_any([_query(t) for t in arg[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                self.read(arg[2])
                self.cut()
            elif name == "AT":
                continue
            else:
                self.cut()

    def done(self) -> Query:
        self.cut()
        return _all(self.found)


def _fold(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _exact(tree) -> set[str] | None:
    """The lower-cased strings a tree can match, where they are few; else None."""
    out = {""}
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some = {_fold(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            some = {_fold(a) for _, a in arg}
        elif name == "SUBPATTERN":
            some = _exact(arg[3])
        elif name == "BRANCH":
            each = [_exact(t) for t in arg[1]]
            some = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            some = _exact(arg[2])
            some = None if some is None else some | {""} if arg[0] == 0 else some
        else:
            return None
        if some is None or None in some or len(out) * len(some) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, some)}
    return out


def _query(tree) -> Query:
    reader = _Reader()
    reader.read(tree)
    return reader.done()


def trigram_query(pattern: str) -> Query:
    """The trigrams (of lower-cased ASCII text) that any match implies."""
    return _query(re._parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams, query[1])) if isinstance(query, tuple) else set()


class Index:
    """Postings of the wanted trigrams over a shard."""

    @staticmethod
    def table(wanted: list[str]) -> np.ndarray:
        """From three bytes to the number of a wanted trigram, counted from 1."""
        out = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted):
            a, b, c = t.encode("ascii")
            out[a << 16 | b << 8 | c] = k + 1
        return out

    def __init__(self, texts: pa.Array, wanted: list[str], table: np.ndarray) -> None:
        self.size = len(texts)
        low = pc.ascii_lower(texts).cast(pa.large_string())
        offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
        raw = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] is not None else np.zeros(0, np.uint8)
        keys = []
        for a in range(int(offsets[0]), int(offsets[-1]), 1 << 20):
            part = raw[a : min(a + (1 << 20) + 2, int(offsets[-1]))].astype(np.uint32)
            if len(part) < 3:
                continue
            ids = table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(ids)
            owner = np.searchsorted(offsets, at + a, "right") - 1
            keys.append(np.unique(ids[at].astype(np.int64) << 32 | owner))
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        which = found >> 32
        self.postings = {t: found[np.searchsorted(which, k + 1) : np.searchsorted(which, k + 1, "right")] & 0xFFFFFFFF for k, t in enumerate(wanted)}

    def rows(self, query: Query) -> np.ndarray:
        """Rows of the shard that can match."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        parts = sorted(map(self.rows, query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def rule_spans(rule: Rule, compiled: re.Pattern, text: str) -> list:
    return [(*m.span(), rule.kind) for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def scanner(rules: tuple[Rule, ...] = RULES) -> Callable[[pa.Array], list[list]]:
    """A function that finds all rules' spans in the texts of a shard."""
    compiled = [re.compile(r.pattern) for r in rules]
    asked = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, asked)))
    table = Index.table(wanted)

    def scan(texts: pa.Array) -> list[list]:
        index, values = Index(texts, wanted, table), texts.to_pylist()
        out: list[list] = [[] for _ in values]
        for rule, pattern, query in zip(rules, compiled, asked):
            for row in index.rows(query).tolist():
                out[row] += rule_spans(rule, pattern, values[row])
        return out

    return scan


def _find(rules: tuple[Rule, ...]):
    kinds = [r.kind for r in rules]
    base = [r.kind for r in rules if r.base]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                found = [ordered(s, kinds) for s in scan(batch.column(1))]
                basic = [[s for s in spans if s[2] in base] for spans in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), *(pa.array([sum(s[2] == kind for s in spans) for spans in basic], pa.int64()) for kind in base),
                    pa.array([digest(s) for s in basic], pa.string()), pa.array([joined(s) for s in found], pa.string()),
                ], names=["doc_id", *(f"n_{x}" for x in base), "base_sha256", "spans"])

    return work


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"n_{r.kind} long" for r in rules if r.base), "base_sha256 string", "spans string"])
    return common.texts(docs).mapInArrow(_find(rules), schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
