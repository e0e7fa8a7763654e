"""Personal data by base rules and a skip-chain conditional random field.

The base rules find e-mail addresses, IP addresses, card and phone numbers. The
field then labels tokens (runs without white space that hold a digit or an at
sign; all others are no entity for certain and cut the chain). Its potentials
are shape features of a token, transitions between neighbouring tokens, and skip
potentials between tokens of one document that are the same or similar (equal
digits, digits that end another's, or equal local parts), however far apart. The
tokens under one base span are one node, and so are neighbouring number tokens
whose digits together end those of a base span (``min_suffix`` at least, leading
zeros left out): a number counts as a whole, however it is spelled. Loopy belief propagation runs
over all documents of a batch at once; tokens under base spans are observed. A
token outside the base spans becomes a span when its belief for a kind reaches
``belief``, or ``belief_alone`` if it has no skip edge: so labels become
consistent within a document, and what looks like an entity beyond doubt is
found in documents without base spans as well.

Weights are trained here by pseudo-likelihood on a bounded sample of documents
labelled by the base rules; half of all tokens hide which rule they met, so the
field learns to label by shape and by neighbours. Skip potentials keep close to
``tie``, a prior.

Defined cases: null text counts as empty: no spans. Very long texts are read
whole. Repeated rows get the same spans. Ties in belief go to the kind listed
first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spans import Span, digest, joined, ordered

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can only begin where a run of digits does: it takes whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_DIGITS = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Options:
    belief: float = 0.9
    #: For tokens without skip edges, of which only shape and neighbours tell.
    belief_alone: float = 0.99
    rounds: int = 6
    damping: float = 0.3
    #: Documents the weights are fitted on (bounded sample; smallest hashes first).
    sample: int = 400
    min_digits: int = 5
    #: Prior of the skip potential between equal labels; repeats are too rare in a
    #: sample to learn it from nothing.
    tie: float = 6.0
    #: Digits by which a number without its first ones is known again.
    min_suffix: int = 7


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return ordered(out, KINDS)


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an at sign."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in _SPACES:
            start -= 1
        end = _SPACE.search(text, m.end())
        at = end.start() if end else len(text)
        out.append((start, at))
    return out


def skip_key(token: str, options: Options) -> str:
    """What makes tokens the same or similar; empty: the token has no skip edges."""
    if "@" in token:
        local = re.sub(r"[^a-z0-9]", "", token.split("@")[0].lower())
        return "@" + local if local else ""
    digits = "".join(_DIGITS.findall(token))
    return digits.lstrip("0") if len(digits) >= options.min_digits else ""


def features(token: str) -> list[int]:
    """Indices of a token's shape features: one of each group."""
    digits = "".join(_DIGITS.findall(token))
    n = len(digits)
    size = next(i for i, top in enumerate((0, 2, 4, 6, 8, 11, 13, 15, 16, 19, 10**9)) if n <= top)
    letters = sum(c.isalpha() for c in token)
    return [
        size,
        11 + min(token.count("."), 4),
        16 + min(token.count("-"), 3),
        20 + (letters > 0) + (letters > n),
        23 + min(len(token) // 6, 5),
        29 + (1 + luhn(digits) if 12 <= n <= 19 else 0),
        32 + ("@" in token) + 2 * (token[:1] == "+"),
    ]


SHAPES = 36
#: Then: which rule the token met (or none, or hidden).
N_FEATURES = SHAPES + len(LABELS) + 1


def _number(text: str) -> str:
    return "".join(_DIGITS.findall(text)).lstrip("0")


def _suffixes(number: str, options: Options) -> Iterator[str]:
    return (number[-k:] for k in range(options.min_suffix, min(len(number), 19) + 1))


def _run_end(text: str, found: list[tuple[int, int]], at: int, ends: set[str]) -> int:
    """The last of the number tokens from ``at`` on that together are one of
    ``ends``; ``at`` if there are none."""
    number, best = "", at
    for j in range(at, len(found)):
        a, b = found[j]
        token = text[a:b]
        if (j > at and a - found[j - 1][1] != 1) or "@" in token or any(c.isalpha() for c in token):
            break
        number += "".join(_DIGITS.findall(token))
        if len(number.lstrip("0")) > 19:
            break
        if j > at and number.lstrip("0") in ends:
            best = j
    return best


def nodes(text: str, base: list[Span], options: Options = Options(), runs: bool = True) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, label, keys) of each node: the tokens under one base span, a run
    of number tokens that repeats the end of a base span's digits (if ``runs``), or
    a token. The label is that of the base span it overlaps; nodes that share a key
    are the same or similar."""
    found, under, k = tokens(text), [], 0
    for start, end in found:
        while k < len(base) and base[k][1] <= start:
            k += 1
        under.append(next((i for i in range(k, len(base)) if base[i][0] < end and base[i][1] > start), -1) if k < len(base) and base[k][0] < end else -1)
    numbers = {i: _number(text[base[i][0] : base[i][1]]) for i in set(under) if i >= 0 and base[i][2] != "email"}
    ends = {x for number in numbers.values() for x in _suffixes(number, options)} if runs else set()
    made, i = [], 0
    while i < len(found):
        j = i
        if under[i] >= 0:
            while j + 1 < len(found) and under[j + 1] == under[i]:
                j += 1
        elif ends:
            j = _run_end(text, found, i, ends)
            if -1 != max(under[i : j + 1]):
                j = i
        start, end = found[i][0], found[j][1]
        keys = {skip_key(text[a:b], options) for a, b in found[i : j + 1]} - {""} if under[i] >= 0 or i == j else set()
        number = numbers.get(under[i], "") if under[i] >= 0 else "" if "@" in text[start:end] else _number(text[start:end])
        made.append((start, end, LABELS.index(base[under[i]][2]) if under[i] >= 0 else 0, keys, number))
        i = j + 1
    whole = {number for *_, number in made if len(number) >= options.min_suffix}
    return [(a, b, label, sorted(keys | {x for x in _suffixes(number, options) if x in whole} | ({number} & whole))) for a, b, label, keys, number in made]


def edges(found: list[tuple[int, int, int, list[str]]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (neighbours with one white space between) and skip edges (each
    node to the one before it with a key of its own)."""
    chain = [(i - 1, i) for i in range(1, len(found)) if found[i][0] - found[i - 1][1] == 1]
    last: dict[str, int] = {}
    skip = []
    for i, (_, _, _, keys) in enumerate(found):
        skip += [(j, i) for j in sorted({last[key] for key in keys if key in last})]
        last.update(dict.fromkeys(keys, i))
    return chain, skip


@dataclass(frozen=True)
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(texts: list[str], options: Options = Options(), steps: int = 300) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels."""
    size = len(LABELS)
    x_rows, y, left, right, others = [], [], [], [], []
    for text in texts:
        found = nodes(text, base_spans(text), options, runs=False)
        chain, skip = edges(found)
        before, after = dict((j, i) for i, j in chain), dict(chain)
        linked: dict[int, list[int]] = {}
        for i, j in skip:
            linked.setdefault(i, []).append(j)
            linked.setdefault(j, []).append(i)
        for i, (a, b, label, _) in enumerate(found):
            rule = SHAPES + (len(LABELS) if (a + i) % 2 else label)
            x_rows.append([*features(text[a:b]), rule])
            y.append(label)
            left.append(found[before[i]][2] if i in before else -1)
            right.append(found[after[i]][2] if i in after else -1)
            counts = np.zeros(size)
            for j in linked.get(i, []):
                counts[found[j][2]] += 1
            others.append(counts)
    unary, chain_w, prior = np.zeros((N_FEATURES, size)), np.zeros((size, size)), options.tie * np.eye(size)
    skip_w = prior.copy()
    if not y:
        return Field(unary, chain_w, skip_w)
    x, y_, others_ = np.array(x_rows), np.array(y), np.array(others)
    left_, right_ = np.array(left), np.array(right)
    has_l, has_r = left_ >= 0, right_ >= 0
    goal = np.eye(size)[y_]
    for _ in range(steps):
        score = unary[x].sum(axis=1) + others_ @ skip_w
        score[has_l] += chain_w[left_[has_l]]
        score[has_r] += chain_w.T[right_[has_r]]
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        error = (goal - p) / len(y_)
        slope = np.zeros_like(unary)
        for k in range(x.shape[1]):
            np.add.at(slope, x[:, k], error)
        unary += 4 * slope - 1e-4 * unary
        up = np.zeros_like(chain_w)
        np.add.at(up, left_[has_l], error[has_l])
        down = np.zeros_like(chain_w)
        np.add.at(down, right_[has_r], error[has_r])
        chain_w += 4 * (up + down.T) - 1e-4 * chain_w
        pull = others_.T @ error
        skip_w += 4 * (pull + pull.T) / 2 - 1e-2 * (skip_w - prior)
    return Field(unary, chain_w, skip_w)


def beliefs(field: Field, scores: np.ndarray, chain: np.ndarray, skip: np.ndarray, options: Options) -> np.ndarray:
    """Loopy sum-product in the logarithm: scores are nodes x labels, edges pairs of nodes."""
    size = scores.shape[1]
    pairs = np.concatenate([chain.reshape(-1, 2), skip.reshape(-1, 2)]).astype(np.int64)
    if len(pairs):
        n_chain = len(chain.reshape(-1, 2))
        forward = np.where((np.arange(len(pairs)) < n_chain)[:, None, None], field.chain, field.skip)
        src = np.concatenate([pairs[:, 0], pairs[:, 1]])
        dst = np.concatenate([pairs[:, 1], pairs[:, 0]])
        potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(src), size))
        for _ in range(options.rounds):
            incoming = scores.copy()
            np.add.at(incoming, dst, messages)
            out = incoming[src] - messages[back]
            new = np.logaddexp.reduce(out[:, :, None] + potential, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            messages = options.damping * messages + (1 - options.damping) * new
        scores = scores.copy()
        np.add.at(scores, dst, messages)
    scores = scores - scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    return p / p.sum(axis=1, keepdims=True)


def consistent_spans(field: Field, docs: list[tuple[str, list[Span]]], options: Options = Options()) -> list[list[Span]]:
    """The spans that the field adds to each document's base spans."""
    added: list[list[Span]] = [[] for _ in docs]
    scores, chain, skip, where = [], [], [], []
    tied: set[int] = set()
    for d, (text, base) in enumerate(docs):
        found = nodes(text, base, options)
        links, far = edges(found)
        first = len(scores)
        chain += [(i + first, j + first) for i, j in links]
        skip += [(i + first, j + first) for i, j in far]
        for a, b, label, keys in found:
            row = field.unary[[*features(text[a:b]), SHAPES + (label or len(LABELS))]].sum(axis=0)
            if label:  # observed
                row = np.where(np.arange(len(LABELS)) == label, 0.0, -50.0)
            scores.append(row)
            where.append((d, a, b, label))
        tied.update(first + i for pair in far for i in pair)
    if not scores:
        return added
    p = beliefs(field, np.array(scores), np.array(chain, np.int64), np.array(skip, np.int64), options)
    for i, ((d, a, b, label), belief) in enumerate(zip(where, p)):
        best = int(belief.argmax())
        if label or not best or belief[best] < (options.belief if i in tied else options.belief_alone):
            continue
        text = docs[d][0]
        while a < b and not (text[a].isalnum() or text[a] in "+@"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == "@"):
            b -= 1
        if a < b:
            added[d].append((a, b, LABELS[best]))
    return added


def _find(field: Field, options: Options):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                docs = [(x, base_spans(x)) for x in batch.column(1).to_pylist()]
                more = consistent_spans(field, docs, options)
                count = {kind: pa.array([sum(s[2] == kind for s in base) for _, base in docs], pa.int64()) for kind in KINDS}
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), *count.values(), pa.array([digest(base) for _, base in docs], pa.string()),
                    pa.array([joined(ordered(base + new, KINDS)) for (_, base), new in zip(docs, more)], pa.string()),
                    pa.array([len(new) for new in more], pa.int64()),
                ], names=["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans", "n_added"])

    return work


def fit(docs: DataFrame, options: Options = Options()) -> Field:
    """Weights from the ``sample`` documents with a digit or at sign whose hashes are smallest.

    Only the documents whose hash is under a threshold are sorted: about twice the
    sample, however many partitions there are. Hashes go to the driver first, and
    then the chosen texts."""
    top = 1 << 40
    rows = common.texts(docs).where(F.col("text").rlike("[0-9@]")).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(top)).alias("h"))
    n = rows.count()
    rows = rows.where(F.col("h") < int(min(1.0, 2 * options.sample / max(n, 1)) * top))
    chosen = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(options.sample).collect()]
    found = rows.where(F.col("h").isin(chosen)).distinct().collect() if chosen else []  # of equal hashes all, hardly ever two
    return train([r["text"] for r in sorted(found, key=lambda r: (r["h"], r["text"]))], options)


def find(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256, all spans and n_added."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"n_{x} long" for x in KINDS), "base_sha256 string", "spans string", "n_added long"])
    return common.texts(docs).mapInArrow(_find(fit(docs, options), options), schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
