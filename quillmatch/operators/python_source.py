"""Features of Python sources from their syntax tree."""

from __future__ import annotations

import ast
import hashlib
import logging

log = logging.getLogger("quillmatch")

# Node types that are counted, and the token of each node type.
OPERATORS = (
    "UAdd", "USub", "Not", "Invert", "Add", "Sub", "Mult", "Div", "FloorDiv", "Mod", "Pow", "LShift", "RShift", "BitOr", "BitXor", "BitAnd", "MatMult",
    "And", "Or", "Assign", "AnnAssign", "AugAssign", "Eq", "NotEq", "Lt", "LtE", "Gt", "GtE", "Is", "IsNot", "In", "NotIn",
)
KEYWORDS = (
    "Return", "Yield", "YieldFrom", "Global", "Lambda", "FunctionDef", "Continue", "Try", "With", "IfExp", "For", "While", "Break", "Pass", "Raise",
    "Assert", "Delete", "If",
)
LITERALS = (
    "Constant", "FormattedValue", "JoinedStr", "List", "Tuple", "Set", "Dict", "Num", "Str", "Bytes", "NameConstant", "Ellipsis",
)
IMPORTS = ("Import", "ImportFrom")
TOKENS = {
    "UAdd": 0, "USub": 0, "Not": 0, "Invert": 0,
    "Add": 1, "Sub": 1, "Mult": 1, "Div": 1, "FloorDiv": 1, "Mod": 1, "Pow": 1, "LShift": 1, "RShift": 1, "BitOr": 1, "BitXor": 1, "BitAnd": 1, "MatMult": 1,
    "And": 2, "Or": 2,
    "Eq": 3, "NotEq": 3, "Lt": 3, "LtE": 3, "Gt": 3, "GtE": 3, "Is": 3, "IsNot": 3, "In": 3, "NotIn": 3,
    "Assign": 4, "AnnAssign": 4, "AugAssign": 4,
    "For": 5, "AsyncFor": 5, "While": 5,
    "If": 6, "IfExp": 6,
    "FunctionDef": 7, "AsyncFunctionDef": 7, "ClassDef": 8, "Return": 9, "Yield": 10, "YieldFrom": 10,
    "Raise": 11, "Try": 11, "Assert": 11,
    "Import": 12, "ImportFrom": 12,
    "Pass": 13, "Break": 13, "Continue": 13,
    "Delete": 14, "With": 15, "AsyncWith": 15, "Global": 16, "Nonlocal": 17, "Exp": 18, "Lambda": 19, "alias": 20, "ExceptHandler": 21,
    "withitem": 22, "arguments": 23, "arg": 24, "Await": 25,
    "Tuple": 26, "Set": 26, "Dict": 26, "List": 26,
    "Constant": 27, "FormattedValue": 28, "JoinedStr": 29, "Num": 30, "Str": 31, "Bytes": 32, "NameConstant": 33, "Ellipsis": 34, "Name": 35,
}


def empty_features() -> dict:
    return {
        "count_of_nodes": 0, "head_nodes": [], "operators": {}, "keywords": {}, "literals": {}, "unodes": {}, "from_num": {}, "count_unodes": 0,
        "structure": [], "tokens": [], "tokens_pos": [],
    }


def add_node(features: dict, label: str, depth: int) -> None:
    """Note a node; labels get numbers in the order in which they first appear."""
    unodes = features["unodes"]
    if label not in unodes:
        features["from_num"][len(unodes)] = label
        unodes[label] = len(unodes)
        features["count_unodes"] = len(unodes)
    features["structure"].append((depth, unodes[label]))
    features["count_of_nodes"] += 1


def sha256_of(structure: list[tuple[int, int]]) -> str:
    return hashlib.sha256(str([uid for _, uid in structure]).encode()).hexdigest()


def parse(code: str, path: str = "") -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # tab and indentation errors are syntax errors
        log.error("%s in the file '%s': %s", type(e).__name__, path, e)
        return None


def _head(node: ast.AST, label: str) -> str:
    """What a top node is called: the assigned name where there is one."""
    name = None
    target = node.targets[0] if isinstance(node, ast.Assign) and node.targets else getattr(node, "target", None) if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else None
    if isinstance(target, ast.Name):
        name = target.id
    elif isinstance(target, ast.Attribute) and not isinstance(node, ast.Assign) and hasattr(target.value, "id"):
        name = f"{target.value.id}.{target.attr}"
    return f"{name or label}[{node.lineno}]"


def features_of(tree: ast.Module) -> dict:
    """Walk the tree in pre-order (with an explicit stack, as sources can be deep)."""
    out = empty_features()
    counters = {t: out[group] for group, types in (("literals", LITERALS), ("keywords", KEYWORDS), ("operators", OPERATORS)) for t in types}
    place = (1, 0)
    stack: list[tuple[ast.AST, int]] = [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        kind = type(node).__name__
        if kind in TOKENS:
            # A node without a place of its own has that of the one before it.
            place = (node.lineno, node.col_offset) if hasattr(node, "lineno") and hasattr(node, "col_offset") else place
            out["tokens"].append(TOKENS[kind])
            out["tokens_pos"].append(place)
        if kind in counters:
            counters[kind][kind] = counters[kind].get(kind, 0) + 1
        if kind in IMPORTS:
            continue
        if depth:
            name = getattr(node, "name", None)
            label = name if isinstance(name, str) else kind
            add_node(out, label, depth)
            if depth == 1:
                out["head_nodes"].append(_head(node, label) if hasattr(node, "lineno") else label)
        stack += [(child, depth + 1) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def extract(code: str, path: str = "") -> dict | None:
    """The features of a source, with the hash of its structure; None if it can't be parsed."""
    tree = parse(code, path)
    if tree is None:
        return None
    out = features_of(tree)
    return out | {"sha256": sha256_of(out["structure"])}


def decode(content: bytes) -> str | None:
    """Strict UTF-8; None for empty or undecodable files."""
    if not content:
        return None
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return None
