"""Features of C and C++ sources.

With libclang's bindings installed the tree is libclang's. Without them a lexer
gives the counters (without those of directives) and the parser of ``c_parser``
the tree, in the same kinds. Headers are not read, so names from them have no
types. Sources too deep for the parser get a structure by brackets.
"""

from __future__ import annotations

import importlib.util
import re

from . import c_parser
from .python_source import add_node, empty_features, sha256_of

# Operators that are counted.
OPERATORS = (
    "+", "-", "*", "/", "%", "+=", "-=", "*=", "/=", "%=", "=", "!", "&&", "||", "!=", "==", "<=", ">=", "<", ">", "^", "&", "|", "<<", ">>", "~",
)
COMPILE_ARGS = ["-x", "c++", "--std=c++11"]
IGNORED = ("PREPROCESSING_DIRECTIVE", "MACRO_INSTANTIATION", "INCLUSION_DIRECTIVE", "USING_DIRECTIVE", "NAMESPACE")
KEYWORDS = frozenset(
    "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t class compl const constexpr const_cast continue "
    "decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace "
    "new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast return short signed sizeof static "
    "static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void "
    "volatile wchar_t while xor xor_eq".split()
)
_LEXEME = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<directive>^[ \t]*\#(?:\\\n|[^\n])*)
    |(?P<literal>(?:u8|[uUL])?R"(?P<mark>[^()\\ ]{0,16})\(.*?\)(?P=mark)"|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"|(?:[uUL])?'(?:\\.|[^'\\\n])+'|\.?[0-9](?:[eEpP][+-]|['.\w])*)
    |(?P<word>[^\W\d]\w*)
    |(?P<punctuation><<=|>>=|->\*|\.\.\.|::|\+\+|--|->|\.\*|[-+*/%&|^=!<>]=|&&|\|\||<<|>>|[-+*/%&|^~!=<>?:;,.(){}\[\]\#])""",
    re.S | re.M | re.X,
)


def lex(code: str) -> list[tuple[str, str]]:
    """(kind, spelling) of the tokens; comments and directives are left out."""
    out = []
    for m in _LEXEME.finditer(code):
        kind = m.lastgroup if m.lastgroup != "mark" else "literal"
        if kind == "word":
            kind = "keyword" if m[0] in KEYWORDS else "identifier"
        if kind not in ("comment", "directive"):
            out.append((kind, m[0]))
    return out


def _count(out: dict, kind: str, spelling: str) -> None:
    group = "operators" if kind == "punctuation" and spelling in OPERATORS else {"keyword": "keywords", "literal": "literals"}.get(kind)
    if group:
        out[group][spelling] = out[group].get(spelling, 0) + 1


def _directives(code: str) -> tuple[list[tuple[str, str]], list[tuple[str, list[tuple[str, str]]]]]:
    """(tokens that the conditions leave, with constants of the file put in; definitions as (name, tokens))."""
    tokens, definitions, constants = [], [], {}
    active = [True]
    for m in _LEXEME.finditer(code):
        kind = m.lastgroup if m.lastgroup != "mark" else "literal"
        if kind == "directive":
            word, _, rest = m[0].replace("\\\n", " ").strip()[1:].strip().partition(" ")
            rest = rest.strip()
            if word in ("if", "ifdef", "ifndef"):
                holds = rest not in ("0", "false") if word == "if" else (rest in constants) == (word == "ifdef")
                active.append(active[-1] and holds)
            elif word in ("else", "elif") and len(active) > 1:
                active[-1] = active[-2] and not active[-1]
            elif word == "endif" and len(active) > 1:
                active.pop()
            elif word == "define" and active[-1] and (name := re.match(r"\w+", rest)):
                body = lex(rest[name.end():])
                definitions.append((name[0], [("identifier", name[0]), *body]))
                constants[name[0]] = None if rest[name.end():].startswith("(") else body
            elif word == "undef":
                constants.pop(rest, None)
        elif kind != "comment" and active[-1]:
            if kind == "word":
                kind = "keyword" if m[0] in KEYWORDS else "identifier"
            tokens += _expand(kind, m[0], constants, ())
    return tokens, definitions


def _expand(kind: str, spelling: str, constants: dict, inside: tuple[str, ...]) -> list[tuple[str, str]]:
    body = constants.get(spelling) if kind == "identifier" and spelling not in inside else None
    if body is None or len(inside) > 8:
        return [(kind, spelling)]
    return [t for k, s in body for t in _expand(k, s, constants, (*inside, spelling))]


def _parsed(code: str) -> dict | None:
    """Features by the parser of this package; null for what it gives up on."""
    out = empty_features()
    for kind, spelling in lex(code):
        _count(out, kind, spelling)
    tokens, definitions = _directives(code)
    try:
        top = c_parser.parse(tokens)
    except (RecursionError, c_parser.TooAmbiguous):
        return None
    for name, body in definitions:
        _add_tree(out, c_parser.Node("MACRO_DEFINITION", name), body)
    for node in top:
        _add_tree(out, node, tokens[node.first : node.last])
    return out


def _add_tree(out: dict, top: c_parser.Node, tokens: list[tuple[str, str]]) -> None:
    """Nodes in the order of the source; a declaration without children has its tokens noted."""
    stack = [(top, 1)]
    while stack:
        node, depth = stack.pop()
        out["tokens"].append(c_parser.KINDS[node.kind])
        add_node(out, f"CursorKind.{node.kind}", depth)
        stack += [(c, depth + 1) for c in reversed(node.children)]
    out["head_nodes"].append(top.spelling)
    if not top.children:
        for kind, _ in tokens:
            label = f"TokenKind.{kind.upper()}"
            add_node(out, label, 1)
            out["head_nodes"].append(label)


def _brackets(code: str) -> dict:
    """Features of a source too deep or too ambiguous to parse: statements and blocks."""
    out = empty_features()
    depth, fresh, head = 1, True, None
    for kind, spelling in lex(code):
        _count(out, kind, spelling)
        if spelling == "}":
            depth, fresh = max(1, depth - 1), True
            continue
        label = "Block" if spelling == "{" else "Statement" if fresh else kind.capitalize()
        if spelling == ";":
            fresh = True
            continue
        if fresh and depth == 1:
            head = len(out["head_nodes"])
            out["head_nodes"].append(spelling)
        if head is not None and depth == 1 and kind == "identifier" and out["head_nodes"][head] in KEYWORDS:
            out["head_nodes"][head] = spelling
        add_node(out, label, depth if fresh else depth + 1)
        out["tokens"].append(sorted(("punctuation", "keyword", "identifier", "literal")).index(kind))
        fresh = spelling == "{"
        depth += spelling == "{"
    return out


def _clang(code: str, path: str) -> dict | None:
    from clang.cindex import CursorKind, Index, TokenKind, TranslationUnit, TranslationUnitLoadError

    name = path or "source.cpp"
    try:
        unit = Index.create().parse(name, args=COMPILE_ARGS, unsaved_files=[(name, code)], options=TranslationUnit.PARSE_DETAILED_PROCESSING_RECORD)
    except TranslationUnitLoadError:
        return None
    out = empty_features()
    names = {TokenKind.PUNCTUATION: "punctuation", TokenKind.KEYWORD: "keyword", TokenKind.LITERAL: "literal"}
    for token in unit.cursor.get_tokens():
        _count(out, names.get(token.kind, ""), token.spelling)
    ignored = {getattr(CursorKind, k) for k in IGNORED}
    base = name.rsplit("/", 1)[-1]
    top = [c for c in unit.cursor.get_children() if str(c.location.file).rsplit("/", 1)[-1] == base and c.kind not in ignored]
    stack = [(c, 1) for c in reversed(top)]
    while stack:
        node, depth = stack.pop()
        out["tokens"].append(node.kind.value)
        add_node(out, repr(node.kind), depth)
        if depth == 1:
            out["head_nodes"].append(node.spelling)
        children = list(node.get_children())
        if depth == 1 and not children:
            for token in node.get_tokens():
                add_node(out, repr(token.kind), 1)
                out["head_nodes"].append(repr(token.kind))
        stack += [(c, depth + 1) for c in reversed(children)]
    return out


def has_clang() -> bool:
    return importlib.util.find_spec("clang") is not None


def extract(code: str, path: str = "") -> dict | None:
    out = _clang(code, path) if has_clang() else _parsed(code) or _brackets(code)
    return None if out is None else out | {"sha256": sha256_of(out["structure"])}


def decode(content: bytes) -> str | None:
    """UTF-8 without the bytes that are none."""
    return content.decode("utf-8", errors="ignore")
