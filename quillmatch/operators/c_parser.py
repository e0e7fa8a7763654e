"""A parser of C and C++ sources into trees of cursor kinds.

It reads one file without its headers. Conversions that the compiler would
insert (loads, decays, arithmetic conversions) are nodes, as far as the types
are declared in the file; names that are not declared count as scalars, or as
functions where they are called. What is no declaration, statement or
expression becomes an unexposed node, and parsing goes on behind it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Numbers of the cursor kinds.
KINDS = {
    "UNEXPOSED_DECL": 1, "STRUCT_DECL": 2, "UNION_DECL": 3, "CLASS_DECL": 4, "ENUM_DECL": 5, "FIELD_DECL": 6, "ENUM_CONSTANT_DECL": 7,
    "FUNCTION_DECL": 8, "VAR_DECL": 9, "PARM_DECL": 10, "TYPEDEF_DECL": 20, "CXX_METHOD": 21, "NAMESPACE": 22, "LINKAGE_SPEC": 23,
    "CONSTRUCTOR": 24, "DESTRUCTOR": 25, "CONVERSION_FUNCTION": 26, "TEMPLATE_TYPE_PARAMETER": 27, "TEMPLATE_NON_TYPE_PARAMETER": 28,
    "FUNCTION_TEMPLATE": 30, "CLASS_TEMPLATE": 31, "USING_DIRECTIVE": 34, "USING_DECLARATION": 35, "TYPE_ALIAS_DECL": 36,
    "CXX_ACCESS_SPEC_DECL": 39, "TYPE_REF": 43, "CXX_BASE_SPECIFIER": 44, "TEMPLATE_REF": 45, "NAMESPACE_REF": 46, "MEMBER_REF": 47,
    "UNEXPOSED_EXPR": 100, "DECL_REF_EXPR": 101, "MEMBER_REF_EXPR": 102, "CALL_EXPR": 103, "INTEGER_LITERAL": 106,
    "FLOATING_LITERAL": 107, "STRING_LITERAL": 109, "CHARACTER_LITERAL": 110, "PAREN_EXPR": 111, "UNARY_OPERATOR": 112,
    "ARRAY_SUBSCRIPT_EXPR": 113, "BINARY_OPERATOR": 114, "COMPOUND_ASSIGNMENT_OPERATOR": 115, "CONDITIONAL_OPERATOR": 116,
    "CSTYLE_CAST_EXPR": 117, "INIT_LIST_EXPR": 119, "CXX_STATIC_CAST_EXPR": 124, "CXX_DYNAMIC_CAST_EXPR": 125,
    "CXX_REINTERPRET_CAST_EXPR": 126, "CXX_CONST_CAST_EXPR": 127, "CXX_FUNCTIONAL_CAST_EXPR": 128, "CXX_BOOL_LITERAL_EXPR": 130,
    "CXX_NULL_PTR_LITERAL_EXPR": 131, "CXX_THIS_EXPR": 132, "CXX_THROW_EXPR": 133, "CXX_NEW_EXPR": 134, "CXX_DELETE_EXPR": 135,
    "CXX_UNARY_EXPR": 136, "LAMBDA_EXPR": 144, "UNEXPOSED_STMT": 200, "LABEL_STMT": 201, "COMPOUND_STMT": 202, "CASE_STMT": 203,
    "DEFAULT_STMT": 204, "IF_STMT": 205, "SWITCH_STMT": 206, "WHILE_STMT": 207, "DO_STMT": 208, "FOR_STMT": 209, "GOTO_STMT": 210,
    "CONTINUE_STMT": 212, "BREAK_STMT": 213, "RETURN_STMT": 214, "CXX_CATCH_STMT": 223, "CXX_TRY_STMT": 224,
    "CXX_FOR_RANGE_STMT": 225, "NULL_STMT": 230, "DECL_STMT": 231, "MACRO_DEFINITION": 501,
}

#: Arithmetic types by rank.
_RANKS = ("bool", "char", "unsigned char", "short", "unsigned short", "int", "unsigned int", "long", "unsigned long", "long long",
          "unsigned long long", "float", "double", "long double")
_RANK = {name: i for i, name in enumerate(_RANKS)}
_BASIC = frozenset("bool char short int long float double signed unsigned void wchar_t char16_t char32_t auto".split())
_QUALIFIERS = frozenset("const volatile static extern inline register mutable constexpr virtual explicit friend thread_local typename".split())
_ALIASES = {
    "size_t": "unsigned long", "ssize_t": "long", "ptrdiff_t": "long", "int8_t": "char", "uint8_t": "unsigned char", "int16_t": "short",
    "uint16_t": "unsigned short", "int32_t": "int", "uint32_t": "unsigned int", "int64_t": "long", "uint64_t": "unsigned long",
    "time_t": "long", "clock_t": "long",
}
_STREAMS = frozenset("cout cin cerr clog endl".split())
_LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), (".*", "->*"))
_ASSIGNMENTS = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_CASTS = {"static_cast": "CXX_STATIC_CAST_EXPR", "dynamic_cast": "CXX_DYNAMIC_CAST_EXPR",
          "reinterpret_cast": "CXX_REINTERPRET_CAST_EXPR", "const_cast": "CXX_CONST_CAST_EXPR"}
_RECORDS = {"struct": "STRUCT_DECL", "class": "CLASS_DECL", "union": "UNION_DECL"}


#: A type that is a parameter of a template: nothing is converted.
_DEPENDENT = "(dependent)"


@dataclass(frozen=True)
class Type:
    base: str = "?"
    pointers: int = 0
    arrays: int = 0
    const: bool = False
    function: bool = False

    @property
    def arithmetic(self) -> bool:
        return self.base in _RANK and not (self.pointers or self.arrays or self.function)

    @property
    def record(self) -> bool:
        """An object of a class."""
        return self.base not in _RANK and self.base not in ("?", "void", _DEPENDENT) and not (self.pointers or self.arrays or self.function)

    def pointee(self) -> Type:
        if self.arrays:
            return replace(self, arrays=self.arrays - 1)
        return replace(self, pointers=max(0, self.pointers - 1))


_INT, _BOOL, _UNKNOWN = Type("int"), Type("bool"), Type()


@dataclass
class Node:
    kind: str
    spelling: str = ""
    children: list[Node] = field(default_factory=list)
    #: Tokens from, to (end exclusive).
    first: int = 0
    last: int = 0


@dataclass
class _Value:
    node: Node
    type: Type
    #: Whether it has to be loaded.
    place: bool = False


class _Unexpected(Exception):
    pass


class TooAmbiguous(Exception):
    """Attempts that failed cost more than a fixed multiple of the source."""


def parse(tokens: list[tuple[str, str]]) -> list[Node]:
    """The top-level declarations of (kind, spelling) tokens without comments and directives."""
    return _Parser(tokens).unit()


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens = tokens
        self.at = 0
        #: Tokens read in attempts that failed, and how many may be.
        self.wasted, self.allowed = 0, 64 * len(tokens) + 1000
        #: Tokens of which a '>' was taken: (place, token).
        self.split: list[tuple[int, tuple[str, str]]] = []
        self.scopes: list[dict[str, Type]] = [{}]
        self.functions: dict[str, tuple[Type, list[Type]]] = {}
        self.types: dict[str, Type] = {}
        self.templates: set[str] = set()
        self.fields: dict[str, Type] = {}
        self.result = _UNKNOWN

    # Tokens

    def see(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self, *spellings: str) -> bool:
        if self.see() in spellings and self.at < len(self.tokens):
            self.at += 1
            return True
        return False

    def need(self, spelling: str) -> None:
        if spelling == ">" and self.see() in (">>", ">=", ">>="):
            self.split.append((self.at, self.tokens[self.at]))
            self.tokens[self.at] = ("punctuation", self.see()[1:])
        elif not self.take(spelling):
            raise _Unexpected(spelling)

    def name(self) -> str:
        if self.kind() != "identifier":
            raise _Unexpected("name")
        self.at += 1
        return self.see(-1)

    def skip(self) -> None:
        """To behind the next ';' or closed block of this level."""
        depth = 0
        while self.at < len(self.tokens):
            t = self.see()
            if t == "}" and not depth:
                return
            self.at += 1
            depth += (t in ("{", "(", "[")) - (t in ("}", ")", "]"))
            if depth <= 0 and t in (";", "}"):
                return

    def attempt(self, rule):
        """What the rule finds, or nothing where it doesn't fit."""
        start, depth, scope, mark = self.at, len(self.scopes), dict(self.scopes[-1]), len(self.split)
        try:
            return rule()
        except _Unexpected:
            del self.scopes[depth:]
            self.scopes[-1] = scope
            self.back(start, mark)
            return None

    def back(self, start: int, mark: int) -> None:
        self.wasted += self.at - start
        if self.wasted > self.allowed:
            raise TooAmbiguous
        while len(self.split) > mark:
            place, token = self.split.pop()
            self.tokens[place] = token
        self.at = start

    def node(self, kind: str, start: int, children: list[Node] = (), spelling: str = "") -> Node:
        return Node(kind, spelling, list(children), start, self.at)

    # Declarations

    def unit(self) -> list[Node]:
        out: list[Node] = []
        while self.at < len(self.tokens):
            start = self.at
            found = self.recovering(self.declaration, "UNEXPOSED_DECL")
            out += [n for n in found if n.kind not in ("NAMESPACE", "USING_DIRECTIVE")]
            if self.at == start:
                self.at += 1
        return out

    def recovering(self, rule, kind: str) -> list[Node]:
        start, depth = self.at, len(self.scopes)
        try:
            return rule()
        except _Unexpected:
            del self.scopes[depth:]
            self.at = start
            self.skip()
            return [self.node(kind, start)] if self.at > start else []

    def declaration(self, member: str | None = None) -> list[Node]:
        start = self.at
        t = self.see()
        if self.take(";"):
            return []
        if t == "using":
            return [self.using()]
        if t == "namespace":
            self.at += 1
            spelling = self.name() if self.kind() == "identifier" else ""
            self.need("{")
            inside: list[Node] = []
            while not self.take("}"):
                if self.at >= len(self.tokens):
                    break
                before = self.at
                inside += self.recovering(self.declaration, "UNEXPOSED_DECL")
                self.at += self.at == before
            return [self.node("NAMESPACE", start, inside, spelling)]
        if t == "template":
            return self.template(member)
        if t == "extern" and self.kind(1) == "literal":
            self.at += 2
            if not self.take("{"):
                return [self.node("LINKAGE_SPEC", start, self.declaration())]
            inside = []
            while self.at < len(self.tokens) and not self.take("}"):
                before = self.at
                inside += self.recovering(self.declaration, "UNEXPOSED_DECL")
                self.at += self.at == before
            return [self.node("LINKAGE_SPEC", start, inside)]
        if t == "typedef":
            self.at += 1
            refs, base, records = self.specifiers()
            out = list(records)
            while True:
                spelling, kind, more, _ = self.declarator(base)
                self.types[spelling] = kind
                out.append(self.node("TYPEDEF_DECL", start, refs + records + more, spelling))
                if not self.take(","):
                    break
            self.need(";")
            return out
        if member is not None:
            if t in ("public", "private", "protected") and self.see(1) == ":":
                self.at += 2
                return [self.node("CXX_ACCESS_SPEC_DECL", start)]
            while self.see() in ("virtual", "explicit", "inline", "constexpr"):
                self.at += 1
            if self.see() == member and self.see(1) == "(" or self.see() == "~" and self.see(1) == member:
                kind = "DESTRUCTOR" if self.take("~") else "CONSTRUCTOR"
                spelling = ("~" if kind == "DESTRUCTOR" else "") + self.name()
                return [self.function(kind, spelling, [], Type("void"), start)]
            self.at = start
        elif self.kind() == "identifier" and self.see(1) == "::" and self.see(2 + (self.see(2) == "~")) == t:
            self.at += 2
            kind = "DESTRUCTOR" if self.take("~") else "CONSTRUCTOR"
            spelling = ("~" if kind == "DESTRUCTOR" else "") + self.name()
            if self.see() == "(":
                return [self.function(kind, spelling, [Node("TYPE_REF", t)], Type("void"), start)]
            self.at = start
        return self.variables("FIELD_DECL" if member is not None else "VAR_DECL", member, start)

    def using(self) -> Node:
        start = self.at
        self.at += 1
        if self.take("namespace"):
            spelling = self.name()
            self.need(";")
            return self.node("USING_DIRECTIVE", start, [self.node("NAMESPACE_REF", start + 2, [], spelling)])
        if self.see(1) == "=":
            spelling = self.name()
            self.at += 1
            refs, base, _ = self.specifiers()
            self.types[spelling] = self.pointers(base)
            self.need(";")
            return self.node("TYPE_ALIAS_DECL", start, refs, spelling)
        refs = []
        while self.kind() == "identifier" and self.see(1) == "::":
            refs.append(self.node("NAMESPACE_REF", self.at, [], self.see()))
            self.at += 2
        spelling = self.name()
        self.need(";")
        return self.node("USING_DECLARATION", start, refs, spelling)

    def template(self, member: str | None) -> list[Node]:
        start = self.at
        self.at += 1
        self.need("<")
        parameters: list[Node] = []
        while self.see() != ">":
            begin = self.at
            if self.take("typename", "class"):
                spelling = self.name() if self.kind() == "identifier" else ""
                self.types[spelling] = Type(_DEPENDENT)
                if self.take("="):
                    self.specifiers()
                parameters.append(self.node("TEMPLATE_TYPE_PARAMETER", begin, [], spelling))
            else:
                refs, base, _ = self.specifiers()
                spelling, kind, more, _ = self.declarator(base)
                self.scopes[-1][spelling] = kind
                parameters.append(self.node("TEMPLATE_NON_TYPE_PARAMETER", begin, refs + more, spelling))
            if not self.take(","):
                break
        self.need(">")
        out = self.declaration(member)
        for n in out:
            n.kind = {"STRUCT_DECL": "CLASS_TEMPLATE", "CLASS_DECL": "CLASS_TEMPLATE", "FUNCTION_DECL": "FUNCTION_TEMPLATE",
                      "CXX_METHOD": "FUNCTION_TEMPLATE"}.get(n.kind, n.kind)
            n.children, n.first = parameters + n.children, start
            if n.kind == "CLASS_TEMPLATE":
                self.templates.add(n.spelling)
        return out

    def variables(self, kind: str, member: str | None, start: int) -> list[Node]:
        refs, base, out = self.specifiers()
        out = list(out)
        if self.take(";"):
            return out
        while True:
            spelling, found, more, owner = self.declarator(base)
            if self.see() == "(" and not found.arrays and (kind != "VAR_DECL" or len(self.scopes) == 1) and self.attempt(self.probe_parameters):
                into = "CXX_METHOD" if member is not None or owner else "FUNCTION_DECL"
                out.append(self.function(into, spelling, refs + owner + more, found, start))
                if self.see(-1) == "}":
                    return out
            else:
                self.declare(spelling, found, kind)
                children = refs + more + self.initializer(found)
                out.append(self.node(kind, start, children, spelling))
            if not self.take(","):
                break
        self.need(";")
        return out

    def declare(self, spelling: str, kind: Type, into: str) -> None:
        self.scopes[-1][spelling] = kind
        if into == "FIELD_DECL":
            self.fields[spelling] = kind

    def initializer(self, kind: Type) -> list[Node]:
        if self.take("="):
            return [self.braces(kind)] if self.see() == "{" else [self.convert(self.assignment(), kind).node]
        if self.see() == "{":
            return [self.braces(kind)]
        start = self.at
        if self.take("("):
            found = self.arguments(")", [])
            return [self.node("CALL_EXPR", start, found)] if kind.record else found
        if self.take(":"):
            return [self.conditional().node]
        return [self.node("CALL_EXPR", start, [], kind.base)] if kind.record else []

    def braces(self, kind: Type) -> Node:
        start = self.at
        self.need("{")
        inside: list[Node] = []
        element = kind.pointee() if kind.arrays else _UNKNOWN
        while not self.take("}"):
            inside.append(self.braces(element) if self.see() == "{" else self.convert(self.assignment(), element).node)
            if not self.take(","):
                self.need("}")
                break
        return self.node("INIT_LIST_EXPR", start, inside)

    def specifiers(self) -> tuple[list[Node], Type, list[Node]]:
        """(references to types, type, records declared in place)."""
        words: list[str] = []
        const = False
        while True:
            start = self.at
            t = self.see()
            if t in _QUALIFIERS:
                const |= t == "const"
                self.at += 1
            elif t in _BASIC:
                words.append(t)
                self.at += 1
            elif t in _RECORDS and not words:
                refs, base, records = self.record()
                return refs, replace(base, const=const), records
            elif t == "enum" and not words:
                refs, base, records = self.enumeration()
                return refs, replace(base, const=const), records
            elif words:
                break
            elif self.kind() == "identifier" or t == "::":
                refs, base = self.named()
                while self.see() in ("const", "volatile"):
                    const |= self.take("const")
                    self.take("volatile")
                return refs, replace(base, const=const or base.const), []
            else:
                raise _Unexpected("type")
            if start == self.at:
                raise _Unexpected("type")
        return [], Type(_basic(words), const=const), []

    def named(self) -> tuple[list[Node], Type]:
        """A type by its name, which may be qualified and have arguments."""
        refs: list[Node] = []
        self.take("::")
        while self.kind() == "identifier" and self.see(1) == "::":
            kind = "TYPE_REF" if self.see() in self.types else "NAMESPACE_REF"
            refs.append(Node(kind, self.see(), [], self.at, self.at + 1))
            self.at += 2
        start, spelling = self.at, self.name()
        if self.see() == "<":
            inside = self.attempt(self.template_arguments)
            if inside is not None:
                return [*refs, Node("TEMPLATE_REF", spelling, [], start, start + 1), *inside], Type(spelling)
        known = self.types.get(spelling) or Type(_ALIASES.get(spelling, spelling))
        return [*refs, Node("TYPE_REF", spelling, [], start, start + 1)], known

    def template_arguments(self) -> list[Node]:
        self.need("<")
        out: list[Node] = []
        while self.see() != ">":
            if self.kind() == "literal":
                out.append(self.primary().node)
            else:
                refs, base, _ = self.specifiers()
                self.pointers(base)
                out += refs
            if not self.take(","):
                break
        self.need(">")
        return out

    def record(self) -> tuple[list[Node], Type, list[Node]]:
        start, kind = self.at, _RECORDS[self.see()]
        self.at += 1
        spelling = self.name() if self.kind() == "identifier" else ""
        base = Type(spelling or "(unnamed)")
        if spelling:
            self.types[spelling] = base
        if self.see() not in ("{", ":", "final"):
            if self.see() == ";":
                return [], base, [self.node(kind, start, [], spelling)]
            return [Node("TYPE_REF", spelling, [], start, self.at)], base, []
        self.take("final")
        inside: list[Node] = []
        if self.take(":"):
            while True:
                begin = self.at
                self.take("virtual")
                self.take("public", "private", "protected")
                refs, _ = self.named()
                inside.append(self.node("CXX_BASE_SPECIFIER", begin, refs))
                if not self.take(","):
                    break
        self.need("{")
        self.scopes.append({})
        while self.at < len(self.tokens) and not self.take("}"):
            before = self.at
            inside += self.recovering(lambda: self.declaration(spelling), "UNEXPOSED_DECL")
            self.at += self.at == before
        self.scopes.pop()
        return [], base, [self.node(kind, start, inside, spelling)]

    def enumeration(self) -> tuple[list[Node], Type, list[Node]]:
        start = self.at
        self.at += 1
        self.take("class", "struct")
        spelling = self.name() if self.kind() == "identifier" else ""
        if spelling:
            self.types[spelling] = _INT
        if self.take(":"):
            self.specifiers()
        if self.see() != "{":
            return [Node("TYPE_REF", spelling, [], start, self.at)], _INT, []
        self.at += 1
        inside: list[Node] = []
        while not self.take("}"):
            begin, constant = self.at, self.name()
            self.scopes[-1][constant] = replace(_INT, const=True)
            inside.append(self.node("ENUM_CONSTANT_DECL", begin, [self.conditional().node] if self.take("=") else [], constant))
            if not self.take(","):
                self.need("}")
                break
        return [], _INT, [self.node("ENUM_DECL", start, inside, spelling)]

    def pointers(self, base: Type) -> Type:
        while True:
            if self.take("*"):
                base = replace(base, pointers=base.pointers + 1)
            elif not self.take("&", "&&", "const", "volatile"):
                return base

    def declarator(self, base: Type) -> tuple[str, Type, list[Node], list[Node]]:
        """(name, type, sizes of arrays, references to the class it belongs to)."""
        kind = self.pointers(base)
        owner: list[Node] = []
        while self.kind() == "identifier" and self.see(1) == "::":
            owner.append(Node("TYPE_REF", self.see(), [], self.at, self.at + 1))
            self.at += 2
        if self.take("operator"):
            spelling = "operator"
            while self.see() not in ("(", "") or spelling == "operator":
                spelling += self.see()
                self.at += 1
            if spelling == "operator(":
                self.need(")")
                spelling += ")"
        elif self.see() == "(" and self.see(1) == "*":
            self.at += 2
            spelling = self.name()
            self.need(")")
            self.need("(")
            more = self.parameters()
            return spelling, Type("void", 1), [n for n, _ in more], owner
        else:
            spelling = ("~" if self.take("~") else "") + self.name()
        sizes: list[Node] = []
        while self.take("["):
            if self.see() != "]":
                size = self.assignment()
                sizes.append((self.load(size) if not size.type.const else size).node)
            self.need("]")
            kind = replace(kind, arrays=kind.arrays + 1)
        return spelling, kind, sizes, owner

    def probe_parameters(self) -> bool:
        """Whether parameters of a function follow, not arguments."""
        start = self.at
        self.at += 1
        if not self.see() == ")":
            if self.kind() == "literal" or self.kind() == "identifier" and self.lookup(self.see()) is not None:
                raise _Unexpected("parameters")
            self.parameters()
        self.at = start
        return True

    def parameters(self) -> list[tuple[Node, Type]]:
        """Those behind an opening bracket, and the closing one."""
        out: list[tuple[Node, Type]] = []
        while not self.take(")"):
            start = self.at
            if self.take("..."):
                self.need(")")
                return out
            refs, base, _ = self.specifiers()
            if base == Type("void") and self.take(")"):
                return out
            kind = self.pointers(base)
            spelling, sizes = "", []
            if self.kind() == "identifier" or self.see() == "(" or self.see() == "[":
                if self.see() == "[":
                    self.at += 1
                    self.need("]")
                    kind = replace(kind, pointers=kind.pointers + 1)
                else:
                    spelling, kind, sizes, _ = self.declarator(kind)
            if kind.arrays:
                kind = replace(kind, arrays=kind.arrays - 1, pointers=kind.pointers + 1)
            children = refs + sizes + ([self.convert(self.assignment(), kind).node] if self.take("=") else [])
            out.append((self.node("PARM_DECL", start, children, spelling), kind))
            if not self.take(","):
                self.need(")")
                break
        return out

    def function(self, kind: str, spelling: str, refs: list[Node], result: Type, start: int) -> Node:
        self.need("(")
        parameters = self.parameters()
        if kind not in ("CONSTRUCTOR", "DESTRUCTOR"):
            self.functions[spelling] = (result, [t for _, t in parameters])
        while self.take("const", "noexcept", "override", "final"):
            pass
        children = refs + [n for n, _ in parameters]
        if self.take(":"):
            while True:
                begin, owner = self.at, self.name()
                children.append(self.node("MEMBER_REF", begin, [], owner))
                closing = {"(": ")", "{": "}"}.get(self.see())
                if closing is None:
                    raise _Unexpected("initializer")
                self.at += 1
                children += self.arguments(closing, [self.fields.get(owner, _UNKNOWN)])
                if not self.take(","):
                    break
        if self.take("="):
            self.at += 1
        if self.see() == "{":
            outer, self.result = self.result, result
            self.scopes.append({n.spelling: t for n, t in parameters})
            children.append(self.compound())
            self.scopes.pop()
            self.result = outer
        return self.node(kind, start, children, spelling)

    # Statements

    def compound(self) -> Node:
        start = self.at
        self.need("{")
        self.scopes.append({})
        inside: list[Node] = []
        while self.at < len(self.tokens) and not self.take("}"):
            before = self.at
            inside += self.recovering(lambda: [self.statement()], "UNEXPOSED_STMT")
            self.at += self.at == before
        self.scopes.pop()
        return self.node("COMPOUND_STMT", start, inside)

    def condition(self) -> Node:
        self.need("(")
        declared = self.attempt(lambda: self.local(")"))
        found = declared if declared is not None else self.truth(self.expression())
        self.need(")")
        return found

    def local(self, end: str) -> Node:
        """A single declaration in a condition."""
        start = self.at
        if not self.is_declaration():
            raise _Unexpected("declaration")
        refs, base, _ = self.specifiers()
        spelling, kind, sizes, _ = self.declarator(base)
        self.scopes[-1][spelling] = kind
        out = self.node("VAR_DECL", start, refs + sizes + self.initializer(kind), spelling)
        if self.see() != end:
            raise _Unexpected(end)
        return out

    def statement(self) -> Node:
        start, t = self.at, self.see()
        if t == "{":
            return self.compound()
        if self.take(";"):
            return self.node("NULL_STMT", start)
        rule = getattr(self, f"_{t}", None) if self.kind() == "keyword" else None
        if rule is not None:
            self.at += 1
            children = rule()
            return self.node("CXX_FOR_RANGE_STMT" if t == "for" and self.ranged else f"{'CXX_' if t == 'try' else ''}{t.upper()}_STMT", start, children)
        if self.kind() == "identifier" and self.see(1) == ":" and self.see(2) != ":":
            self.at += 2
            return self.node("LABEL_STMT", start, [self.statement()], t)
        if t == "using" or t == "typedef":
            return self.node("DECL_STMT", start, self.declaration())
        if self.is_declaration():
            found = self.attempt(lambda: self.variables("VAR_DECL", None, start))
            if found is not None:
                return self.node("DECL_STMT", start, found)
        value = self.expression()
        self.need(";")
        return value.node

    ranged = False

    def _if(self) -> list[Node]:
        self.take("constexpr")
        out = [self.condition(), self.statement()]
        return out + [self.statement()] if self.take("else") else out

    def _while(self) -> list[Node]:
        return [self.condition(), self.statement()]

    def _do(self) -> list[Node]:
        body = self.statement()
        self.need("while")
        out = [body, self.condition()]
        self.need(";")
        return out

    def _for(self) -> list[Node]:
        self.need("(")
        self.scopes.append({})
        found = self.attempt(self.over)
        if found is None:
            found = [] if self.take(";") else [self.statement()]
            if self.see() != ";":
                found.append(self.truth(self.expression()))
            self.need(";")
            if self.see() != ")":
                found.append(self.expression().node)
            ranged = False
        else:
            ranged = True
        self.need(")")
        found.append(self.statement())
        self.scopes.pop()
        self.ranged = ranged
        return found

    def over(self) -> list[Node]:
        """Variable and range of a loop over a range."""
        start = self.at
        refs, base, _ = self.specifiers()
        spelling, kind, _, _ = self.declarator(base)
        self.need(":")
        self.scopes[-1][spelling] = kind
        variable = self.node("VAR_DECL", start, refs, spelling)
        return [variable, self.expression().node]

    def _switch(self) -> list[Node]:
        self.need("(")
        value = self.promote(self.load(self.expression()))
        self.need(")")
        return [value.node, self.statement()]

    def _case(self) -> list[Node]:
        value = self.conditional()
        self.need(":")
        return [value.node] + ([] if self.see() == "}" else [self.statement()])

    def _default(self) -> list[Node]:
        self.need(":")
        return [] if self.see() == "}" else [self.statement()]

    def _return(self) -> list[Node]:
        if self.take(";"):
            return []
        out = [self.braces(self.result) if self.see() == "{" else self.convert(self.expression(), self.result).node]
        self.need(";")
        return out

    def _break(self) -> list[Node]:
        self.need(";")
        return []

    _continue = _break

    def _goto(self) -> list[Node]:
        self.name()
        self.need(";")
        return []

    def _try(self) -> list[Node]:
        out = [self.compound()]
        while self.see() == "catch":
            start = self.at
            self.at += 1
            self.need("(")
            self.scopes.append({})
            inside = []
            if not self.take("..."):
                begin = self.at
                refs, base, _ = self.specifiers()
                kind = self.pointers(base)
                spelling = self.name() if self.kind() == "identifier" else ""
                self.scopes[-1][spelling] = kind
                inside = [self.node("VAR_DECL", begin, refs, spelling)]
            self.need(")")
            inside.append(self.compound())
            self.scopes.pop()
            out.append(self.node("CXX_CATCH_STMT", start, inside))
        return out

    def is_declaration(self) -> bool:
        t = self.see()
        if t in _BASIC:
            return self.see(1) != "{" and (self.see(1) != "(" or self.see(2) == "*")
        if t in _QUALIFIERS or t in _RECORDS or t == "enum":
            return True
        if self.kind() != "identifier" and t != "::" or self.lookup(t) is not None and self.see(1) != "::":
            return False
        start, mark = self.at, len(self.split)
        try:
            refs, _ = self.named()
            known = t in self.types or any(r.kind == "TEMPLATE_REF" for r in refs)
            stars = 0
            while self.take("*", "&", "const"):
                stars += 1
            follows = self.see(1) if self.kind() == "identifier" else None
            return follows is not None and (not stars or known or follows in ("=", ";", "[", ",")) and follows != "::"
        except _Unexpected:
            return False
        finally:
            self.back(start, mark)

    # Expressions

    def lookup(self, spelling: str) -> Type | None:
        for scope in reversed(self.scopes):
            if spelling in scope:
                return scope[spelling]
        return replace(self.functions[spelling][0], function=True) if spelling in self.functions else None

    def wrap(self, value: _Value, kind: Type) -> _Value:
        n = value.node
        return _Value(Node("UNEXPOSED_EXPR", n.spelling, [n], n.first, n.last), kind)

    def load(self, value: _Value) -> _Value:
        """Of an array or function its address, of a place its value; objects stay."""
        t = value.type
        if t.arrays:
            return self.wrap(value, replace(t, arrays=t.arrays - 1, pointers=t.pointers + 1))
        if t.function:
            return self.wrap(value, replace(t, function=False, pointers=t.pointers + 1))
        return self.wrap(value, replace(t, const=t.const and bool(t.pointers))) if value.place and not t.record and t.base != _DEPENDENT else value

    def promote(self, value: _Value) -> _Value:
        return self.wrap(value, _INT) if value.type.arithmetic and _RANK[value.type.base] < _RANK["int"] else value

    def convert(self, value: _Value, target: Type) -> _Value:
        value = self.load(value)
        a = value.type
        if target.record:
            if not a.record and a.base != "?":
                return self.wrap(value, target)
            return _Value(self.node("CALL_EXPR", value.node.first, [value.node]), target) if value.place else value
        if target.arithmetic:
            differs = (a.arithmetic and a.base != target.base) or (a.pointers and target.base == "bool")
        elif target.pointers:
            differs = a.arithmetic or a.base == "nullptr" or (a.pointers and (a.base, a.pointers, a.const) != (target.base, target.pointers, target.const))
        else:
            differs = False
        return self.wrap(value, target) if differs else value

    def truth(self, value: _Value) -> Node:
        return self.convert(value, _BOOL).node

    def balance(self, a: _Value, b: _Value) -> tuple[_Value, _Value, Type]:
        """Both sides in their common type."""
        a, b = self.load(a), self.load(b)
        if a.type.arithmetic and b.type.arithmetic:
            common = Type(max(a.type.base, b.type.base, "int", key=_RANK.__getitem__))
            return self.convert(a, common), self.convert(b, common), common
        if a.type.pointers and b.type.arithmetic:
            return a, b, a.type
        return a, b, b.type if b.type.pointers or a.type.base == "?" else a.type

    def expression(self) -> _Value:
        left = self.assignment()
        while self.see() == "," and self.take(","):
            right = self.assignment()
            left = _Value(self.node("BINARY_OPERATOR", left.node.first, [left.node, right.node]), right.type, right.place)
        return left

    def assignment(self) -> _Value:
        start = self.at
        if self.take("throw"):
            return _Value(self.node("CXX_THROW_EXPR", start, [] if self.see() == ";" else [self.assignment().node]), Type("void"))
        left = self.conditional()
        operator = self.see()
        if operator not in _ASSIGNMENTS:
            return left
        self.at += 1
        t = left.type
        if self.see() == "{":
            right = _Value(self.braces(t), t)
        else:
            right = self.assignment()
        if t.record:
            return self.overloaded(start, left, right)
        if operator == "=":
            right, kind = self.convert(right, t), "BINARY_OPERATOR"
        else:
            kind = "COMPOUND_ASSIGNMENT_OPERATOR"
            if operator in ("<<=", ">>=") or not t.arithmetic:
                right = self.load(right)
            else:
                right = self.balance(_Value(left.node, t), right)[1]
        return _Value(self.node(kind, start, [left.node, right.node]), t, True)

    def overloaded(self, start: int, left: _Value, right: _Value) -> _Value:
        callee = Node("UNEXPOSED_EXPR", "", [Node("DECL_REF_EXPR")])
        return _Value(self.node("CALL_EXPR", start, [left.node, callee, self.load(right).node]), left.type)

    def conditional(self) -> _Value:
        start, test = self.at, self.binary(0)
        if not self.take("?"):
            return test
        yes = self.expression()
        self.need(":")
        no = self.assignment()
        if yes.place and no.place and yes.type == no.type:
            kind, place = yes.type, True
        else:
            yes, no, kind = self.balance(yes, no)
            place = False
        return _Value(self.node("CONDITIONAL_OPERATOR", start, [self.truth(test), yes.node, no.node]), kind, place)

    def binary(self, level: int) -> _Value:
        if level == len(_LEVELS):
            return self.unary()
        start, left = self.at, self.binary(level + 1)
        while self.see() in _LEVELS[level] and self.kind() == "punctuation":
            operator = self.see()
            self.at += 1
            right = self.binary(level + 1)
            left = self.combine(operator, start, left, right)
        return left

    def combine(self, operator: str, start: int, a: _Value, b: _Value) -> _Value:
        if operator in ("&&", "||"):
            return _Value(self.node("BINARY_OPERATOR", start, [self.truth(a), self.truth(b)]), _BOOL)
        if a.type.record or b.type.record:
            out = self.overloaded(start, a, b)
            return _Value(out.node, _BOOL) if operator in ("==", "!=", "<", ">", "<=", ">=") else out
        if operator in ("<<", ">>"):
            a, b = self.promote(self.load(a)), self.promote(self.load(b))
            kind = a.type
        else:
            literal = a.node.spelling == "0" or b.node.spelling == "0"
            a, b, kind = self.balance(a, b)
            if operator in ("==", "!=") and (literal or "nullptr" in (a.type.base, b.type.base)):
                a = self.convert(a, b.type) if b.type.pointers else a
                b = self.convert(b, a.type) if a.type.pointers else b
            if operator in ("==", "!=", "<", ">", "<=", ">="):
                kind = _BOOL
            elif operator == "-" and a.type.pointers and b.type.pointers:
                kind = Type("long")
        return _Value(self.node("BINARY_OPERATOR", start, [a.node, b.node]), kind)

    def unary(self) -> _Value:
        start, t = self.at, self.see()
        if self.kind() == "punctuation" and t in ("++", "--", "!", "~", "-", "+", "*", "&"):
            self.at += 1
            value = self.unary()
            if value.type.record and t != "&":
                callee = Node("UNEXPOSED_EXPR", "", [Node("DECL_REF_EXPR")])
                return _Value(self.node("CALL_EXPR", start, [callee, value.node]), _UNKNOWN if t == "*" else value.type, t == "*")
            if t in ("++", "--"):
                kind, place = value.type, True
            elif t == "!":
                value, kind, place = _Value(self.truth(value), _BOOL), _BOOL, False
            elif t == "&":
                kind, place = replace(value.type, pointers=value.type.pointers + 1, arrays=0, function=False), False
            elif t == "*":
                value = self.load(value)
                kind, place = value.type.pointee(), True
            else:
                value = self.promote(self.load(value))
                kind, place = value.type, False
            return _Value(self.node("UNARY_OPERATOR", start, [value.node]), kind, place)
        if t == "sizeof" or t == "alignof":
            self.at += 1
            refs = self.attempt(self.bracketed_type) if self.see() == "(" else None
            inside = refs[0] if refs is not None else [self.unary().node]
            return _Value(self.node("CXX_UNARY_EXPR", start, inside), Type("unsigned long"))
        if t == "new":
            return self.new()
        if t == "delete":
            self.at += 1
            if self.take("["):
                self.need("]")
            return _Value(self.node("CXX_DELETE_EXPR", start, [self.load(self.unary()).node]), Type("void"))
        if t == "(":
            found = self.attempt(self.cast)
            if found is not None:
                return found
        return self.postfix(self.primary(), start)

    def bracketed_type(self) -> tuple[list[Node], Type]:
        self.need("(")
        if self.kind() == "identifier" and (self.see() not in self.types and self.see() not in _ALIASES or self.lookup(self.see()) is not None):
            raise _Unexpected("type")
        refs, base, _ = self.specifiers()
        kind = self.pointers(base)
        self.need(")")
        return refs, kind

    def cast(self) -> _Value:
        start = self.at
        refs, kind = self.bracketed_type()
        if self.kind() == "punctuation" and self.see() not in ("(", "*", "&", "-", "+", "!", "~", "++", "--"):
            raise _Unexpected("operand")
        value = self.load(self.unary())
        return _Value(self.node("CSTYLE_CAST_EXPR", start, [*refs, value.node]), kind)

    def new(self) -> _Value:
        start = self.at
        self.at += 1
        refs, base, _ = self.specifiers()
        kind = self.pointers(base)
        inside = list(refs)
        if self.take("["):
            inside.append(self.convert(self.expression(), Type("unsigned long")).node)
            self.need("]")
        elif kind.record or self.see() in ("(", "{"):
            begin = self.at
            closing = {"(": ")", "{": "}"}.get(self.see())
            self.at += closing is not None
            found = self.arguments(closing, [kind]) if closing else []
            inside += [self.node("CALL_EXPR", begin, found, kind.base)] if kind.record else found
        return _Value(self.node("CXX_NEW_EXPR", start, inside), replace(kind, pointers=kind.pointers + 1))

    def arguments(self, closing: str, targets: list[Type]) -> list[Node]:
        out: list[Node] = []
        while not self.take(closing):
            target = targets[len(out)] if len(out) < len(targets) else None
            if self.see() == "{":
                out.append(self.braces(target or _UNKNOWN))
            else:
                value = self.assignment()
                out.append((self.convert(value, target) if target else self.load(value)).node)
            if not self.take(","):
                self.need(closing)
                break
        return out

    def primary(self) -> _Value:
        start, t, kind = self.at, self.see(), self.kind()
        if kind == "literal":
            return self.literal()
        if t == "(":
            self.at += 1
            value = self.expression()
            self.need(")")
            return _Value(self.node("PAREN_EXPR", start, [value.node]), value.type, value.place)
        if t == "[":
            return self.closure()
        if t in ("true", "false"):
            self.at += 1
            return _Value(self.node("CXX_BOOL_LITERAL_EXPR", start), _BOOL)
        if t == "nullptr":
            self.at += 1
            return _Value(self.node("CXX_NULL_PTR_LITERAL_EXPR", start), Type("nullptr"))
        if t == "this":
            self.at += 1
            return _Value(self.node("CXX_THIS_EXPR", start), Type("this", 1))
        if t in _CASTS:
            self.at += 1
            self.need("<")
            refs, base, _ = self.specifiers()
            to = self.pointers(base)
            self.need(">")
            self.need("(")
            value = self.load(self.expression())
            self.need(")")
            return _Value(self.node(_CASTS[t], start, [*refs, value.node]), to)
        if t in _BASIC and self.see(1) in ("(", "{"):
            self.at += 2
            inside = self.arguments(")" if self.see(-1) == "(" else "}", [])
            return _Value(self.node("CXX_FUNCTIONAL_CAST_EXPR", start, inside), Type(t))
        if kind == "identifier" or t == "::":
            refs: list[Node] = []
            self.take("::")
            while self.kind() == "identifier" and self.see(1) == "::":
                refs.append(Node("TYPE_REF" if self.see() in self.types else "NAMESPACE_REF", self.see(), [], self.at, self.at + 1))
                self.at += 2
            spelling = self.name()
            found = self.lookup(spelling)
            if self.see() in ("(", "{") and found is None and spelling in self.types and self.types[spelling].record:
                self.at += 1
                inside = self.arguments(")" if self.see(-1) == "(" else "}", [])
                return _Value(self.node("CALL_EXPR", start, [Node("TYPE_REF", spelling), *inside], spelling), self.types[spelling])
            if found is None and self.see() == "<" and refs:
                refs += self.attempt(self.template_arguments) or []
            if found is None:
                found = Type("stream") if spelling in _STREAMS else Type("?", function=True) if self.see() == "(" else _UNKNOWN
            return _Value(self.node("DECL_REF_EXPR", start, refs, spelling), found, not found.function)
        raise _Unexpected("expression")

    def literal(self) -> _Value:
        start, t = self.at, self.see()
        self.at += 1
        if t.endswith('"'):
            while self.kind() == "literal" and self.see().endswith('"'):
                self.at += 1
            return _Value(self.node("STRING_LITERAL", start, [], t), Type("char", arrays=1, const=True))
        if t.endswith("'"):
            return _Value(self.node("CHARACTER_LITERAL", start, [], t), Type("char"))
        low = t.lower()
        if not low.startswith("0x") and ("." in low or "e" in low) or "p" in low:
            base = "float" if low.endswith("f") else "long double" if low.endswith("l") else "double"
            return _Value(self.node("FLOATING_LITERAL", start, [], t), Type(base))
        suffix = low[len(low.rstrip("ul")):]
        base = ("unsigned " if "u" in suffix else "") + {0: "int", 1: "long"}.get(suffix.count("l"), "long long")
        return _Value(self.node("INTEGER_LITERAL", start, [], t), Type(base))

    def closure(self) -> _Value:
        start, depth = self.at, 0
        while self.at < len(self.tokens):
            depth += (self.see() == "[") - (self.see() == "]")
            self.at += 1
            if not depth:
                break
        self.scopes.append({})
        inside: list[Node] = []
        if self.take("("):
            found = self.parameters()
            self.scopes[-1].update((n.spelling, t) for n, t in found)
            inside = [n for n, _ in found]
        self.take("mutable")
        if self.take("->"):
            self.pointers(self.specifiers()[1])
        outer, self.result = self.result, _UNKNOWN
        inside.append(self.compound())
        self.result = outer
        self.scopes.pop()
        return _Value(self.node("LAMBDA_EXPR", start, inside), Type("lambda"))

    def postfix(self, value: _Value, start: int) -> _Value:
        while True:
            t = self.see()
            if self.kind() != "punctuation":
                return value
            if t == "(":
                self.at += 1
                result, targets = _UNKNOWN, []
                if value.node.kind == "MEMBER_REF_EXPR":
                    result, targets = self.functions.get(value.node.spelling, (_UNKNOWN, []))
                    callee = value
                else:
                    if value.type.function:
                        result, targets = self.functions.get(value.node.spelling, (_UNKNOWN, []))
                    callee = self.load(value)
                spelling = value.node.spelling
                value = _Value(self.node("CALL_EXPR", start, [callee.node, *self.arguments(")", targets)], spelling), result)
            elif t == "[":
                self.at += 1
                index = self.expression()
                self.need("]")
                if value.type.record:
                    made = self.overloaded(start, value, index)
                    value = _Value(made.node, _UNKNOWN, True)
                else:
                    base = self.load(value)
                    value = _Value(self.node("ARRAY_SUBSCRIPT_EXPR", start, [base.node, self.load(index).node]), base.type.pointee(), True)
            elif t in (".", "->"):
                self.at += 1
                self.take("template")
                spelling = ("~" if self.take("~") else "") + self.name()
                base = self.load(value) if t == "->" else value
                kind = self.fields.get(spelling, _UNKNOWN)
                value = _Value(self.node("MEMBER_REF_EXPR", start, [base.node], spelling), kind, True)
            elif t in ("++", "--"):
                self.at += 1
                value = _Value(self.node("UNARY_OPERATOR", start, [value.node]), value.type)
            else:
                return value


def _basic(words: list[str]) -> str:
    """The name by which a built-in type is ranked."""
    for plain in ("void", "bool", "float", "auto"):
        if plain in words:
            return "?" if plain == "auto" else plain
    longs = words.count("long")
    if "double" in words:
        return "long double" if longs else "double"
    size = "char" if "char" in words else "short" if "short" in words else {0: "int", 1: "long"}.get(longs, "long long")
    if "wchar_t" in words or "char16_t" in words or "char32_t" in words:
        size = "int"
    return ("unsigned " if "unsigned" in words else "") + size
