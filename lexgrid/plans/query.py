"""The query language: text to tokens to a tree.

Operators bind as &, |, \\ and ! by strength, while > (next) and {n} (near) wait
for all that follows them, which makes chains lean to the right.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Nothing:
    def __str__(self) -> str:
        return "False"


@dataclass(frozen=True)
class Term:
    word: str

    def __str__(self) -> str:
        return self.word


@dataclass(frozen=True)
class Not:
    of: "Node"

    def __str__(self) -> str:
        return f"!({self.of})"


@dataclass(frozen=True)
class Pair:
    """op is one of & | \\ or near; near allows `before` words before and `after` words after the left position."""

    op: str
    left: "Node"
    right: "Node"
    before: int = 0
    after: int = 0

    def __str__(self) -> str:
        sign = (">" if (self.before, self.after) == (0, 1) else f"near{self.after}") if self.op == "near" else self.op
        return f"{sign}({self.left}, {self.right})"


Node = Nothing | Term | Not | Pair
_SCAN = regex.compile(r"(?P<term>\p{Alphabetic}[\p{Alphabetic}']*)|(?P<number>[0-9]+)|(?P<sign>[&|!()\\>{}\"])|(?P<space>\s+)|(?P<bad>.)", regex.S)
#: Strength of each operator that takes finished operands off the stack.
STRENGTH = {"!": 4, "\\": 3, "&": 2, "|": 1}
_WAITING = 50


def lex(text: str, signs: str = "&|!()\\>{}\"", raw: bool = False) -> list[tuple[str, str]]:
    """(kind, text) tokens.  raw: as without the line end that a prompt adds, where a last word is cut off."""
    out = []
    for m in _SCAN.finditer(text):
        kind = m.lastgroup
        if kind == "bad" or kind == "sign" and m.group() not in signs or kind == "number" and "{" not in signs or raw and kind == "term" and m.end() == len(text):
            raise QueryError(f"Encountered invalid character {m.group()[0]!r}")
        if kind != "space":
            out.append((kind, "".join(c.lower() for c in m.group())))
    return out


class _Stacks:
    def __init__(self) -> None:
        self.values: list[Node] = []
        self.waiting: list[tuple] = []

    def apply(self) -> None:
        sign, *how = self.waiting.pop()
        need = 1 if sign == "!" else 2
        if sign == "(":
            raise QueryError("Unexpected operator")
        if len(self.values) < need:
            raise QueryError("Missing argument")
        got = [self.values.pop() for _ in range(need)][::-1]
        self.values.append(Not(*got) if sign == "!" else Pair(sign, *got, *how))

    def operator(self, sign: str) -> None:
        while self.waiting and self.waiting[-1][0] != "(" and STRENGTH.get(self.waiting[-1][0], _WAITING) >= STRENGTH[sign]:
            self.apply()
        self.waiting.append((sign,))

    def close(self) -> None:
        while self.waiting and self.waiting[-1][0] != "(":
            self.apply()
        if self.waiting:
            self.waiting.pop()


def parse(text: str, dialect: str = "full", raw: bool = False) -> Node:
    """dialect boolean: only & | ! ( ), and of several expressions the last one counts."""
    tokens = lex(text, "&|!()" if dialect == "boolean" else "&|!()\\>{}\"", raw)
    stacks, i = _Stacks(), 0

    def take(kind: str, value: str | None, message: str) -> str:
        nonlocal i
        if i >= len(tokens) or tokens[i][0] != kind or value is not None and tokens[i][1] != value:
            raise QueryError(message)
        i += 1
        return tokens[i - 1][1]

    while i < len(tokens):
        kind, value = tokens[i]
        i += 1
        if kind == "term":
            stacks.values.append(Term(value))
        elif value in STRENGTH:
            stacks.operator(value)
        elif value == "(":
            stacks.waiting.append(("(",))
        elif value == ")":
            stacks.close()
        elif value == ">":
            stacks.waiting.append(("near", 0, 1))
        elif value == "{":
            n = int(take("number", None, "Expected number"))
            take("sign", "}", "Expected closing bracket")
            stacks.waiting.append(("near", n, n))
        elif value == '"':
            words = []
            while i < len(tokens) and tokens[i] != ("sign", '"'):
                words.append(take("term", None, "Unexpected token in phrase"))
            take("sign", '"', "Unclosed phrase")
            stacks.values += [Term(w) for w in words]  # an empty phrase is no operand
            stacks.waiting += [("near", 0, 1)] * (len(words) - 1)
        else:
            raise QueryError(f"Unexpected token {value!r}")
    while stacks.waiting:
        stacks.apply()
    if len(stacks.values) > 1 and dialect != "boolean":
        raise QueryError("Expected single expression")
    return stacks.values[-1] if stacks.values else Nothing()


def words(node: Node) -> list[str]:
    """The distinct terms of a tree, in order."""
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Not):
        return words(node.of)
    if isinstance(node, Pair):
        return list(dict.fromkeys(words(node.left) + words(node.right)))
    return []


def holds_when_absent(node: Node) -> bool:
    """Whether a document with none of the terms matches: only then is the universe of documents needed."""
    if isinstance(node, Not):
        return not holds_when_absent(node.of)
    if isinstance(node, Pair) and node.op != "near":
        a, b = holds_when_absent(node.left), holds_when_absent(node.right)
        return {"&": a and b, "|": a or b, "\\": a and not b}[node.op]
    return False
