"""The query language: free terms, quoted phrases, AND / OR / NOT and brackets.

A query is lexed and parsed on the driver; the tree is a plan for ``rank``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import unquote

#: Fixed value: the language's pattern: a run of quotes up to the same run, an operator or bracket, or a term.
_COMPATIBLE = re.compile(r'("{1,})(.*?)\1|(AND|OR|NOT|\(|\))|([^\s"]+)', re.I | re.A | re.S)
_INTENDED = re.compile(r'("{1,})(.*?)\1|((?:AND|OR|NOT)(?![^\s"()])|\(|\))|([^\s"()]+)', re.I | re.A | re.S)
#: Precedence, tightest first; brackets and the end come after all operators.
RANK = {"not": 0, "and": 1, "or": 2, "(": 3, ")": 4, "end": 5}


class QuerySyntaxError(ValueError):
    """An operator without its operands, or an empty query."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Term | Phrase | Not | And | Or


@dataclass(frozen=True)
class Modes:
    """Each ``compatible`` (what existing clients see) or ``intended``."""

    term: str = "compatible"
    phrase: str = "compatible"
    boolean: str = "compatible"
    order: str = "intended"
    lexer: str = "compatible"
    snippet: str = "compatible"

    @classmethod
    def intended(cls) -> Modes:
        return cls(*["intended"] * 6)


@dataclass(frozen=True)
class Query:
    """What is left after all operators: trees over phrases, and free terms."""

    phrases: tuple[Node, ...]
    terms: tuple[Term, ...]
    weights: dict[str, int] = field(default_factory=dict, compare=False)

    def leaves(self) -> list[Term | Phrase]:
        found: dict[Term | Phrase, None] = {}

        def walk(n: Node) -> None:
            match n:
                case Not(of):
                    walk(of)
                case And(a, b) | Or(a, b):
                    walk(a)
                    walk(b)
                case _:
                    found[n] = None

        for n in (*self.terms, *self.phrases):
            walk(n)
        return list(found)


def lex(text: str, mode: str = "compatible") -> list[Token]:
    """Tokens in order; ``compatible`` takes operators also as beginnings of words."""
    out = []
    for m in (_COMPATIBLE if mode == "compatible" else _INTENDED).finditer(text):
        if m[1]:
            out.append(Token("phrase", m[2]))
        elif m[3]:
            out.append(Token("operator", m[3].lower()))
        else:
            out.append(Token("term", m[4]))
    return out


def weights_of(tokens: list[Token], penalty: int = 5) -> dict[str, int]:
    """Snippet weights: 1, or minus the penalty for what stands after NOT (a whole bracket there)."""
    out: dict[str, int] = {}
    negated, depth = False, 0
    for t in tokens:
        if t.kind == "operator":
            if t.text == "not" and not depth:
                negated = True
            elif negated and t.text == "(":
                depth += 1
            elif depth and t.text == ")":
                depth -= 1
                negated = depth > 0
            continue
        out[unquote(t.text) if t.kind == "phrase" else t.text] = -penalty if negated else 1
        if not depth:
            negated = False
    return out


def parse(text: str, modes: Modes = Modes()) -> Query:
    """Operator precedence parsing with explicit operand stacks.

    An operator takes the most recent operands.  Operands that no operator
    takes stay side by side and are combined when ranked.  Unclosed brackets
    end at the end of the query, where operators left of them stay unused.
    """
    tokens = lex(text, modes.lexer)
    if not any(t.kind != "operator" for t in tokens):
        raise QuerySyntaxError("the query has nothing to look for")
    operands: list[Node] = []
    terms: list[Term] = []
    pending: list[str] = []

    def apply(op: str) -> None:
        need = 1 if op == "not" else 2
        if len(operands) < need:
            raise QuerySyntaxError(f"{op.upper()} lacks an operand")
        taken = [operands.pop() for _ in range(need)]
        operands.append(Not(taken[0]) if op == "not" else (And if op == "and" else Or)(*taken))

    def settle(op: str) -> None:
        """Apply what binds at least as tightly as ``op``, up to a bracket."""
        while pending and op != "(" and RANK[pending[-1]] <= RANK[op]:
            last = pending.pop()
            if last in "()":
                return
            apply(last)

    for t in tokens:
        if t.kind == "phrase":
            operands.append(Phrase(unquote(t.text)))
        elif t.kind == "term":
            if modes.boolean == "compatible":
                terms.append(Term(t.text))
            else:
                operands.append(Term(t.text))
        else:
            barrier = t.text == ")" and not pending
            settle(t.text)
            if t.text != ")" or barrier:
                pending.append(t.text)
    settle("end")
    if modes.boolean != "compatible" and all(isinstance(x, Term) for x in operands):
        terms, operands = operands, []
    return Query(tuple(operands), tuple(terms), weights_of(tokens))
