"""The syntax tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Span:
    """A place in a source text, for diagnostics."""

    source: str = ""
    start: int = 0
    stop: int = 0


NOWHERE = Span()


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A literal: int, float or str."""

    value: int | float | str


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Chain:
    """first op term op term ..., evaluated from left to right without precedence."""

    first: Expr
    rest: tuple[tuple[str, Expr], ...]


Expr = Var | Const | Call | Chain
Arg = Var | Const | Wildcard


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Arg, ...]
    negated: bool = False
    span: Span = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Comparison:
    left: Expr
    op: str
    right: Expr
    span: Span = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Aggregate:
    op: str
    arg: Expr


@dataclass(frozen=True)
class Rule:
    head: str
    args: tuple[Expr | Aggregate, ...]
    body: tuple[Atom | Comparison, ...]
    hint: str = ""
    span: Span = field(default=NOWHERE, compare=False)

    @property
    def aggregate(self) -> Aggregate | None:
        return self.args[-1] if self.args and isinstance(self.args[-1], Aggregate) else None

    @property
    def atoms(self) -> tuple[Atom, ...]:
        return tuple(p for p in self.body if isinstance(p, Atom))

    @property
    def positive(self) -> tuple[Atom, ...]:
        return tuple(p for p in self.atoms if not p.negated)

    @property
    def negative(self) -> tuple[Atom, ...]:
        return tuple(p for p in self.atoms if p.negated)

    @property
    def comparisons(self) -> tuple[Comparison, ...]:
        return tuple(p for p in self.body if isinstance(p, Comparison))


@dataclass(frozen=True)
class Decl:
    name: str
    columns: tuple[tuple[str, str], ...]
    section: str = "in"  # in, printsize or out
    path: str | None = None
    order_by: tuple[tuple[str, bool], ...] = ()  # column, descending
    limit: int | None = None
    merge: str | None = None
    span: Span = field(default=NOWHERE, compare=False)

    @property
    def types(self) -> tuple[str, ...]:
        return tuple(t for _, t in self.columns)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.columns)


@dataclass(frozen=True)
class SourceBinding:
    provider: str
    relation: str | None
    config: dict[str, str] = field(hash=False, default_factory=dict)
    span: Span = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Program:
    decls: dict[str, Decl]
    rules: tuple[Rule, ...]
    sources: tuple[SourceBinding, ...] = ()
    requires: tuple[tuple[str, Span], ...] = ()
    texts: dict[str, str] = field(default_factory=dict)  # path -> source text

    @property
    def inputs(self) -> dict[str, Decl]:
        return {n: d for n, d in self.decls.items() if d.section == "in"}

    @property
    def derived(self) -> dict[str, Decl]:
        return {n: d for n, d in self.decls.items() if d.section != "in"}

    @property
    def heads(self) -> list[str]:
        return list(dict.fromkeys(r.head for r in self.rules))


def variables(node) -> Iterator[str]:
    """The names of the variables below a node, from left to right."""
    match node:
        case Var(name):
            yield name
        case Call(_, args) | Atom(_, args):
            for a in args:
                yield from variables(a)
        case Chain(first, rest):
            yield from variables(first)
            for _, e in rest:
                yield from variables(e)
        case Comparison(left, _, right):
            yield from variables(left)
            yield from variables(right)
        case Aggregate(_, arg):
            yield from variables(arg)
