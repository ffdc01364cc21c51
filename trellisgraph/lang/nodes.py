"""Syntax trees.

Expressions are tuples whose first item names the kind, so equal expressions are equal keys:
``("lit", type, value)``, ``("var", name)``, ``("param", name)``, ``("prop", x, name)``, ``("bin", op, a, b)``,
``("un", op, x)``, ``("is", what, negated, x)``, ``("labeled", negated, x, labels)``, ``("list", items)``,
``("record", ((name, x), ...))``, ``("call", NAME, distinct, args)``, ``("star",)`` (in COUNT), ``("case", ...)``,
``("cast", x, type)``, ``("has", x, name)``, ``("other", what)`` for what is parsed only.

Label expressions: ``("label", name)``, ``("any",)``, ``("not", x)``, ``("and", a, b)``, ``("or", a, b)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class NodePattern:
    var: str | None = None
    labels: tuple | None = None
    properties: tuple = ()
    where: tuple | None = None


@dataclass
class Quantifier:
    low: int
    high: int | None  # None: unbounded
    questioned: bool = False


@dataclass
class EdgePattern:
    directions: frozenset  # of R, L, U
    var: str | None = None
    labels: tuple | None = None
    properties: tuple = ()
    where: tuple | None = None
    quantifier: Quantifier | None = None


@dataclass
class Group:
    path: object  # Alternatives or list of factors
    var: str | None = None
    mode: str | None = None
    where: tuple | None = None
    quantifier: Quantifier | None = None
    has_search: bool = False


@dataclass
class Alternatives:
    branches: list
    bag: bool = False


@dataclass
class PathPattern:
    path: object
    var: str | None = None
    mode: str | None = None
    #: all; any k; shortest k; groups k
    selector: tuple = ("all",)


@dataclass
class Match:
    patterns: list
    mode: str | None = None  # different, repeatable
    where: tuple | None = None
    optional: bool = False
    keep: bool = False
    yields: list | None = None


@dataclass
class OptionalBlock:
    matches: list


@dataclass
class Clause:
    """let, filter, for, page, use, table, nested, insert, set, remove, delete, call."""

    kind: str
    items: object = None
    extra: object = None


@dataclass
class SortItem:
    expr: tuple
    descending: bool = False
    nulls_first: bool | None = None


@dataclass
class Page:
    order: list = field(default_factory=list)
    offset: tuple | None = None
    limit: tuple | None = None

    def __bool__(self) -> bool:
        return bool(self.order) or self.offset is not None or self.limit is not None


@dataclass
class Result:
    """RETURN or the tail of SELECT. items None: every column; finish: no rows."""

    items: list | None = None
    distinct: bool = False
    group: list | None = None  # None: not written; []: one group
    having: tuple | None = None
    page: Page = field(default_factory=Page)
    finish: bool = False


@dataclass
class Linear:
    clauses: list
    result: Result | None
    graph: tuple | None = None
    schema: tuple | None = None


@dataclass
class Composite:
    left: object
    op: str  # union, intersect, except, otherwise
    all: bool
    right: object


@dataclass
class Query:
    """Steps joined by NEXT; each has (query, yield items or None)."""

    steps: list


@dataclass
class Command:
    """Catalog, session and transaction commands."""

    kind: str
    args: dict


def walk(tree):
    """Every dataclass and tuple in a tree, itself included."""
    yield tree
    if isinstance(tree, (list, tuple)):
        for x in tree:
            if isinstance(x, (list, tuple)) or hasattr(x, "__dataclass_fields__"):
                yield from walk(x)
    elif hasattr(tree, "__dataclass_fields__"):
        for f in tree.__dataclass_fields__:
            x = getattr(tree, f)
            if isinstance(x, (list, tuple)) or hasattr(x, "__dataclass_fields__"):
                yield from walk(x)


def show(tree, indent: int = 0) -> str:
    """A readable dump of a syntax tree."""
    pad = "  " * indent
    if isinstance(tree, list):
        return "".join(show(x, indent) for x in tree)
    if hasattr(tree, "__dataclass_fields__"):
        out = f"{pad}{type(tree).__name__}\n"
        for f in tree.__dataclass_fields__:
            value = getattr(tree, f)
            if isinstance(value, list) or hasattr(value, "__dataclass_fields__"):
                out += f"{pad}  {f}:\n{show(value, indent + 2)}"
            elif value not in (None, (), False):
                out += f"{pad}  {f}: {value!r}\n"
        return out
    return f"{pad}{tree!r}\n"
