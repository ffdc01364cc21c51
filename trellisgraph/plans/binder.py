"""Expressions in a scope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery, UnsupportedFeature
from ..functions import scalar
from ..functions.scalar import E, as_bool, family, literal, type_name
from ..lang.nodes import walk
from ..lang.parser import AGGREGATES
from .scope import Element, PathValue, Scalar, Table, elements_of, live


@dataclass
class Context:
    """What expressions may read beside the scope."""

    session: object
    #: Values of whole expressions, by their folded syntax: results of aggregates and grouping keys.
    known: dict = field(default_factory=dict)
    grouped: bool = False


def folded(ast):
    """Equal for expressions that differ only in the case of names."""
    if isinstance(ast, tuple):
        if ast and ast[0] == "var":
            return ("var", ast[1].lower())
        if ast and ast[0] in ("prop", "has"):
            return (ast[0], folded(ast[1]), ast[2].lower())
        return tuple(folded(a) for a in ast)
    return ast


def has_aggregate(ast) -> bool:
    return any(isinstance(x, tuple) and x and x[0] == "call" and x[1] in AGGREGATES for x in walk(ast))


def names_in(tree) -> set[str]:
    """Folded names of the variables that a tree mentions."""
    out = set()
    for x in walk(tree):
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "var" and isinstance(x[1], str):
            out.add(x[1].lower())
        elif hasattr(x, "var") and x.var:
            out.add(x.var.lower())
    return out


def properties_in(tree) -> set[str]:
    out = set()
    for x in walk(tree):
        if isinstance(x, tuple) and len(x) == 3 and x[0] in ("prop", "has") and isinstance(x[2], str):
            out.add(x[2].lower())
        elif hasattr(x, "properties"):
            out.update(p[0].lower() for p in x.properties)
    return out


def label_matches(labels, expr) -> bool:
    if expr is None:
        return True
    kind = expr[0]
    if kind == "label":
        return expr[1] in labels
    if kind == "any":
        return bool(labels)
    if kind == "not":
        return not label_matches(labels, expr[1])
    if kind == "and":
        return label_matches(labels, expr[1]) and label_matches(labels, expr[2])
    return label_matches(labels, expr[1]) or label_matches(labels, expr[2])


def labeled(element: Element, expr) -> Column:
    fits = [i for i, f in enumerate(element.graph.data.fragments(element.kind)) if label_matches(f.labels, expr)]
    return live(element, F.when(F.col(element.id).isNotNull(), F.col(element.fragment).isin(fits) if fits else F.lit(False)))


def property_of(element: Element, name: str) -> E:
    hit = element.properties.get(name.lower())
    if hit is None:
        return E(live(element, F.lit(None)), "null")
    _, column, kind, variants = hit
    if variants:
        return E(live(element, F.col(column)), kind, variants=[E(live(element, F.col(c)), t) for t, c in variants.items()])
    return E(live(element, F.col(column)), kind)


def boolean(ast, table: Table, context: Context, what: str = "condition") -> Column:
    return as_bool(bind(ast, table, context), what)


def element_in(ast, table: Table, what: str, kind: str | None = None) -> Element:
    found = table.find(ast[1]) if ast[0] == "var" else None
    if not isinstance(found, Element):
        raise InvalidQuery(f"{what} needs an element")
    if kind and found.kind != kind:
        raise InvalidQuery(f"{what} needs {'an edge' if kind == 'edge' else 'a node'}")
    return found


def bind(ast, table: Table, context: Context) -> E:
    """A typed column for an expression."""
    if context.known and (hit := context.known.get(folded(ast))) is not None:
        return hit
    return getattr(_Binder(table, context), f"x_{ast[0]}")(*ast[1:])


class _Binder:
    def __init__(self, table: Table, context: Context):
        self.table = table
        self.context = context

    def bind(self, ast) -> E:
        return bind(ast, self.table, self.context)

    def x_lit(self, kind, value) -> E:
        return literal(kind, value)

    def x_param(self, name) -> E:
        return self.context.session.parameter(name)

    def x_var(self, name) -> E:
        found = self.table.find(name)
        if found is None:
            raise InvalidQuery(f"unknown variable {name}")
        if self.context.grouped:
            raise InvalidQuery(f"{name}: expression is not grouped or aggregated")
        if isinstance(found, Element):
            return E(F.col(found.id), ("ref", found.kind), binding=found)
        if isinstance(found, PathValue):
            return E(F.col(found.nodes), "path", binding=found)
        if found.variants:
            return E(F.col(found.column), found.type, variants=[E(F.col(c), t) for t, c in found.variants.items()])
        return E(F.col(found.column), found.type, binding=found if found.graph else None)

    def x_prop(self, x, name) -> E:
        value = self.bind(x)
        if isinstance(value.binding, Element):
            return property_of(value.binding, name)
        if value.type == "null":
            return E(F.lit(None), "null")
        raise InvalidQuery(f"{type_name(value.type)} has no properties")

    def x_has(self, x, name) -> E:
        value = self.bind(x)
        if not isinstance(value.binding, Element):
            raise InvalidQuery("PROPERTY_EXISTS needs an element")
        hit = value.binding.properties.get(name.lower())
        present = F.col(hit[1]).isNotNull() if hit else F.lit(False)
        return E(live(value.binding, F.when(value.col.isNotNull(), present)), "bool")

    def x_labeled(self, negated, x, expr) -> E:
        element = self.bind(x).binding
        if not isinstance(element, Element):
            raise InvalidQuery("IS LABELED needs an element")
        holds = labeled(element, expr)
        return E(~holds if negated else holds, "bool")

    def x_endpoint(self, what, negated, node, edge) -> E:
        raise UnsupportedFeature(f"IS {what} OF")

    def x_other(self, what) -> E:
        raise UnsupportedFeature(what)

    def x_star(self) -> E:
        raise InvalidQuery("* is only for COUNT")

    def x_record(self, items=()) -> E:
        raise UnsupportedFeature("record values")

    def x_cast(self, x, kind) -> E:
        raise UnsupportedFeature("CAST")

    def x_case(self, operand, arms, other) -> E:
        raise UnsupportedFeature("CASE")

    def x_list(self, items) -> E:
        values = [self.bind(i) for i in items]
        out = scalar.list_of(values)
        graphs = [v.binding for v in values if isinstance(v.binding, Element)]
        if graphs:
            out.binding = Scalar("", out.type, graphs[0].graph)
        return out

    def x_is(self, what, negated, x) -> E:
        value = self.bind(x)
        if what == "NULL":
            return E(value.col.isNotNull() if negated else value.col.isNull(), "bool")
        if what == "DIRECTED":
            element = value.binding
            if not isinstance(element, Element) or element.kind != "edge":
                raise InvalidQuery("IS DIRECTED needs an edge")
            ways = [i for i, f in enumerate(element.graph.data.edges) if f.directed]
            holds = F.when(value.col.isNotNull(), F.col(element.fragment).isin(ways) if ways else F.lit(False))
            return E(~holds if negated else holds, "bool")
        truth = as_bool(value, f"IS {what}")
        holds = truth.isNull() if what == "UNKNOWN" else truth.eqNullSafe(F.lit(what == "TRUE"))
        return E(~holds if negated else holds, "bool")

    def x_un(self, op, x) -> E:
        value = self.bind(x)
        if op == "NOT":
            return E(~as_bool(value, "NOT"), "bool")
        return scalar.negate(value) if op == "-" else scalar.over_variants([value], lambda v: v, lambda v: v.type in ("int", "float", "null"), "+")

    def x_bin(self, op, a, b) -> E:
        if op in ("AND", "OR", "XOR"):
            return scalar.logical(op, self.bind(a), self.bind(b))
        x, y = self.bind(a), self.bind(b)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if op in ("=", "<>") and isinstance(x.binding, Element) and isinstance(y.binding, Element):
                return self.identical([x, y], op == "=")
            return scalar.compare(op, x, y)
        if op == "||":
            return scalar.concatenate(x, y)
        return scalar.arithmetic(op, x, y)

    def identical(self, values, same: bool) -> E:
        a, b = values
        if a.type != b.type or a.binding.graph.id != b.binding.graph.id:
            return E(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(not same)), "bool")
        return E(a.col == b.col if same else a.col != b.col, "bool")

    def x_call(self, name, distinct, args) -> E:
        if name in AGGREGATES:
            raise InvalidQuery(f"{name} has no place here")
        handler = getattr(self, f"f_{name.lower()}", None)
        if handler is None:
            raise UnsupportedFeature(name)
        return handler(*[self.bind(a) for a in args])

    def f_coalesce(self, *args) -> E:
        flat = [x for a in args for x in (a.variants or [a])]
        return scalar.coalesce(flat) if len({family(x.type) for x in flat} - {"null"}) < 2 else scalar.coalesce(list(args))

    def f_nullif(self, *args) -> E:
        if len(args) != 2:
            raise InvalidQuery("NULLIF takes two arguments")
        return scalar.nullif(*args)

    def f_path_length(self, *args) -> E:
        return E(F.when(F.col(self.path(args).edges).isNotNull(), F.size(self.path(args).edges).cast("bigint")), "int")

    def f_elements(self, *args) -> E:
        path = self.path(args)
        return E(elements_of(path.graph, path), ("list", ("ref", "element")), binding=None)

    def path(self, args) -> PathValue:
        if len(args) != 1 or not isinstance(args[0].binding, PathValue):
            raise InvalidQuery("a path is needed")
        return args[0].binding

    def f_element_id(self, *args) -> E:
        if len(args) != 1 or not isinstance(args[0].binding, Element):
            raise InvalidQuery("ELEMENT_ID needs an element")
        e = args[0].binding
        return E(F.concat(F.lit(f"g{e.graph.id}:{e.kind[0]}:"), F.col(e.id).cast("string")), "string")

    def pairs(self, args, same: bool) -> E:
        if len(args) < 2 or not all(isinstance(a.binding, Element) for a in args):
            raise InvalidQuery("two or more elements are needed")
        tests = [self.identical([a, b], same).col for i, a in enumerate(args) for b in args[i + 1 :]]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return E(out, "bool")

    def f_same(self, *args) -> E:
        return self.pairs(args, True)

    def f_all_different(self, *args) -> E:
        return self.pairs(args, False)
