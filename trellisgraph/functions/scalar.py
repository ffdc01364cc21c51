"""Typed expressions.

Types: null, bool, int, float, string, bytes, path, ("ref", kind) and ("list", T). An expression over a property whose
stored type differs between fragments carries ``variants``: one typed expression per family, null on rows of other
fragments. Operators use every variant that fits; if none fits, the query is invalid.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery

SPARK_TYPES = {"null": "void", "bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary"}
EXACT = 2**53
LOW, HIGH = -(2.0**63), 2.0**63


@dataclass
class E:
    """A bound expression."""

    col: Column
    type: object
    value: object = None  # of a literal
    literal: bool = False
    variants: list | None = None
    #: For elements, lists of elements and paths: what they belong to.
    binding: object = None
    #: Of float arithmetic: the value before the check that it is finite.
    raw: Column | None = None


def spark_type(t) -> str:
    if isinstance(t, tuple):
        return f"array<{spark_type(t[1])}>" if t[0] == "list" else "bigint"
    return SPARK_TYPES[t]


def type_name(t) -> str:
    if isinstance(t, tuple):
        return f"List<{type_name(t[1])}>" if t[0] == "list" else f"{t[1]} reference"
    return {"int": "Int64", "float": "Float64", "string": "Utf8", "bool": "Boolean", "bytes": "Binary", "null": "Null", "path": "Path"}[t]


def family(t) -> object:
    return "number" if t in ("int", "float") else t


def common_type(a, b):
    """The type both widen to, or None."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a, b} == {"int", "float"}:
        return "float"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "list":
        inner = common_type(a[1], b[1])
        return inner and ("list", inner)
    return None


def literal(t: str, value) -> E:
    if t == "null" or value is None:
        return E(F.lit(None).cast(spark_type(t)) if t != "null" else F.lit(None), t, None, True)
    return E(F.lit(value).cast(spark_type(t)), t, value, True)


def widened(x: E, t, exact: bool = True) -> E:
    """The expression as type t; an integer that a float cannot hold is an error."""
    if x.type == t:
        return x
    if x.type == "null":
        return E(F.lit(None).cast(spark_type(t)), t, None, x.literal, binding=x.binding)
    if x.type == "int" and t == "float":
        if x.literal:
            if float(x.value) != x.value:
                raise InvalidQuery(f"integer {x.value} is not exactly representable as float")
            return literal("float", float(x.value))
        wide = x.col.cast("double")
        if exact:
            lost = (F.abs(wide) > EXACT) & ((wide >= HIGH) | (F.try_subtract(wide.try_cast("bigint"), x.col) != 0) | wide.try_cast("bigint").isNull())
            wide = F.when(lost, F.raise_error(F.lit("integer is not exactly representable as float")).cast("double")).otherwise(wide)
        return E(wide, "float")
    if isinstance(t, tuple) and t[0] == "list" and isinstance(x.type, tuple):
        return replace(x, col=F.transform(x.col, lambda v: widened(E(v, x.type[1]), t[1]).col), type=t)
    raise InvalidQuery(f"cannot read {type_name(x.type)} as {type_name(t)}")


def over_variants(args: list[E], apply, fits, what: str) -> E:
    """Apply an operator to every combination of stored types that fits."""
    options = [a.variants or [a] for a in args]
    if all(len(o) == 1 for o in options):
        chosen = [o[0] for o in options]
        if not fits(*chosen):
            raise InvalidQuery(f"{what}: incomparable types {' and '.join(type_name(c.type) for c in chosen)}")
        return apply(*chosen)
    results = [apply(*c) for c in product(*options) if fits(*c)]
    if not results:
        raise InvalidQuery(f"{what}: incomparable types {' and '.join(type_name(v.type) for o in options for v in o)}")
    if len(results) == 1:
        return results[0]
    types = reduce(lambda a, b: a and common_type(a, b), [r.type for r in results])
    if types is None:
        return E(F.coalesce(*[r.col.cast("string") for r in results]), "string", variants=results)
    return E(F.coalesce(*[widened(r, types).col for r in results]), types)


def comparable(a: E, b: E) -> bool:
    return common_type(a.type, b.type) is not None and "path" not in (a.type, b.type)


def compare(op: str, a: E, b: E) -> E:
    """Three-valued comparison."""
    return over_variants([a, b], lambda x, y: E(_compare(op, x, y), "bool"), comparable, f"{op}")


def _native(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "<>": "<>"}


def _compare(op: str, a: E, b: E) -> Column:
    if "null" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if {a.type, b.type} == {"int", "float"}:
        return _int_float(op, a, b) if a.type == "int" else _int_float(_FLIP[op], b, a)
    if isinstance(a.type, tuple) and a.type[0] == "list":
        return _list_compare(op, a, b)
    return _native(op, a.col, b.col)


def _int_float(op: str, i: E, d: E) -> Column:
    """Exact: neither side is rounded to the other's type. Literals keep the comparison one that scans can use."""
    if i.literal and i.value is not None and abs(i.value) <= EXACT:
        return _native(op, F.lit(float(i.value)), d.col)
    if d.literal and d.value is not None:
        v = d.value
        if v != v or not LOW <= v < HIGH:
            less = v >= HIGH
            truth = {"=": False, "<>": True, "<": less, "<=": less, ">": v < LOW, ">=": v < LOW}[op]
            return F.when(i.col.isNotNull(), F.lit(truth))
        if v == floor(v):
            return _native(op, i.col, F.lit(int(v)))
        if op in ("=", "<>"):
            return F.when(i.col.isNotNull(), F.lit(op == "<>"))
        return i.col <= F.lit(floor(v)) if op in ("<", "<=") else i.col >= F.lit(ceil(v))
    whole = F.floor(F.when((d.col >= LOW) & (d.col < HIGH), d.col).otherwise(0.0)).cast("bigint")
    order = (
        F.when(i.col.isNull() | d.col.isNull(), F.lit(None).cast("int"))
        .when((d.col >= HIGH) | F.isnan(d.col), -1)
        .when(d.col < LOW, 1)
        .when(i.col < whole, -1)
        .when(i.col > whole, 1)
        .when(d.col > whole.cast("double"), -1)
        .otherwise(0)
    )
    return _native(op, order, F.lit(0))


def _list_compare(op: str, a: E, b: E) -> Column:
    """By the first entries that differ, then by length; an undecided entry before makes the result unknown."""
    ta, tb = a.type[1], b.type[1]
    n = F.least(F.size(a.col), F.size(b.col))

    def order(x: Column, y: Column) -> Column:
        ex, ey = E(x, ta), E(y, tb)
        less, equal = _compare("<", ex, ey), _compare("=", ex, ey)
        return F.when(less, -1).when(equal, 0).when(equal.isNull(), 2).otherwise(1)

    steps = F.zip_with(F.slice(a.col, 1, n), F.slice(b.col, 1, n), order)
    first = F.aggregate(steps, F.lit(0), lambda acc, x: F.when(acc == 0, x).otherwise(acc))
    sizes = F.size(a.col), F.size(b.col)
    known = F.when(first != 0, first).when(sizes[0] < sizes[1], -1).when(sizes[0] > sizes[1], 1).otherwise(0)
    if op in ("=", "<>"):
        # A sure difference decides even after an unknown entry.
        sure = F.exists(steps, lambda s: (s == 1) | (s == -1)) | (sizes[0] != sizes[1])
        equal = F.when(sure, False).when(F.exists(steps, lambda s: s == 2), F.lit(None).cast("boolean")).otherwise(True)
        known_equal = F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean")).otherwise(equal)
        return known_equal if op == "=" else ~known_equal
    return F.when(a.col.isNotNull() & b.col.isNotNull() & (known != 2), _native(op, known, F.lit(0)))


def arithmetic(op: str, a: E, b: E) -> E:
    def fits(x: E, y: E) -> bool:
        return all(t in ("int", "float", "null") for t in (x.type, y.type))

    return over_variants([a, b], lambda x, y: _arithmetic(op, x, y), fits, op)


def finite(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non-finite arithmetic result")).cast("double")).otherwise(c)


def _arithmetic(op: str, a: E, b: E) -> E:
    if "null" in (a.type, b.type):
        t = common_type(a.type, b.type)
        return E(F.lit(None).cast(spark_type("int" if t == "null" else t)), "int" if t == "null" else t)
    if a.type == b.type == "int":
        if op == "/":
            return E(F.call_function("div", a.col, b.col), "int")
        return E({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], "int")
    # +, - and * carry a non-finite operand on, so one check at the end is enough; a divisor is checked before it is used,
    # as it could hide there. This keeps expressions linear in the length of the query.
    left, right = widened(a, "float"), widened(b, "float")
    x = left.col if left.raw is None else left.raw
    y = right.col if right.raw is None or op == "/" else right.raw
    raw = {"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op]
    return E(finite(raw), "float", raw=raw)


def negate(x: E) -> E:
    def apply(v: E) -> E:
        return literal(v.type, -v.value) if v.literal and v.value is not None else E(-v.col, v.type) if v.type != "null" else v

    return over_variants([x], apply, lambda v: v.type in ("int", "float", "null"), "-")


def concatenate(a: E, b: E) -> E:
    def apply(x: E, y: E) -> E:
        return E(F.concat(x.col.cast("string"), y.col.cast("string")), "string")

    return over_variants([a, b], apply, lambda x, y: {x.type, y.type} <= {"string", "null"}, "||")


def as_bool(x: E, what: str) -> Column:
    def apply(v: E) -> E:
        return E(v.col.cast("boolean"), "bool")

    return over_variants([x], apply, lambda v: v.type in ("bool", "null"), what).col


def logical(op: str, a: E, b: E) -> E:
    x, y = as_bool(a, op), as_bool(b, op)
    return E({"AND": x & y, "OR": x | y, "XOR": x != y}[op], "bool")


def coalesce(args: list[E]) -> E:
    kinds = reduce(lambda t, x: None if t is None else common_type(t, x.type), args, "null")
    if kinds is None:
        raise InvalidQuery("COALESCE: incompatible types")
    if len(args) == 1:
        return args[0]
    return E(F.coalesce(*[widened(x, kinds).col for x in args]), kinds)


def nullif(a: E, b: E) -> E:
    equal = compare("=", a, b)
    return E(F.when(F.coalesce(equal.col, F.lit(False)), F.lit(None)).otherwise(a.col), a.type)


def list_of(items: list[E]) -> E:
    kind = reduce(lambda t, x: None if t is None else common_type(t, x.type), items, "null")
    if kind is None:
        raise InvalidQuery("list entries have no common type")
    if not items:
        return E(F.array().cast("array<void>"), ("list", "null"))
    return E(F.array(*[widened(x, kind).col for x in items]), ("list", kind))
