"""Working tables: a DataFrame with generated column names, and what the query's names stand for."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.scalar import E, spark_type

_numbers = itertools.count()


def fresh(purpose: str) -> str:
    return f"__{next(_numbers)}_{purpose}"


@dataclass(frozen=True)
class GraphRef:
    """A graph as a statement sees it; ``cell`` holds the current data, which changes within a statement replace."""

    id: int
    name: tuple
    cell: list

    @property
    def data(self):
        return self.cell[0]


@dataclass(frozen=True)
class Element:
    kind: str  # node, edge
    graph: GraphRef
    id: str  # column names
    fragment: str
    properties: dict = field(default_factory=dict)  # folded name: (display, column, type, {family type: column} or None)
    conditional: bool = False
    #: Looked up again after a change: rows whose element is gone have an id and no fragment.
    guarded: bool = False

    def columns(self) -> list[str]:
        out = [self.id, self.fragment]
        for _, column, _, variants in self.properties.values():
            out += [column, *(variants or {}).values()]
        return out


@dataclass(frozen=True)
class Scalar:
    column: str
    type: object
    #: The graph of the elements in a list.
    graph: GraphRef | None = None
    conditional: bool = False
    group: bool = False
    #: Typed columns of a value whose stored type differs between rows.
    variants: dict | None = None

    def columns(self) -> list[str]:
        return [self.column, *(self.variants or {}).values()]


@dataclass(frozen=True)
class PathValue:
    nodes: str
    edges: str
    graph: GraphRef
    conditional: bool = False

    def columns(self) -> list[str]:
        return [self.nodes, self.edges]


@dataclass
class Table:
    df: DataFrame
    scope: dict  # folded name: (display, binding)
    unit: bool = False

    def bind(self, name: str, binding) -> Table:
        return Table(self.df, {**self.scope, name.lower(): (name, binding)})

    def find(self, name: str):
        hit = self.scope.get(name.lower())
        return hit and hit[1]

    def where(self, condition: Column) -> Table:
        return replace(self, df=self.df.where(condition), unit=False)

    def with_column(self, name: str, value: E, binding=None) -> Table:
        column = fresh("value")
        df = self.df.withColumn(column, value.col)
        return Table(df, self.scope).bind(name, binding or Scalar(column, value.type))

    def cross(self, other: DataFrame) -> DataFrame:
        return other if self.unit else self.df.crossJoin(other)

    def columns(self) -> list[str]:
        return [c for _, b in self.scope.values() for c in b.columns()]

    def pruned(self) -> Table:
        """Only the columns that names stand for."""
        return Table(self.df.select(*dict.fromkeys(self.columns())), self.scope, self.unit and not self.scope)


def live(element: Element, value: Column) -> Column:
    """A value read from an element; of a deleted one it is an error, row by row."""
    if not element.guarded:
        return value
    gone = F.col(element.id).isNotNull() & F.col(element.fragment).isNull()
    return F.when(gone, F.raise_error(F.lit("a deleted element was read"))).otherwise(value)


def ref_struct(element: Element) -> Column:
    value = F.struct(
        F.lit(element.graph.id).cast("bigint").alias("__gql_element_graph"), F.lit(element.kind[0]).alias("__gql_element_kind"), F.col(element.id).alias("__gql_element_id")
    )
    return live(element, F.when(F.col(element.id).isNotNull(), value))


def output(binding) -> Column:
    """How a value looks in a result."""
    if isinstance(binding, Element):
        return ref_struct(binding)
    if isinstance(binding, PathValue):
        value = F.struct(F.lit(binding.graph.id).cast("bigint").alias("__gql_path_graph"), F.col(binding.nodes).alias("__gql_path_nodes"), F.col(binding.edges).alias("__gql_path_edges"))
        return F.when(F.col(binding.nodes).isNotNull(), value)
    if isinstance(binding.type, tuple) and binding.type[0] == "list" and isinstance(binding.type[1], tuple) and binding.type[1][0] == "ref" and binding.graph is not None:
        kind = binding.type[1][1]
        return F.transform(
            binding.column,
            lambda x: F.struct(F.lit(binding.graph.id).cast("bigint").alias("__gql_element_graph"), F.lit(kind[0]).alias("__gql_element_kind"), x.alias("__gql_element_id")),
        )
    return F.col(binding.column)


def elements_of(graph: GraphRef, path: PathValue) -> Column:
    """[node, edge, node, ...] of a path as references."""

    def ref(kind: str):
        return lambda x: F.struct(F.lit(graph.id).cast("bigint").alias("__gql_element_graph"), F.lit(kind).alias("__gql_element_kind"), x.alias("__gql_element_id"))

    nodes, edges = F.transform(path.nodes, ref("n")), F.transform(path.edges, ref("e"))
    pairs = F.zip_with(edges, F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), lambda e, n: F.array(e, n))
    return F.concat(F.slice(nodes, 1, 1), F.flatten(pairs))


def no_rows(df: DataFrame) -> DataFrame:
    return df.limit(0)


def typed_null(t) -> Column:
    return F.lit(None).cast(spark_type(t))


def check_new(table: Table, name: str, what: str = "variable") -> None:
    if table.find(name):
        raise InvalidQuery(f"{what} {name} is already bound")
