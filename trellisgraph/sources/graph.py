"""Graph data: fragments of nodes and edges, each a DataFrame with one label set and one property layout."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidQuery

ID, SOURCE, TARGET = "_id", "_src", "_dst"
_KINDS = {"boolean": "bool", "bigint": "int", "double": "float", "string": "string", "binary": "bytes"}
_SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary"}


@dataclass(frozen=True)
class Fragment:
    """Rows that share a label set and a layout. Columns: _id, for edges also _src and _dst, then properties.

    ``df`` is what the layers make: each adds rows or takes the ids of its column ``__gone`` out of the layers before it. So a
    change of few rows writes few rows, and what is there stays as it is. No layers: ``df`` is the only one.
    """

    df: DataFrame
    labels: frozenset
    directed: bool | None = None  # None: nodes
    properties: tuple = ()  # (name, type)
    layers: tuple = ()  # ("rows" or "gone", frame)

    @property
    def is_edge(self) -> bool:
        return self.directed is not None

    def parts(self) -> tuple:
        return self.layers or (("rows", self.df),)

    def without(self, gone: DataFrame) -> Fragment:
        """Without the ids in a written frame's column __gone."""
        return replace(self, df=_without(self.df, gone), layers=(*self.parts(), ("gone", gone)))

    def plus(self, rows: DataFrame) -> Fragment:
        """With more rows of the same layout."""
        return replace(self, df=self.df.unionAll(rows), layers=(*self.parts(), ("rows", rows)))

    def sealed(self, df: DataFrame) -> Fragment:
        """With other rows, as one layer."""
        return replace(self, df=df, layers=())


def _without(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("__gone"), F.col(ID) == F.col("__gone"), "left_anti")


def folded(layers) -> DataFrame:
    """The rows that layers make."""
    df = None
    for kind, frame in layers:
        df = frame if df is None else df.unionAll(frame) if kind == "rows" else _without(df, frame)
    return df


def fragment(df: DataFrame, labels, directed: bool | None = None) -> Fragment:
    """Check a table's layout; integers of other widths are widened, other types refused."""
    wanted = [ID] if directed is None else [ID, SOURCE, TARGET]
    types = dict(df.dtypes)
    for name in wanted:
        if name not in types:
            raise InvalidQuery(f"column {name} is missing")
    if clash := {c for c in df.columns if c.startswith("__")}:
        raise InvalidQuery(f"reserved column names: {sorted(clash)}")
    columns, properties = [F.col(f"`{c}`").cast("bigint").alias(c) for c in wanted], []
    for name, kind in df.dtypes:
        if name in wanted:
            continue
        kind = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}.get(kind, kind)
        if kind not in _KINDS:
            raise InvalidQuery(f"property {name} has type {kind}, which graphs do not store")
        columns.append(F.col(f"`{name}`").cast(kind).alias(name))
        properties.append((name, _KINDS[kind]))
    return Fragment(df.select(*columns), frozenset(labels), directed, tuple(properties))


@dataclass(frozen=True)
class GraphData:
    nodes: tuple = ()
    edges: tuple = ()
    #: Ids from here on have never been published.
    next_id: int | None = None
    counts: dict = field(default_factory=dict, compare=False)

    def fragments(self, kind: str) -> tuple:
        return self.nodes if kind == "node" else self.edges

    def count(self, kind: str) -> int:
        """Elements of a kind; counted once for each snapshot."""
        if kind not in self.counts:
            self.counts[kind] = sum(f.df.count() for f in self.fragments(kind))
        return self.counts[kind]

    def fresh_id(self) -> int:
        if self.next_id is not None:
            return self.next_id
        tops = [f.df.agg(F.max(ID)).first()[0] for f in (*self.nodes, *self.edges)]
        return max([t for t in tops if t is not None], default=-1) + 1


def graph(nodes: list[Fragment], edges: list[Fragment], validate: bool = True) -> GraphData:
    """Graph data from fragments; ``validate`` looks for null and repeated ids and dangling edges with distributed jobs."""
    data = GraphData(tuple(nodes), tuple(edges))
    if validate:
        for kind in ("node", "edge"):
            parts = [f.df.select(ID) for f in data.fragments(kind)]
            if not parts:
                continue
            ids = parts[0]
            for p in parts[1:]:
                ids = ids.unionAll(p)
            if not ids.where(F.col(ID).isNull() | (F.col(ID) < 0)).isEmpty():
                raise InvalidQuery(f"{kind} ids must be 0 or more")
            if not ids.groupBy(ID).count().where("count > 1").isEmpty():
                raise InvalidQuery(f"{kind} ids must be unique")
            if kind == "node":
                known = ids
        for f in edges:
            ends = f.df.select(F.explode(F.array(SOURCE, TARGET)).alias(ID)).distinct()
            if not nodes or not ends.join(known, ID, "left_anti").isEmpty():
                raise InvalidQuery("an edge refers to a missing node")
    return data


def read_parquet(spark: SparkSession, path: str, labels, directed: bool | None = None) -> Fragment:
    return fragment(spark.read.parquet(path), labels, directed)


def from_arrow(spark: SparkSession, table, labels, directed: bool | None = None) -> Fragment:
    """From a pyarrow table or a pandas frame."""
    return fragment(spark.createDataFrame(table), labels, directed)


def read_csv(spark: SparkSession, path: str, schema: str, labels, directed: bool | None = None) -> Fragment:
    return fragment(spark.read.csv(path, schema=schema, header=True), labels, directed)


def read_json(spark: SparkSession, path: str, schema: str, labels, directed: bool | None = None) -> Fragment:
    return fragment(spark.read.json(path, schema=schema), labels, directed)


def read_manifest(spark: SparkSession, path: str) -> GraphData:
    """A JSON file {nodes: [{labels, file}], edges: [{labels, file, directed}]}; files are relative to it."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    spec, base = json.loads(text), path.rsplit("/", 1)[0]

    def place(name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{base}/{name}"

    return graph(
        [read_parquet(spark, place(n["file"]), n["labels"]) for n in spec.get("nodes", [])],
        [read_parquet(spark, place(e["file"]), e["labels"], bool(e.get("directed", True))) for e in spec.get("edges", [])],
    )


def unified(types: list[str]) -> tuple[str, bool]:
    """(type that a property is read as over fragments that store these types, whether families mix)."""
    kinds = set(types)
    if len(kinds) == 1:
        return types[0], False
    if kinds == {"int", "float"}:
        return "float", False
    if "bytes" in kinds:
        raise InvalidQuery("byte strings and other types are stored under one property")
    return "string", True


def spark_kind(kind: str) -> str:
    return _SPARK[kind]
