"""Streams into graphs: micro-batches of a streaming DataFrame become elements of a stored graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..errors import InvalidQuery
from ..operators.mutate import add_fragment
from ..session import MAIN_BRANCH, Database
from ..sources.graph import ID, SOURCE, TARGET, GraphData, fragment
from ..sources.storage import freeze


def appending(stream: DataFrame, database: Database, graph: str, labels, directed: bool | None = None, schema: tuple = ("main",), branch: str = MAIN_BRANCH, name: str | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch as rows of one fragment of a graph; start it with ``.start()``.

    A batch is one commit, which also holds its number under ``name`` (the graph and labels unless given): a batch that comes again,
    after a restart too where the database is stored, is skipped. A batch writes its own rows only. Ids that are null,
    repeated or known, and edges without their nodes, fail the batch. Give each stream into one graph a name of its own.
    """
    mark = name or "/".join([*schema, graph, *sorted(labels)])

    def append(batch: DataFrame, number: int) -> None:
        if batch.isEmpty() or number <= database.state(branch).marks.get(mark, -1):
            return
        session = database.session(branch)
        session.schema = schema
        state = database.state(branch)
        data: GraphData = state.graphs.get(state.catalog.find((*schema, graph), "graph").id, GraphData())
        new = fragment(batch, labels, directed)
        new = replace(new, df=freeze(new.df))
        check(data, new)
        session.replace_graph_data(graph, add_fragment(replace(data, next_id=None), new), {mark: number})

    return stream.writeStream.foreachBatch(append)


def check(data: GraphData, new) -> None:
    """Ids of a batch must be new, and the ends of its edges known."""
    ids = new.df.select(ID)
    if not ids.where(F.col(ID).isNull() | (F.col(ID) < 0)).isEmpty() or not ids.groupBy(ID).count().where("count > 1").isEmpty():
        raise InvalidQuery("ids of a batch must be 0 or more, and unique")
    for f in data.edges if new.is_edge else data.nodes:
        if not f.df.join(ids.select(F.col(ID).alias("__new")), F.col(ID) == F.col("__new"), "left_semi").isEmpty():
            raise InvalidQuery("a batch holds ids that the graph has")
    if new.is_edge:
        ends = new.df.select(F.explode(F.array(SOURCE, TARGET)).alias("__end")).distinct()
        for f in data.nodes:
            ends = ends.join(f.df.select(ID), F.col("__end") == F.col(ID), "left_anti")
        if not ends.isEmpty():
            raise InvalidQuery("an edge refers to a missing node")
