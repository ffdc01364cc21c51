"""Counts from weighted rows against the same statements over all joined rows."""

import random

import pytest
from pyspark.sql import functions as F

from trellisgraph.errors import InvalidQuery
from trellisgraph.operators import relational
from trellisgraph.session import Database
from trellisgraph.sources.graph import fragment, graph


@pytest.fixture(scope="module")
def dense(spark):
    """Two kinds of nodes, and edges of one label in two fragments, with loops, parallel and undirected edges."""
    dice = random.Random(5)
    a = spark.createDataFrame([(i, dice.choice([1, 2, None]), "ab"[i % 2]) for i in range(6)], "_id long, k long, s string")
    b = spark.createDataFrame([(i, dice.choice([1, 2, 3])) for i in range(6, 10)], "_id long, k long")

    def edges(first, n, sources, targets):
        return spark.createDataFrame([(first + i, dice.choice(sources), dice.choice(targets), dice.randrange(3)) for i in range(n)], "_id long, _src long, _dst long, w long")

    data = graph(
        [fragment(a, ["A", "X"]), fragment(b, ["B", "X"])],
        [fragment(edges(100, 14, range(6), range(6, 10)), ["E"], True), fragment(edges(200, 12, range(10), range(10)), ["E", "F"], True), fragment(edges(300, 9, range(10), range(10)), ["U"], False)],
    )
    session = Database(spark).session()
    session.create_graph("dense", data)
    return session


STATEMENTS = [
    "MATCH (a:A)-[:E]->(n), (b:A)-[:E]->(n) RETURN n.k AS k, COUNT(*) AS n GROUP BY k",
    "MATCH (a:A)-[:E]->(n)<-[:E]-(b) RETURN COUNT(*) AS n",
    "MATCH (a:A)-[:E]->(n)<-[:E]-(b) RETURN n, COUNT(a) AS c, COUNT(b.k) AS m GROUP BY n",
    "MATCH REPEATABLE ELEMENTS (a:A)-[:E]->(n)<-[:E]-(b) RETURN a.s AS s, COUNT(*) AS n GROUP BY s",
    "MATCH (a:A)-[:E]->(n) MATCH (b)-[:E]->(n) MATCH (c)-[:E]->(n) WHERE b.k > 1 RETURN a.k AS k, b.k AS l, COUNT(*) AS n GROUP BY k, l HAVING COUNT(*) > 3 ORDER BY n DESC, k, l LIMIT 4",
    "MATCH (a)-[:E]->(n), (b)-[:F]->(n), (c)-[:U]-(n) RETURN n.k AS k, COUNT(*) AS n GROUP BY k",
    "MATCH (a)-[:F]->(n), (b)-[:F]->(n), (c)-[:F]->(n) RETURN n.k AS k, COUNT(*) AS n GROUP BY k",
    "MATCH (a)-[:E]->(b)-[:E]->(c)-[:E]->(d) RETURN COUNT(*) AS n",
    "MATCH (a)-[:E]->(b)-[:E]->(c), (d)-[:F]->(b) RETURN COUNT(*) AS n",
    "MATCH (a)-[:F]->(b)-[:F]->(c), (d)-[:F]->(b)-[:F]->(e) RETURN COUNT(*) AS n",
    "MATCH (a)-[e:U]-(b), (c)-[f:U]-(d) WHERE a.k = c.k AND e.w <= f.w RETURN a.k AS k, COUNT(*) AS n GROUP BY k",
    "MATCH (a)~[:U]~(b)~[:U]~(a) RETURN COUNT(*) AS n",
    "MATCH (a)-[:E]->(b), (b)-[:U]-(a) RETURN COUNT(*) AS n",
    "MATCH (a)-[:E]->()<-[:F]-(b WHERE b.k = a.k) RETURN a.s AS s, COUNT(a.k) AS n GROUP BY s",
    "MATCH (a:A)-[:E]->(n), (n:B {k: 1})<-[:E]-(b WHERE b.k <> n.k) RETURN COUNT(*) AS n",
    "MATCH (a:A)-[:E]->(n), (n WHERE n.k > a.k) RETURN COUNT(*) AS n",
    "MATCH (a:A), (b:B) RETURN a.s AS s, COUNT(*) AS n GROUP BY s",
    "MATCH (a:A), (b:B), (c:Nothing) RETURN COUNT(*) AS n, COUNT(a.k) AS m",
    "MATCH (a:A), (c:Nothing) RETURN a.s AS s, COUNT(*) AS n GROUP BY s",
    "MATCH (a:A), (b:X) WHERE a.k < b.k LET d = b.k - a.k FILTER d < 2 RETURN d, COUNT(*) AS n GROUP BY d",
    "MATCH (a)-[e:F]->(b) LET x = b MATCH (x2)-[:E]->(b) FILTER SAME(x, b) RETURN x.k AS k, e.w AS w, COUNT(*) AS n GROUP BY k, w",
    "MATCH (a:A)-[:E]->(n), (b:B)-[:F]->(m) FILTER ALL_DIFFERENT(a, n, m) RETURN COUNT(*) AS n",
    "MATCH (a)-[e:F]->(b), (c)-[f:F]->(d) RETURN e IS LABELED F AS l, COUNT(*) + 1 AS n, COUNT(f) AS m GROUP BY l",
    "MATCH (a)-[:F]->(b)-[:F]->(a) RETURN DISTINCT COUNT(*) AS n",
]


@pytest.mark.parametrize("text", STATEMENTS)
def test_weighted_rows_count_what_joined_rows_count(dense, monkeypatch, text):
    found = dense.query(text)
    got, types = found.rows(), found.df.dtypes
    seen = []
    monkeypatch.setattr(relational, "counted", lambda tree: seen.append(tree))
    plain = dense.query(text)
    assert seen and types == plain.df.dtypes
    wanted = plain.rows()
    if "ORDER BY" not in text:
        got, wanted = sorted(got, key=str), sorted(wanted, key=str)
    assert got == wanted


def test_equal_edges_leave_no_empty_group(spark):
    """One edge for each node: no two edges meet, so there is no group at all."""
    nodes = spark.range(4).select(F.col("id").alias("_id"), F.col("id").alias("k"))
    edges = spark.range(4).select((F.col("id") + 10).alias("_id"), F.col("id").alias("_src"), F.col("id").alias("_dst"))
    session = Database(spark).session()
    session.create_graph("g", graph([fragment(nodes, ["N"])], [fragment(edges, ["E"], True)]))
    assert session.query("MATCH (a)-[:E]->(n), (b)-[:E]->(n) RETURN n.k AS k, COUNT(*) AS c GROUP BY k").rows() == []
    assert session.query("MATCH (a)-[:E]->(n), (b)-[:E]->(n) RETURN COUNT(*) AS c").rows() == [(0,)]


def test_pairs_of_large_groups_are_not_joined(spark):
    """300,000 rows on each side of one node are 90 billion pairs less the equal ones."""
    n = 300_000
    nodes = spark.range(n + 1).select(F.col("id").alias("_id"), (F.col("id") % 2).alias("k"))
    edges = spark.range(1, n + 1).select((F.col("id") + n).alias("_id"), F.col("id").alias("_src"), F.lit(0).cast("long").alias("_dst"))
    session = Database(spark).session()
    session.create_graph("g", graph([fragment(nodes, ["N"])], [fragment(edges, ["E"], True)], validate=False))
    for text in ("MATCH (a)-[:E]->(n), (b)-[:E]->(n) RETURN n.k AS k, COUNT(*) AS c GROUP BY k", "MATCH (a)-[:E]->(n)<-[:E]-(b) RETURN n.k AS k, COUNT(*) AS c GROUP BY k"):
        df = session.query(text).df
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.index("Join") :]  # else this would not end
        assert [tuple(r) for r in df.collect()] == [(0, n * n - n)]


def test_names_are_still_checked(dense):
    for text in ("MATCH (a)-[e:E]->(b), (c)-[e:E]->(d) RETURN x.k AS k, COUNT(*) AS n GROUP BY k", "MATCH (a)-[a:E]->(b), (c) RETURN COUNT(*) AS n", "MATCH (a), (b) WHERE z.k = 1 RETURN COUNT(*) AS n", "MATCH (a), (b) LET b = 1 RETURN COUNT(*) AS n", "MATCH (a), (b) RETURN a.k AS k, COUNT(*) AS n, COUNT(*) AS k"):
        with pytest.raises(InvalidQuery):
            dense.query(text).rows()
