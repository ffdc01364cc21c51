"""A property graph over the driver's relational tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Database, Session
from .graph import GraphData, fragment

#: Element ids are a table's key plus a multiple of this.
BLOCK = 10**12


def _key(block: int, column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint") + block * BLOCK


def _row_id(block: int) -> Column:
    """Row numbers of a table without a key. Few queries read them, and those that don't keep all pushdown."""
    return F.monotonically_increasing_id() + F.lit(block * BLOCK)


def graph_of(spark: SparkSession, sf_dir: str) -> GraphData:
    """Fragments are lazy projections of the tables: scans stay prunable and filters reach the files."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    region, nation, customer, supplier, part, orders = (read(t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    lineitem, events, turns = read("lineitem"), read("events"), read("conversations")
    line = lineitem.select("*", _row_id(100).alias("_contains"), _row_id(4_000_000).alias("_supplied"))
    # Turns have a range of their own, with 2^20 numbers for each conversation.
    turn_id = F.lit(BLOCK * 1_000_000) + F.col("conv_id") * (1 << 20) + F.col("turn")
    nodes = [
        fragment(region.select(_key(1, "r_regionkey").alias("_id"), "r_regionkey", "r_name", F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("key")), ["Region"]),
        fragment(nation.select(_key(2, "n_nationkey").alias("_id"), "n_nationkey", "n_name"), ["Nation"]),
        fragment(customer.select(_key(3, "c_custkey").alias("_id"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")), ["Customer", "Party"]),
        fragment(supplier.select(_key(4, "s_suppkey").alias("_id"), "s_suppkey", "s_name", "s_acctbal", F.col("s_acctbal").cast("bigint").alias("balance")), ["Supplier", "Party"]),
        fragment(part.select(_key(5, "p_partkey").alias("_id"), "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), ["Part"]),
        fragment(orders.select(_key(6, "o_orderkey").alias("_id"), "o_orderkey", "o_orderstatus", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("o_orderdate"), "o_orderpriority"), ["SalesOrder"]),
        fragment(turns.select(turn_id.alias("_id"), "conv_id", "turn", "role", "text"), ["Turn"]),
        fragment(events.select(_key(8, "event_id").alias("_id"), "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id"), ["Event"]),
    ]
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    twins = nation.alias("a").join(nation.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    edges = [
        fragment(nation.select(_key(11, "n_nationkey").alias("_id"), _key(2, "n_nationkey").alias("_src"), _key(1, "n_regionkey").alias("_dst")), ["IN_REGION"], True),
        fragment(customer.select(_key(12, "c_custkey").alias("_id"), _key(3, "c_custkey").alias("_src"), _key(2, "c_nationkey").alias("_dst")), ["IN_NATION"], True),
        fragment(supplier.select(_key(13, "s_suppkey").alias("_id"), _key(4, "s_suppkey").alias("_src"), _key(2, "s_nationkey").alias("_dst")), ["IN_NATION", "SELLS_FROM"], True),
        fragment(orders.select(_key(14, "o_orderkey").alias("_id"), _key(3, "o_custkey").alias("_src"), _key(6, "o_orderkey").alias("_dst")), ["PLACED"], True),
        fragment(line.select(F.col("_contains").alias("_id"), _key(6, "l_orderkey").alias("_src"), _key(5, "l_partkey").alias("_dst"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), ["CONTAINS"], True),
        fragment(line.select(F.col("_supplied").alias("_id"), _key(5, "l_partkey").alias("_src"), _key(4, "l_suppkey").alias("_dst"), "l_quantity"), ["SUPPLIED_BY"], True),
        fragment(turns.where("turn > 0").select(turn_id.alias("_id"), (turn_id - 1).alias("_src"), turn_id.alias("_dst")), ["NEXT"], True),
        fragment(events.select("event_id", after.alias("after")).where("after is not null").select(_key(18, "event_id").alias("_id"), _key(8, "event_id").alias("_src"), _key(8, "after").alias("_dst")), ["NEXT_EVENT"], True),
        fragment(twins.select((F.col("a.n_nationkey") * 100 + F.col("b.n_nationkey") + 19 * BLOCK).alias("_id"), _key(2, "a.n_nationkey").alias("_src"), _key(2, "b.n_nationkey").alias("_dst")), ["NEIGHBOR"], False),
    ]
    return GraphData(tuple(nodes), tuple(edges))


@lru_cache(maxsize=8)
def _cached(application: str, sf_dir: str) -> GraphData:
    """Plans over immutable files, resolved once for each Spark application and folder."""
    return graph_of(SparkSession.active(), sf_dir)


def session_over(spark: SparkSession, sf_dir: str, **parameters) -> Session:
    """A session whose current graph is that of the tables."""
    session = Database(spark).session()
    session.create_graph("trade", _cached(spark.sparkContext.applicationId, sf_dir))
    for name, value in parameters.items():
        session.set_parameter(name, value)
    return session
