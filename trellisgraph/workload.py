"""Queries over the driver's tables, one for each operator family, with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = """
MATCH (c:Customer)-[:PLACED]->(o:SalesOrder)
WHERE o.o_totalprice > 100000.0
RETURN c.c_mktsegment AS segment, COUNT(*) AS orders, MAX(o.o_totalprice) AS top
GROUP BY segment ORDER BY orders DESC, segment LIMIT 5
"""

_NEIGHBOR = "nb AS (SELECT a.n_nationkey * 100 + b.n_nationkey AS e, a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), st AS (SELECT e, x, y FROM nb UNION ALL SELECT e, y, x FROM nb)"

_TRAILS = "w AS (SELECT n_nationkey AS x, n_nationkey AS y, []::BIGINT[] AS es, 0 AS hops FROM nation UNION ALL SELECT w.x, st.y, list_append(es, st.e), hops + 1 FROM w JOIN st ON st.x = w.y WHERE hops < 3 AND NOT list_contains(es, st.e))"

#: name: (query, SQL). A name ending in a column list after a colon rounds these to 4 places on both sides.
WORKLOAD: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "SELECT c_mktsegment AS segment, COUNT(*) AS orders, MAX(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "src_node_scan": ("MATCH (n:Nation) RETURN n.n_name AS name, n.n_nationkey AS id", "SELECT n_name AS name, n_nationkey::BIGINT AS id FROM nation"),
    "src_edge_directions": ("MATCH (a:Nation)<-[:IN_NATION]-(b:Supplier) RETURN a.n_name AS nation, COUNT(*) AS n GROUP BY nation", "SELECT n_name AS nation, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "src_edge_right": ("MATCH (a:Supplier)-[:IN_NATION]->(b:Nation) RETURN b.n_name AS nation, COUNT(*) AS n GROUP BY nation", "SELECT n_name AS nation, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "src_edge_undirected": ("MATCH (a:Nation)~[:NEIGHBOR]~(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {_NEIGHBOR} SELECT x::BIGINT AS a, y::BIGINT AS b FROM st"),
    "src_edge_any": ("MATCH (a:Nation)-[:NEIGHBOR|IN_REGION|IN_NATION]-(b) RETURN a.n_nationkey AS a, COUNT(*) AS n GROUP BY a", f"WITH {_NEIGHBOR}, k AS (SELECT x FROM st UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT x::BIGINT AS a, COUNT(*) AS n FROM k GROUP BY 1"),
    "src_edge_left_or_right": ("MATCH (a:Nation)<-[:NEIGHBOR|IN_REGION|IN_NATION]->(b) RETURN a.n_nationkey AS a, COUNT(*) AS n GROUP BY a", "WITH k AS (SELECT n_nationkey AS x FROM nation UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT x::BIGINT AS a, COUNT(*) AS n FROM k GROUP BY 1"),
    "src_edge_left_or_undirected": ("MATCH (a:Nation)<~[:NEIGHBOR|IN_REGION|IN_NATION]~(b) RETURN a.n_nationkey AS a, COUNT(*) AS n GROUP BY a", f"WITH {_NEIGHBOR}, k AS (SELECT x FROM st UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT x::BIGINT AS a, COUNT(*) AS n FROM k GROUP BY 1"),
    "src_edge_right_or_undirected": ("MATCH (a:Nation)~[:NEIGHBOR|IN_REGION|IN_NATION]~>(b) RETURN a.n_nationkey AS a, COUNT(*) AS n GROUP BY a", f"WITH {_NEIGHBOR}, k AS (SELECT x FROM st UNION ALL SELECT n_nationkey FROM nation) SELECT x::BIGINT AS a, COUNT(*) AS n FROM k GROUP BY 1"),
    "src_empty_label": ("MATCH (n:Nothing) RETURN COUNT(*) AS n", "SELECT 0::BIGINT AS n"),
    "src_label_union": ("MATCH (n:Region|Nation) RETURN COUNT(*) AS n, COUNT(n.n_name) AS nations", "SELECT (SELECT COUNT(*) FROM region) + (SELECT COUNT(*) FROM nation) AS n, (SELECT COUNT(*) FROM nation) AS nations"),
    "flt_label_algebra": ("MATCH (n:Party & !Supplier) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM customer"),
    "flt_labeled_predicate": ("MATCH (n:Party) RETURN n IS LABELED Supplier AS s, COUNT(*) AS n GROUP BY s", "SELECT false AS s, COUNT(*) AS n FROM customer UNION ALL SELECT true, COUNT(*) FROM supplier"),
    "flt_stored_type": ("MATCH (n:Region|Customer) WHERE n.key < 10 RETURN n.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey < 10"),
    "flt_stored_type_string": ("MATCH (n:Region|Customer) WHERE n.key >= 'R2' RETURN n.r_name AS name", "SELECT r_name AS name FROM region WHERE 'R' || r_regionkey >= 'R2'"),
    "flt_stored_operator": ("MATCH (n:Region|Customer) FILTER n.key + 1 <= 3 OR n.key || 'x' = 'R1x' RETURN COUNT(*) AS n", "SELECT (SELECT COUNT(*) FROM customer WHERE c_custkey + 1 <= 3) + 1 AS n"),
    "flt_inline_where": ("MATCH (c:Customer WHERE c.c_acctbal < 0.0)-[:IN_NATION]->(n:Nation {n_nationkey: 3}) RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal < 0 AND c_nationkey = 3"),
    "flt_null_tests": ("MATCH (n:Party) RETURN n.s_name IS NULL AS missing, COUNT(*) AS n GROUP BY missing", "SELECT true AS missing, COUNT(*) AS n FROM customer UNION ALL SELECT false, COUNT(*) FROM supplier"),
    "flt_truth_tests": ("MATCH (n:Party) FILTER (n.s_acctbal > 0.0) IS UNKNOWN RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM customer"),
    "flt_property_exists": ("MATCH (n:Party) FILTER PROPERTY_EXISTS(n, s_suppkey) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM supplier"),
    "flt_path_where": ("MATCH p = ANY SHORTEST ((a:Turn {turn: 0})-[:NEXT]->{1,3}(b) WHERE b.turn > 1) RETURN a.conv_id AS conv, PATH_LENGTH(p) AS hops", "SELECT conv_id AS conv, turn AS hops FROM conversations WHERE turn IN (2, 3)"),
    "flt_where_after_selection": ("MATCH p = ANY SHORTEST (a:Nation)~[:NEIGHBOR]~{1,3}(b) WHERE PATH_LENGTH(p) > 1 RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH RECURSIVE {_NEIGHBOR}, {_TRAILS} SELECT x::BIGINT AS a, y::BIGINT AS b FROM w WHERE hops > 0 GROUP BY 1, 2 HAVING MIN(hops) > 1"),
    "flt_early_conjuncts": ("MATCH p = (a:Turn)-[:NEXT]->*(b) WHERE a.turn = 1 AND b.turn > a.turn + 1 AND PATH_LENGTH(p) < 4 RETURN a.conv_id AS conv, b.turn AS turn", "SELECT conv_id AS conv, turn FROM conversations WHERE turn IN (3, 4)"),
    "flt_directed": ("MATCH (:Nation)-[e:NEIGHBOR|IN_REGION]-() RETURN e IS DIRECTED AS d, COUNT(*) AS n GROUP BY d", f"WITH {_NEIGHBOR} SELECT false AS d, COUNT(*) AS n FROM st UNION ALL SELECT true, COUNT(*) FROM nation"),
    "flt_same": ("MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b) FILTER ALL_DIFFERENT(a, b) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "prj_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "prj_let_filter": ("MATCH (o:SalesOrder) LET half = o.o_totalprice / 2.0, twice = half * 4.0 FILTER twice > 600000.0 RETURN o.o_orderkey AS k, twice", "SELECT o_orderkey AS k, o_totalprice / 2 * 4 AS twice FROM orders WHERE o_totalprice / 2 * 4 > 600000"),
    "prj_select": ("SELECT n.n_name AS name FROM trade MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' ORDER BY name DESC LIMIT 3", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY 1 DESC LIMIT 3"),
    "join_rebound": ("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN n.n_name AS name, COUNT(*) AS pairs GROUP BY name", "SELECT n_name AS name, COUNT(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "join_cross": ("MATCH (a:Region), (b:Nation) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM region, nation"),
    "join_theta": ("MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey"),
    "join_reference": ("MATCH (a:Turn {turn: 0})((x)-[:NEXT]->(y)){2}(b) FOR v IN y MATCH (v)-[:NEXT]->(w) RETURN w.turn AS turn, COUNT(*) AS n GROUP BY turn", "SELECT turn, COUNT(*) AS n FROM conversations WHERE turn IN (2, 3) GROUP BY 1"),
    "join_edges_apart": ("MATCH (a:Nation)~[e:NEIGHBOR]~(b), (c:Nation)~[f:NEIGHBOR]~(d) WHERE a.n_nationkey = c.n_nationkey RETURN a.n_nationkey AS a, COUNT(*) AS n GROUP BY a", f"WITH {_NEIGHBOR} SELECT a.x::BIGINT AS a, COUNT(*) AS n FROM st a JOIN st b ON a.x = b.x AND a.e <> b.e GROUP BY 1"),
    "match_optional": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 9000.0 RETURN n.n_name AS name, COUNT(s) AS n GROUP BY name", "SELECT n_name AS name, COUNT(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1"),
    "match_optional_block": ("MATCH (c:Customer) OPTIONAL { MATCH (c)-[:PLACED]->(o:SalesOrder) MATCH (o)-[l:CONTAINS]->() WHERE l.l_quantity > 49.0 } RETURN COUNT(*) AS n, COUNT(o) AS hits", "SELECT COUNT(*) AS n, COUNT(k) AS hits FROM customer LEFT JOIN (SELECT o_custkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49) ON k = c_custkey"),
    "match_different_edges": ("MATCH (a:Nation)~[:NEIGHBOR]~(b)~[:NEIGHBOR]~(c) RETURN a.n_nationkey AS a, c.n_name AS name", f"WITH {_NEIGHBOR} SELECT a.x::BIGINT AS a, n_name AS name FROM st a JOIN st b ON a.y = b.x AND a.e <> b.e JOIN nation ON n_nationkey = b.y"),
    "match_repeatable": ("MATCH REPEATABLE ELEMENTS (a:Nation)~[:NEIGHBOR]~(b)~[:NEIGHBOR]~(c) RETURN a.n_nationkey AS a, c.n_name AS name", f"WITH {_NEIGHBOR} SELECT a.x::BIGINT AS a, n_name AS name FROM st a JOIN st b ON a.y = b.x JOIN nation ON n_nationkey = b.y"),
    "path_fixed_2hop": ("MATCH (c:Customer)-[:PLACED]->(o)-[l:CONTAINS]->(p:Part) WHERE p.p_size > 45 RETURN p.p_brand AS brand, COUNT(*) AS n, SUM(p.p_size) AS sizes GROUP BY brand", "SELECT p_brand AS brand, COUNT(*) AS n, SUM(p_size)::BIGINT AS sizes FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 45 GROUP BY 1"),
    "path_quant_0_3": ("MATCH p = (a:Turn {turn: 0})-[:NEXT]->{0,3}(b) RETURN a.conv_id AS conv, PATH_LENGTH(p) AS hops", "SELECT conv_id AS conv, turn AS hops FROM conversations WHERE turn <= 3"),
    "path_unbounded": ("MATCH p = (a:Turn {turn: 0})-[:NEXT]->*(b) RETURN PATH_LENGTH(p) AS hops, COUNT(*) AS n GROUP BY hops", "SELECT turn AS hops, COUNT(*) AS n FROM conversations GROUP BY 1"),
    "path_trail_undirected": ("MATCH p = TRAIL (a:Nation)~[:NEIGHBOR]~{1,3}(b) RETURN a.n_nationkey AS a, PATH_LENGTH(p) AS hops, b.n_nationkey AS b, COUNT(*) AS n GROUP BY a, hops, b",
        f"WITH RECURSIVE {_NEIGHBOR}, {_TRAILS} SELECT x::BIGINT AS a, hops::BIGINT AS hops, y::BIGINT AS b, COUNT(*) AS n FROM w WHERE hops > 0 GROUP BY 1, 2, 3"),
    "path_acyclic": ("MATCH REPEATABLE ELEMENTS p = ACYCLIC (a:Nation)~[:NEIGHBOR]~{1,4}(b) RETURN a.n_nationkey AS a, PATH_LENGTH(p) AS hops, COUNT(*) AS n GROUP BY a, hops",
        f"WITH RECURSIVE {_NEIGHBOR}, w AS (SELECT n_nationkey AS x, n_nationkey AS y, [n_nationkey]::BIGINT[] AS ns, 0 AS hops FROM nation UNION ALL SELECT w.x, st.y, list_append(ns, st.y), hops + 1 FROM w JOIN st ON st.x = w.y WHERE hops < 4 AND NOT list_contains(ns, st.y)) SELECT x::BIGINT AS a, hops::BIGINT AS hops, COUNT(*) AS n FROM w WHERE hops > 0 GROUP BY 1, 2"),
    "path_simple": ("MATCH REPEATABLE ELEMENTS p = SIMPLE (a:Nation)~[:NEIGHBOR]~{3,4}(a) RETURN a.n_nationkey AS a, PATH_LENGTH(p) AS hops, COUNT(*) AS n GROUP BY a, hops",
        f"WITH RECURSIVE {_NEIGHBOR}, w AS (SELECT n_nationkey AS x, n_nationkey AS y, []::BIGINT[] AS ns, 0 AS hops FROM nation UNION ALL SELECT w.x, st.y, list_append(ns, st.y), hops + 1 FROM w JOIN st ON st.x = w.y WHERE hops < 4 AND NOT list_contains(ns, st.y) AND NOT (hops > 0 AND w.y = w.x)) SELECT x::BIGINT AS a, hops::BIGINT AS hops, COUNT(*) AS n FROM w WHERE hops >= 3 AND y = x GROUP BY 1, 2"),
    "path_all_shortest": ("MATCH p = ALL SHORTEST (a:Nation)~[:NEIGHBOR]~{1,3}(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b, PATH_LENGTH(p) AS hops",
        f"WITH RECURSIVE {_NEIGHBOR}, {_TRAILS} SELECT x::BIGINT AS a, y::BIGINT AS b, hops::BIGINT AS hops FROM w WHERE hops > 0 QUALIFY dense_rank() OVER (PARTITION BY x, y ORDER BY hops) = 1"),
    "path_shortest_k_groups": ("MATCH p = SHORTEST 2 GROUPS (a:Nation)~[:NEIGHBOR]~{1,3}(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b, PATH_LENGTH(p) AS hops, COUNT(*) AS n GROUP BY a, b, hops",
        f"WITH RECURSIVE {_NEIGHBOR}, {_TRAILS}, r AS (SELECT x, y, hops, dense_rank() OVER (PARTITION BY x, y ORDER BY hops) AS g FROM w WHERE hops > 0) SELECT x::BIGINT AS a, y::BIGINT AS b, hops::BIGINT AS hops, COUNT(*) AS n FROM r WHERE g <= 2 GROUP BY 1, 2, 3"),
    "path_any_shortest": ("MATCH p = ANY SHORTEST (a:Nation)~[:NEIGHBOR]~{1,3}(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b, PATH_LENGTH(p) AS hops",
        f"WITH RECURSIVE {_NEIGHBOR}, {_TRAILS} SELECT x::BIGINT AS a, y::BIGINT AS b, MIN(hops)::BIGINT AS hops FROM w WHERE hops > 0 GROUP BY 1, 2"),
    "path_shortest_k": ("MATCH p = SHORTEST 3 (a:Nation)~[:NEIGHBOR]~{1,3}(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b, PATH_LENGTH(p) AS hops",
        f"WITH RECURSIVE {_NEIGHBOR}, {_TRAILS} SELECT x::BIGINT AS a, y::BIGINT AS b, hops::BIGINT AS hops FROM w WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY hops) <= 3"),
    "path_all": ("MATCH ALL (a:Turn {turn: 0})-[:NEXT]->{1,2}(b) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM conversations WHERE turn IN (1, 2)"),
    "path_any_k": ("MATCH p = ANY 2 (a:Nation)~[:NEIGHBOR]~{1,2}(b:Nation) RETURN a.n_nationkey AS a, COUNT(*) AS n GROUP BY a",
        f"WITH {_NEIGHBOR}, w AS (SELECT x, y FROM st UNION ALL SELECT a.x, b.y FROM st a JOIN st b ON a.y = b.x AND a.e <> b.e), c AS (SELECT x, y, least(COUNT(*), 2) AS k FROM w GROUP BY 1, 2) SELECT x::BIGINT AS a, SUM(k)::BIGINT AS n FROM c GROUP BY 1"),
    "path_group_list": ("MATCH (a:Turn {turn: 0})((x)-[e:NEXT]->(y)){2}(b:Turn) RETURN a.conv_id AS conv, b.turn AS turn", "SELECT conv_id AS conv, turn FROM conversations WHERE turn = 2"),
    "path_group_for": ("MATCH (a:Turn {turn: 0})((x)-[e:NEXT]->(y)){1,2}(b:Turn) FOR v IN y RETURN a.conv_id AS conv, v.turn AS turn", "SELECT conv_id AS conv, 1::BIGINT AS turn FROM conversations WHERE turn IN (1, 2) UNION ALL SELECT conv_id, 2 FROM conversations WHERE turn = 2"),
    "path_alternative_set": ("MATCH (n:Nation) | (n:Nation {n_nationkey: 1}) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM nation"),
    "path_alternative_bag": ("MATCH (n:Nation) |+| (n:Nation {n_nationkey: 1}) RETURN COUNT(*) AS n", "SELECT COUNT(*) + 1 AS n FROM nation"),
    "path_questioned": ("MATCH (a:Turn {turn: 0})(-[:NEXT]->(m))?(b) RETURN m.turn AS stop, COUNT(*) AS n GROUP BY stop", "SELECT NULL::BIGINT AS stop, COUNT(*) AS n FROM conversations WHERE turn = 0 UNION ALL SELECT 1, COUNT(*) FROM conversations WHERE turn = 1"),
    "path_simplified": ("MATCH (a:Turn {turn: 0})-/NEXT/->{2}(b) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM conversations WHERE turn = 2"),
    "path_elements": ("MATCH p = (a:Nation)-[:IN_REGION]->(r:Region) LET parts = ELEMENTS(p) RETURN COUNT(parts) AS n, MIN(PATH_LENGTH(p)) AS hops", "SELECT COUNT(*) AS n, 1::BIGINT AS hops FROM nation"),
    "path_event_chain": ("MATCH (a:Event {event_type: 'purchase'})-[:NEXT_EVENT]->(b:Event) RETURN b.event_type AS following, COUNT(*) AS n GROUP BY following",
        "SELECT following, COUNT(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE event_type = 'purchase' AND k IS NOT NULL GROUP BY 1"),
    "agg_group_having": ("MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_custkey AS k, COUNT(*) AS n GROUP BY k HAVING COUNT(*) > 15", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 15"),
    "agg_group_element": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.n_name AS name, COUNT(*) AS k GROUP BY n", "SELECT n_name AS name, COUNT(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "agg_distinct": ("MATCH (o:SalesOrder) RETURN COUNT(DISTINCT o.o_orderpriority) AS p, COUNT(DISTINCT o.o_orderstatus) AS s", "SELECT COUNT(DISTINCT o_orderpriority) AS p, COUNT(DISTINCT o_orderstatus) AS s FROM orders"),
    "agg_empty_global": ("MATCH (n:Nothing) RETURN COUNT(*) AS c, SUM(n.x) AS s", "SELECT 0::BIGINT AS c, NULL::BIGINT AS s"),
    "agg_implicit_group": ("MATCH (p:Part) RETURN p.p_brand AS brand, MIN(p.p_size) AS low, MAX(p.p_size) AS high, COUNT(*) + 1 AS more", "SELECT p_brand AS brand, MIN(p_size)::BIGINT AS low, MAX(p_size)::BIGINT AS high, COUNT(*) + 1 AS more FROM part GROUP BY 1"),
    "agg_stored_type": ("MATCH (n:Region|Customer) RETURN SUM(n.key + 0) AS s, COUNT(n.key + 0) AS n", "SELECT SUM(c_custkey)::BIGINT AS s, COUNT(*) AS n FROM customer"),
    "agg_avg_exact": ("FOR x IN [9007199254740993, 9007199254740995, 3] RETURN AVG(x) AS mean", "SELECT 6004799503160664.0::DOUBLE AS mean"),
    "agg_stddev_exact": ("FOR x IN [9007199254740993, 9007199254740992] RETURN STDDEV_POP(x) AS pop, STDDEV_POP(DISTINCT x) AS apart", "SELECT 0.5::DOUBLE AS pop, 0.5::DOUBLE AS apart"),
    "agg_percentile_disc_exact": ("FOR x IN [9007199254740993, 9007199254740992, 9007199254740995] RETURN PERCENTILE_DISC(x, 0.5) AS q, PERCENTILE_DISC(x, 1) AS top, PERCENTILE_CONT(x, 0) AS low", "SELECT 9007199254740993::BIGINT AS q, 9007199254740995::BIGINT AS top, 9007199254740992.0::DOUBLE AS low"),
    "agg_percentile_disc_rank": ("FOR x IN [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25] RETURN PERCENTILE_DISC(x, 0.28) AS q", "SELECT 7::BIGINT AS q"),
    "agg_percentile_groups:q": ("MATCH (c:Customer) RETURN c.c_mktsegment AS segment, PERCENTILE_CONT(c.c_acctbal, 0.9) AS q, PERCENTILE_DISC(c.c_custkey, 0.25) AS k GROUP BY segment", "SELECT c_mktsegment AS segment, quantile_cont(c_acctbal, 0.9) AS q, quantile_disc(c_custkey, 0.25) AS k FROM customer GROUP BY 1"),
    "agg_percentile_distinct:q": ("MATCH (p:Part) RETURN PERCENTILE_CONT(DISTINCT p.p_size, 0.5) AS q, STDDEV_SAMP(DISTINCT p.p_size) AS s", "SELECT quantile_cont(p_size, 0.5) AS q, stddev_samp(p_size) AS s FROM (SELECT DISTINCT p_size FROM part)"),
    "agg_avg:mean": ("MATCH (o:SalesOrder) RETURN o.o_orderstatus AS status, AVG(o.o_totalprice) AS mean GROUP BY status", "SELECT o_orderstatus AS status, AVG(o_totalprice) AS mean FROM orders GROUP BY 1"),
    "agg_sum_float:total": ("MATCH ()-[l:CONTAINS]->() RETURN l.l_returnflag AS flag, SUM(l.l_extendedprice * (1.0 - l.l_discount)) AS total GROUP BY flag", "SELECT l_returnflag AS flag, SUM(l_extendedprice * (1 - l_discount)) AS total FROM lineitem GROUP BY 1"),
    "agg_stddev:pop,samp": ("MATCH (p:Part) RETURN STDDEV_POP(p.p_size) AS pop, STDDEV_SAMP(p.p_size) AS samp", "SELECT stddev_pop(p_size) AS pop, stddev_samp(p_size) AS samp FROM part"),
    "agg_percentile_cont:q": ("MATCH (o:SalesOrder) RETURN o.o_orderstatus AS status, PERCENTILE_CONT(o.o_totalprice, 0.5) AS q GROUP BY status", "SELECT o_orderstatus AS status, quantile_cont(o_totalprice, 0.5) AS q FROM orders GROUP BY 1"),
    "agg_percentile_disc": ("MATCH (p:Part) RETURN PERCENTILE_DISC(p.p_size, 0.75) AS q", "SELECT quantile_disc(p_size, 0.75)::BIGINT AS q FROM part"),
    "agg_collect_list": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, COLLECT_LIST(n.n_nationkey) AS ids GROUP BY region NEXT FOR i IN ids RETURN region, i", "SELECT r_name AS region, n_nationkey::BIGINT AS i FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "set_union_all": ("MATCH (n:Nation) RETURN n.n_nationkey AS k UNION ALL MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "set_union": ("MATCH (n:Nation) RETURN n.n_nationkey AS k UNION MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "set_intersect_all": ("FOR x IN [1, 1, 2, 3] RETURN x INTERSECT ALL FOR x IN [1, 1, 1, 3] RETURN x", "SELECT unnest([1, 1, 3])::BIGINT AS x"),
    "set_except_all": ("MATCH (n:Nation) RETURN n.n_nationkey AS k EXCEPT ALL MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_nationkey::BIGINT AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region"),
    "set_intersect_distinct": ("MATCH (n:Nation) RETURN n.n_nationkey AS k INTERSECT DISTINCT MATCH (c:Customer) RETURN c.c_custkey AS k", "SELECT n_nationkey::BIGINT AS k FROM nation INTERSECT SELECT c_custkey FROM customer"),
    "set_except_distinct": ("FOR x IN [1, 1, 2, 3] RETURN x EXCEPT DISTINCT FOR x IN [3] RETURN x", "SELECT unnest([1, 2])::BIGINT AS x"),
    "set_widening": ("RETURN 1 AS x, NULL AS y, [1] AS z UNION ALL RETURN 2.5 AS x, 'a' AS y, [1.5] AS z NEXT FOR v IN z RETURN x, y, v", "SELECT * FROM (VALUES (1.0::DOUBLE, NULL, 1.0::DOUBLE), (2.5, 'a', 1.5)) t(x, y, v)"),
    "set_use_graph": ("USE GRAPH trade MATCH (r:Region) RETURN COUNT(*) AS n UNION ALL USE CURRENT_GRAPH MATCH (n:Nation) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM region UNION ALL SELECT COUNT(*) FROM nation"),
    "set_at_schema": ("AT SCHEMA /main USE GRAPH trade MATCH (r:Region) RETURN COUNT(*) AS n", "SELECT COUNT(*) AS n FROM region"),
    "set_otherwise": ("MATCH (r:Region {r_name: 'NOWHERE'}) RETURN r.r_name AS name OTHERWISE MATCH (r:Region) RETURN r.r_name AS name", "SELECT r_name AS name FROM region"),
    "set_trailing_page": ("MATCH (n:Nation) RETURN n.n_nationkey AS k UNION ALL MATCH (r:Region) RETURN r.r_regionkey AS k ORDER BY k DESC LIMIT 4", "SELECT n_nationkey::BIGINT AS k FROM nation ORDER BY 1 DESC LIMIT 4"),
    "next_yield": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r, COUNT(*) AS n GROUP BY r NEXT YIELD r AS region, n RETURN region.r_name AS name, n * 2 AS twice", "SELECT r_name AS name, COUNT(*) * 2 AS twice FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "nested_select": ("SELECT k, COUNT(*) AS n FROM { MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_mktsegment AS k, o.o_orderstatus AS s } WHERE s = 'O' GROUP BY k", "SELECT c_mktsegment AS k, COUNT(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1"),
    "for_ordinality": ("FOR x IN ['a', NULL, 'c'] WITH ORDINALITY i RETURN x, i", "SELECT * FROM (VALUES ('a', 1::BIGINT), (NULL, 2), ('c', 3)) t(x, i)"),
    "binding_table": ("TABLE $wanted MATCH (r:Region {r_regionkey: id}) RETURN r.r_name AS name, w", "SELECT r_name AS name, w FROM region JOIN (VALUES (1, 1.5), (3, 2.0)) t(id, w) ON id = r_regionkey"),
    "sort_nulls": ("FOR n IN [2, NULL, 1] RETURN n ORDER BY n LIMIT 2", "SELECT unnest([1, 2])::BIGINT AS n"),
    "page_then_sort": ("MATCH (n:Nation) ORDER BY n.n_name OFFSET 20 RETURN n.n_name AS name ORDER BY name DESC LIMIT 3", "SELECT n_name AS name FROM nation ORDER BY 1 DESC LIMIT 3"),
    "sort_survives_let": ("MATCH (n:Nation) ORDER BY n.n_name DESC LET k = n.n_nationkey * 2 FOR x IN [k] RETURN x LIMIT 3", "SELECT n_nationkey::BIGINT * 2 AS x FROM nation ORDER BY n_name DESC LIMIT 3"),
    "sort_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS segment ORDER BY c.c_mktsegment DESC LIMIT 2", "SELECT DISTINCT c_mktsegment AS segment FROM customer ORDER BY 1 DESC LIMIT 2"),
    "sort_aggregate": ("MATCH (c:Customer) RETURN c.c_mktsegment AS segment, COUNT(*) AS n GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 2", "SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2"),
    "top_k": ("MATCH (o:SalesOrder) RETURN o.o_orderkey AS k, o.o_totalprice AS price ORDER BY price DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY 2 DESC, 1 LIMIT 10"),
    "exp_int_div": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 7 AS d, -p.p_size / 7 AS m", "SELECT p_partkey AS k, (p_size // 7)::BIGINT AS d, trunc(-p_size / 7.0)::BIGINT AS m FROM part"),
    "exp_exact_compare": ("FOR x IN [9007199254740992, 9007199254740993] LET y = 9007199254740992.0 RETURN x, x = y AS same, x > y AS more", "SELECT * FROM (VALUES (9007199254740992, true, false), (9007199254740993, false, true)) t(x, same, more)"),
    "exp_list_compare": ("RETURN [1, 2] < [1, 3] AS a, [1] < [1, 2] AS b, [1, NULL] = [1, 2] AS c, [2, NULL] > [1, 2] AS d", "SELECT true AS a, true AS b, NULL::BOOLEAN AS c, true AS d"),
    "exp_coalesce": ("MATCH (n:Party) RETURN COALESCE(n.c_name, n.s_name) AS name, NULLIF(n.s_suppkey, 1) AS k", "SELECT c_name AS name, NULL::BIGINT AS k FROM customer UNION ALL SELECT s_name, nullif(s_suppkey, 1) FROM supplier"),
    "exp_element_id": ("MATCH (r:Region) RETURN ELEMENT_ID(r) AS id, r.r_name AS name", "SELECT 'g3:n:' || (r_regionkey + 1000000000000) AS id, r_name AS name FROM region"),
    "exp_literals": ("RETURN 0x1F AS a, 0o17 AS b, 0b101 AS c, 1_000 AS d, 1.5e2 AS e, 'it''s' AS f, @'a\\b' AS g", "SELECT 31::BIGINT AS a, 15::BIGINT AS b, 5::BIGINT AS c, 1000::BIGINT AS d, 150.0::DOUBLE AS e, 'it''s' AS f, 'a\\b' AS g"),
    "exp_parameters": ("FOR x IN $names MATCH (r:Region {r_name: x}) RETURN r.r_name AS name, $n + 1 AS n", "SELECT r_name AS name, 3::BIGINT AS n FROM region WHERE r_name IN ('ASIA', 'EUROPE')"),
    "exp_logic": ("FOR x IN [TRUE, FALSE, NULL] RETURN x AND NULL AS a, x OR NULL AS b, x XOR TRUE AS c, NOT x AS d", "SELECT x AND NULL AS a, x OR NULL AS b, x <> true AS c, NOT x AS d FROM (SELECT unnest([true, false, NULL]) AS x)"),
    "exp_mixed_widening:b": ("MATCH (n:Party) RETURN n.balance + 0.5 AS b", "SELECT c_acctbal + 0.5 AS b FROM customer UNION ALL SELECT trunc(s_acctbal) + 0.5 FROM supplier"),
    "mut_insert_return": ("MATCH (r:Region) INSERT (r)<-[:OFFICE_IN]-(o:Office {no: r.r_regionkey + 1}) RETURN o.no AS no, r.r_name AS region", "SELECT r_regionkey::BIGINT + 1 AS no, r_name AS region FROM region"),
    "mut_set_return": ("MATCH (r:Region) WHERE r.r_regionkey > 2 SET r.r_name = 'X' || r.r_name, r IS Far RETURN r.r_name AS name, r IS LABELED Far AS far", "SELECT 'X' || r_name AS name, true AS far FROM region WHERE r_regionkey > 2"),
    "mut_remove": ("MATCH (n:Nation) WHERE n.n_nationkey < 5 REMOVE n.n_name RETURN PROPERTY_EXISTS(n, n_name) AS has, COUNT(*) AS n GROUP BY has", "SELECT false AS has, COUNT(*) AS n FROM nation WHERE n_nationkey < 5"),
    "mut_delete_count": ("MATCH (r:Region) WHERE r.r_regionkey < 2 DETACH DELETE r MATCH (k:Region) RETURN COUNT(*) AS n", "SELECT (SELECT COUNT(*) FROM region WHERE r_regionkey < 2) * (SELECT COUNT(*) FROM region WHERE r_regionkey >= 2) AS n"),
}

_PARAMETERS = {"wanted": [{"id": 1, "w": 1.5}, {"id": 3, "w": 2}], "n": 2, "names": ["ASIA", "EUROPE"]}


def _runner(text: str, rounded: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources.tables import session_over

        df = session_over(spark, sf_dir, **_PARAMETERS).execute(text).df
        return df.withColumns({c: F.round(c, 4) for c in rounded}) if rounded else df

    run.__doc__ = text
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for key, (text, _) in WORKLOAD.items():
        name, _, columns = key.partition(":")
        out[name] = _runner(text, [c for c in columns.split(",") if c])
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, (_, sql) in WORKLOAD.items():
        name, _, columns = key.partition(":")
        rounds = ", ".join(f"round({c}, 4) AS {c}" for c in columns.split(",") if c)
        out[name] = f"SELECT * REPLACE ({rounds}) FROM ({sql})" if rounds else sql
    return out
