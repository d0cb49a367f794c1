"""Graph queries: an order is an edge with suppliers as agents, its customer as input and its parts as outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import dealt, table
from ._book import Book

BOOK = Book()
_MEMBERS = """m AS (SELECT DISTINCT l_orderkey AS edge_id, 'agent' AS role, 's' || l_suppkey AS node_id, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT DISTINCT l_orderkey, 'output', 'p' || l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT o_orderkey, 'input', 'c' || o_custkey, o_orderdate FROM orders)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    size = lines.count() + orders.count()  # an order and its lines are dealt alike: its edge, members and pairs arise in one part
    lines = dealt(lines.select("l_orderkey", "l_suppkey", "l_partkey"), size, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("agents"), F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("outputs"))
    orders = dealt(orders.select("o_orderkey", "o_orderdate", "o_custkey"), size, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    return orders.select(F.col("o_orderkey").alias("id"), F.lit("Production").alias("edge_type"), F.col("o_orderdate").alias("ts"), F.coalesce("agents", none).alias("agents"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("inputs"), F.coalesce("outputs", none).alias("outputs"), none.alias("context"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return G.membership(_edges(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id")
    s = table(spark, d, "supplier").select(name("s", "s_suppkey"), F.lit("Organization").alias("type"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(name("c", "c_custkey"), F.lit("Person").alias("type"), F.col("c_name").alias("name"))
    p = table(spark, d, "part").select(name("p", "p_partkey"), F.lit("Resource").alias("type"), F.col("p_name").alias("name"))
    return s.union(c).union(p)


_NODES = "nodes AS (SELECT 's' || s_suppkey AS id, 'Organization' AS type, s_name AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'Person', c_name FROM customer UNION ALL SELECT 'p' || p_partkey, 'Resource', p_name FROM part)"


def _via(role: str, other: str, extra: str = "") -> str:
    where = f"a.role = '{role}' AND " if role else ""
    return f"WITH {_MEMBERS} SELECT DISTINCT a.node_id AS source, b.node_id AS target FROM m a JOIN m b ON a.edge_id = b.edge_id WHERE {where}b.role = '{other}' {extra}"


@BOOK.add(_via("agent", "agent", "AND a.node_id <> b.node_id"))
def graph_collaborators(spark: SparkSession, d: str) -> DataFrame:
    return G.collaborators(_members(spark, d))


@BOOK.add(_via("agent", "output"))
def graph_outputs(spark: SparkSession, d: str) -> DataFrame:
    return G.outputs_of(_members(spark, d))


@BOOK.add(_via("output", "input"))
def graph_inputs(spark: SparkSession, d: str) -> DataFrame:
    return G.inputs_for(_members(spark, d))


@BOOK.add(_via("", "agent", "AND a.node_id <> b.node_id"))
def graph_who_worked_with(spark: SparkSession, d: str) -> DataFrame:
    return G.who_worked_with(_members(spark, d))


def _one(question: str, node: str, role: str, other: str, extra: str = "") -> str:
    where = f"a.role = '{role}' AND " if role else ""
    return f"SELECT DISTINCT '{question}' AS question, b.node_id AS target FROM m a JOIN m b ON a.edge_id = b.edge_id WHERE {where}a.node_id = '{node}' AND b.role = '{other}' {extra}"


_APART = "AND a.node_id <> b.node_id"


@BOOK.add(f"WITH {_MEMBERS} {_one('collaborators', 's3', 'agent', 'agent', _APART)} UNION ALL {_one('outputs', 's3', 'agent', 'output')} UNION ALL {_one('inputs', 's3', 'output', 'input')} UNION ALL {_one('worked_with', 's3', '', 'agent', _APART)}")
def graph_about_agent(spark: SparkSession, d: str) -> DataFrame:
    """All questions about one agent: only its edges are joined."""
    return G.about(_members(spark, d), "s3")


@BOOK.add(f"WITH {_MEMBERS} {_one('collaborators', 'p5', 'agent', 'agent', _APART)} UNION ALL {_one('outputs', 'p5', 'agent', 'output')} UNION ALL {_one('inputs', 'p5', 'output', 'input')} UNION ALL {_one('worked_with', 'p5', '', 'agent', _APART)}")
def graph_about_output(spark: SparkSession, d: str) -> DataFrame:
    """All questions about one node that edges produced."""
    return G.about(_members(spark, d), "p5")


@BOOK.add(f"WITH {_MEMBERS} SELECT node_id, count(DISTINCT edge_id) AS n_edges FROM m GROUP BY node_id")
def graph_incidence(spark: SparkSession, d: str) -> DataFrame:
    return G.incident_edges(_members(spark, d)).groupBy("node_id").agg(F.count("*").alias("n_edges"))


@BOOK.add(f"WITH {_MEMBERS} SELECT node_id, min(ts) AS first_seen, max(ts) AS last_seen FROM m GROUP BY node_id")
def graph_lifetime(spark: SparkSession, d: str) -> DataFrame:
    return G.lifetime(_members(spark, d))


@BOOK.add(f"WITH {_MEMBERS} SELECT node_id, count(*) FILTER (role = 'agent') AS as_agent, count(*) FILTER (role = 'input') AS as_input, count(*) FILTER (role = 'output') AS as_output FROM m GROUP BY node_id")
def graph_reuse_count(spark: SparkSession, d: str) -> DataFrame:
    return G.reuse_counts(_members(spark, d))


@BOOK.add("SELECT o_orderkey AS id, o_orderdate AS ts FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def graph_edges_in_range(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_in_range(_edges(spark, d), "1997-01-01", "1997-03-31").select("id", "ts")


@BOOK.add(f"WITH {_MEMBERS}, {_NODES} SELECT id, type, name FROM nodes WHERE id IN (SELECT node_id FROM m WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31')")
def graph_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(_nodes(spark, d), _members(spark, d), "1997-01-01", "1997-03-31")[0]


_FLOW = """m AS (SELECT 'p' || l_partkey AS node_id, CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'output' END AS role, l_shipdate AS ts FROM lineitem),
    o AS (SELECT node_id, max(ts) AS last_output FROM m WHERE role = 'output' GROUP BY 1), i AS (SELECT node_id, max(ts) AS last_input FROM m WHERE role = 'input' GROUP BY 1),
    t AS (SELECT node_id, last_output FROM o LEFT JOIN i USING (node_id) WHERE last_input IS NULL OR last_input <= last_output)"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node_id"), F.when(F.col("l_returnflag") == "R", "input").otherwise("output").alias("role"), F.col("l_shipdate").alias("ts"))


@BOOK.add(f"WITH {_FLOW} SELECT * FROM t")
def graph_terminal_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.terminal_nodes(_flow(spark, d))


@BOOK.add(f"WITH {_FLOW}, {_NODES}, r AS (SELECT type, id, name, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM t JOIN nodes ON node_id = id) SELECT type, count(*) AS n, list(name ORDER BY k) FILTER (k <= 5) AS examples FROM r GROUP BY type")
def graph_terminal_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.terminal_summary(_nodes(spark, d), G.terminal_nodes(_flow(spark, d)))


@BOOK.add(f"WITH {_NODES}, k(kind) AS (SELECT unnest([{', '.join(repr(t) for t in G.NODE_TYPES)}])) SELECT kind, count(id) AS n FROM k LEFT JOIN nodes ON kind = type GROUP BY kind")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.type_statistics(_nodes(spark, d), "type", G.NODE_TYPES)


@BOOK.add(f"WITH {_MEMBERS}, p AS (SELECT a.node_id AS a, b.node_id AS b, count(*) AS n FROM m a JOIN m b ON a.edge_id = b.edge_id AND a.role = 'agent' AND b.role = 'agent' AND a.node_id < b.node_id GROUP BY 1, 2) SELECT a, b, n, least(n / 10.0, 1.0)::DOUBLE AS confidence FROM p WHERE n >= 3")
def coauthor_strength(spark: SparkSession, d: str) -> DataFrame:
    return G.co_occurrence(_members(spark, d))


@BOOK.add("WITH b AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS t FROM lineitem) SELECT x.node AS a, y.node AS b, count(*) AS shared FROM b x JOIN b y ON x.t = y.t AND x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_topics_ge2(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_attributes(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@BOOK.add(f"WITH {_NODES} SELECT id, type, name FROM nodes WHERE contains(lower(name), 'gear') OR contains(lower(id), 'gear') ORDER BY id LIMIT 20")
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    return G.node_search(_nodes(spark, d), "Gear")


@BOOK.add(f"WITH {_MEMBERS} SELECT edge_id, list_sort(list(DISTINCT node_id)) AS nodes, list_sort(list(DISTINCT node_id) FILTER (role IN ('agent', 'input'))) AS sources FROM m GROUP BY edge_id")
def edge_node_sets(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return edges.select(F.col("id").alias("edge_id"), G.all_nodes(F.col("agents"), F.col("inputs"), F.col("outputs"), F.col("context")).alias("nodes"), F.array_sort(F.array_union("agents", "inputs")).alias("sources"))


@BOOK.add("SELECT o_custkey AS id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return G.upsert(log, "id", "seq")


@BOOK.add("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def graph_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return G.from_json(G.to_json(rows), "s_suppkey long, s_name string, s_nationkey int")
