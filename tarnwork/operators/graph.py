"""Directed temporal hypergraph over two tables.

``nodes(id, type, name)`` and ``membership(edge_id, edge_type, ts, role, node_id)`` with
roles agent, input, output and context.  Every structural query is an equi-join of the
membership with itself on the edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt

ROLES = ("agent", "input", "output", "context")
#: The kinds of nodes and edges that statistics list even without members.
NODE_TYPES = ("Person", "Organization", "Project", "Document", "Dataset", "Model", "Resource", "Topic", "Event", "Tool")
EDGE_TYPES = ("Production", "Collaboration", "Usage", "Ownership", "Citation", "Funding", "Affiliation", "Derivation")


def membership(edges: DataFrame) -> DataFrame:
    """One row per (edge, role, node) of ``edges(id, edge_type, ts, agents, inputs, outputs, context)``."""
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(column).alias("nodes")) for role, column in zip(ROLES, ("agents", "inputs", "outputs", "context"), strict=True)])
    rows = edges.select(F.col("id").alias("edge_id"), "edge_type", "ts", F.explode(roles).alias("r"))
    return rows.select("edge_id", "edge_type", "ts", "r.role", F.explode(F.array_distinct("r.nodes")).alias("node_id"))


def all_nodes(agents: Column, inputs: Column, outputs: Column, context: Column) -> Column:
    return F.array_sort(F.array_union(F.array_union(agents, inputs), F.array_union(outputs, context)))


def _via(members: DataFrame, of: Column, other_roles: tuple[str, ...], node: str | None = None) -> DataFrame:
    """Pairs of nodes of one edge, the first in the roles ``of``; of one ``node`` only its own edges are joined, so the rows that
    arise grow with those edges' members and not with the square of any."""
    mine = members.where(of) if node is None else members.where(of & (F.col("node_id") == node))
    mine = mine.select("edge_id", F.col("node_id").alias("source")).distinct()
    theirs = members.where(F.col("role").isin(*other_roles)).select("edge_id", F.col("node_id").alias("target"))
    return mine.join(theirs, "edge_id").select("source", "target").distinct()


def collaborators(members: DataFrame, node: str | None = None) -> DataFrame:
    """Pairs of agents of one edge, without oneself; all of them, or those of one node."""
    return _via(members, F.col("role") == "agent", ("agent",), node).where("source <> target")


def outputs_of(members: DataFrame, node: str | None = None) -> DataFrame:
    """What an agent's edges produced."""
    return _via(members, F.col("role") == "agent", ("output",), node)


def inputs_for(members: DataFrame, node: str | None = None) -> DataFrame:
    """What went into the edges that have a node as output."""
    return _via(members, F.col("role") == "output", ("input",), node)


def who_worked_with(members: DataFrame, node: str | None = None) -> DataFrame:
    """Agents of the edges that a node has any part in."""
    return _via(members, F.lit(True), ("agent",), node).where("source <> target")


def about(members: DataFrame, node: str) -> DataFrame:
    """``(question, target)``: the four questions asked of one node."""
    asked = (("collaborators", collaborators), ("outputs", outputs_of), ("inputs", inputs_for), ("worked_with", who_worked_with))
    parts = [f(members, node).select(F.lit(name).alias("question"), "target") for name, f in asked]
    return reduce(DataFrame.unionByName, parts)


def incident_edges(members: DataFrame) -> DataFrame:
    return members.select("node_id", "edge_id", "edge_type", "ts").distinct()


def edges_in_range(edges: DataFrame, start, end) -> DataFrame:
    """Closed interval; edges without a time are not in any."""
    return edges.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def subgraph(nodes: DataFrame, members: DataFrame, start, end) -> tuple[DataFrame, DataFrame]:
    """The memberships of the edges in a time range and the nodes they have."""
    part = edges_in_range(members, start, end)
    return nodes.join(part.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi"), part


def lifetime(members: DataFrame) -> DataFrame:
    return members.groupBy("node_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def reuse_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("node_id").agg(*[F.count_if(F.col("role") == r).alias(f"as_{r}") for r in ROLES[:3]])


def terminal_nodes(members: DataFrame) -> DataFrame:
    """Outputs that no edge takes as input strictly after they were last put out; edges without a time don't count."""
    timed = members.where("ts is not null")
    last = timed.where("role = 'output'").groupBy("node_id").agg(F.max("ts").alias("last_output"))
    used = timed.where("role = 'input'").groupBy("node_id").agg(F.max("ts").alias("last_input"))
    return last.join(used, "node_id", "left").where("last_input is null or last_input <= last_output").select("node_id", "last_output")


def terminal_summary(nodes: DataFrame, terminal: DataFrame, examples: int = 5) -> DataFrame:
    """Terminal nodes per type with the first few names, by smallest ids."""
    from pyspark.sql import Window

    rows = terminal.join(nodes, terminal["node_id"] == nodes["id"]).select("type", "id", "name")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(F.col("k") <= examples)
    few = ranked.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("examples"))
    return rows.groupBy("type").agg(F.count("*").alias("n")).join(few, "type")


def type_statistics(rows: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """Counts by type, also of types without rows."""
    wanted = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    found = rows.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"))
    return wanted.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def co_occurrence(members: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of agents with the number of shared edges and a confidence of a tenth per edge, at most 1."""
    agents = members.where("role = 'agent'").select("edge_id", "node_id").distinct()
    pairs = agents.toDF("edge_id", "a").join(agents.toDF("edge_id", "b"), "edge_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("confidence", F.least(F.col("n") / 10.0, F.lit(1.0)))


def shared_attributes(rows: DataFrame, node: str, attribute: str, least: int = 2) -> DataFrame:
    """Pairs of nodes that share at least ``least`` distinct attributes.  An attribute's nodes are together from the start, in
    parts of so many rows that the pairs counted in one stay few whatever the table."""
    base = dealt(rows.select(F.col(node).alias("node"), F.col(attribute).alias("attribute")), rows.count(), "attribute").distinct()
    pairs = base.toDF("a", "attribute").join(base.toDF("b", "attribute"), "attribute").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def node_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    low = query.lower()
    return nodes.where(F.lower("name").contains(low) | F.lower(F.col("id").cast("string")).contains(low)).orderBy("id").limit(limit)


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Nodes or edges of an append log, last one of each id."""
    from .registry import last_wins

    return last_wins(rows, key, order)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*")
