"""Graphs from and to JSON relationship lists, GraphML-like XML and Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.schemas import LEVELS, NODES, TRIPLES


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def level_of(label: Column) -> Column:
    out = F.lit(2)
    for name, level in LEVELS.items():
        out = F.when(label == name, level).otherwise(out)
    return out


def numbered(df: DataFrame, column: str, *order: str) -> DataFrame:
    """df with dense numbers from 0 in the given order: counts of range partitions first, then numbers within
    each, so that no task sees all rows."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order)
    ranged = ranged.withColumn("_in", F.row_number().over(w) - 1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left")
    before = before.groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def _chunk_ids(props: Column) -> Column:
    """`chunk id` as an array: a JSON list, a comma list or one id."""
    raw = props["chunk id"]
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    return F.filter(F.coalesce(listed, F.split(raw, r",\s*"), F.array().cast("array<string>")), lambda x: x != "")


def graph_of(triples: DataFrame) -> Graph:
    """Nodes and edges of a relationship list (start_node, relation, end_node).

    A node is its (label, name); the first mention gives the properties, start before end, and ids count
    first mentions: `label_number`. Every row is an edge, parallel ones included.
    """
    rows = triples.withColumn("edge_id", F.monotonically_increasing_id())
    rows = numbered(rows.withColumnRenamed("edge_id", "_at"), "edge_id", "_at").drop("_at")
    ends = rows.select((F.col("edge_id") * 2).alias("seq"), F.col("start_node").alias("n")).union(rows.select((F.col("edge_id") * 2 + 1).alias("seq"), F.col("end_node").alias("n")))
    named = ends.select("seq", F.col("n.label").alias("label"), F.coalesce(F.col("n.properties")["name"], F.lit("")).alias("name"), F.col("n.properties").alias("props"))
    first = named.groupBy("label", "name").agg(F.min("seq").alias("seq"), F.min_by("props", "seq").alias("props"))
    first = numbered(first, "number", "seq")
    none = F.lit(None).cast("string")
    members = F.from_json(F.col("props")["members"], "array<string>")
    nodes = first.select(
        F.concat_ws("_", "label", F.col("number").cast("string")).alias("node_id"), "label", level_of(F.col("label")).alias("level"), "name",
        F.col("props")["description"].alias("description"), F.col("props")["schema_type"].alias("schema_type"), _chunk_ids(F.col("props")).alias("chunk_ids"),
        members.alias("members"), F.coalesce(F.col("props")["node_role"], none).alias("node_role"), F.coalesce(F.col("props")["alias_of"], none).alias("alias_of"), "props",
    )
    key = nodes.select("label", "name", "node_id")
    src = key.select(F.col("label").alias("_sl"), F.col("name").alias("_sn"), F.col("node_id").alias("src"))
    dst = key.select(F.col("label").alias("_dl"), F.col("name").alias("_dn"), F.col("node_id").alias("dst"))
    named_end = lambda e: F.coalesce(F.col(f"{e}.properties")["name"], F.lit(""))
    edges = rows.join(src, F.col("start_node.label").eqNullSafe(F.col("_sl")) & (named_end("start_node") == F.col("_sn")))
    edges = edges.join(dst, F.col("end_node.label").eqNullSafe(F.col("_dl")) & (named_end("end_node") == F.col("_dn")))
    return Graph(nodes, edges.select("edge_id", "src", "dst", "relation", F.array().cast("array<string>").alias("source_chunks")))


def triples_of(graph: Graph) -> DataFrame:
    """The relationship list of a graph, one row for each edge in order; isolated nodes and edge attributes are lost."""
    end = graph.nodes.select("node_id", F.struct("label", F.map_filter(F.map_concat(F.map_from_arrays(F.array(F.lit("name")), F.array("name")), F.map_filter("props", lambda k, v: k != "name")), lambda k, v: v.isNotNull()).alias("properties")).alias("n"))
    rows = graph.edges.join(end.select(F.col("node_id").alias("src"), F.col("n").alias("start_node")), "src").join(end.select(F.col("node_id").alias("dst"), F.col("n").alias("end_node")), "dst")
    return rows.select("edge_id", "start_node", "relation", "end_node")


def load_json(spark: SparkSession, path: str) -> Graph:
    """A relationship list, or a row on each line as save_json() writes them."""
    from kgspark.sources.texts import is_whole

    return graph_of(spark.read.schema(TRIPLES).json(path, multiLine=is_whole(spark, path)))


def save_json(graph: Graph, path: str) -> None:
    triples_of(graph).orderBy("edge_id").drop("edge_id").write.mode("overwrite").json(path)


def load_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def save_parquet(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


_XML_NODE = "_id string, data array<struct<_key:string,_VALUE:string>>"
_XML_EDGE = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"


def _data(key: str) -> Column:
    return F.filter("data", lambda d: d["_key"] == key)[0]["_VALUE"]


def load_graphml(spark: SparkSession, path: str) -> Graph:
    """Older files: d0 label, d1 properties as JSON, d2 level; d3 relation of an edge. Properties that are no
    JSON become the name, a level that is no number 2, and quotes around a relation go."""
    files = spark.read.format("xml").option("recursiveFileLookup", "true")
    n = files.option("rowTag", "node").schema(_XML_NODE).load(path)
    parsed = F.from_json(_data("d1"), "map<string,string>")
    props = F.coalesce(parsed, F.create_map(F.lit("name"), _data("d1")))
    rows = n.select(F.col("_id").alias("node_id"), _data("d0").alias("label"), F.coalesce(_data("d2").try_cast("int"), F.lit(2)).alias("level"), props.alias("props"))
    none = F.lit(None).cast("string")
    nodes = rows.select("node_id", "label", "level", F.col("props")["name"].alias("name"), F.col("props")["description"].alias("description"), F.col("props")["schema_type"].alias("schema_type"), _chunk_ids(F.col("props")).alias("chunk_ids"), F.from_json(F.col("props")["members"], "array<string>").alias("members"), none.alias("node_role"), none.alias("alias_of"), "props")
    e = spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", "edge").schema(_XML_EDGE).load(path)
    edges = e.select(F.monotonically_increasing_id().alias("edge_id"), F.col("_source").alias("src"), F.col("_target").alias("dst"), F.trim(F.regexp_replace(_data("d3"), r'^"+|"+$', "")).alias("relation"), F.array().cast("array<string>").alias("source_chunks"))
    return Graph(nodes, edges)


def save_graphml(graph: Graph, path: str) -> None:
    """Nodes and edges as XML rows below path/nodes and path/edges, properties as JSON."""
    item = lambda key, value: F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_VALUE"))
    nodes = graph.nodes.select(F.col("node_id").alias("_id"), F.array(item("d0", F.col("label")), item("d1", F.to_json("props")), item("d2", F.col("level"))).alias("data"))
    nodes.write.mode("overwrite").format("xml").option("rowTag", "node").option("rootTag", "graph").save(f"{path}/nodes")
    edges = graph.edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.array(item("d3", F.col("relation"))).alias("data"))
    edges.write.mode("overwrite").format("xml").option("rowTag", "edge").option("rootTag", "graph").save(f"{path}/edges")


def load(spark: SparkSession, path: str) -> Graph:
    if path.endswith(".json"):
        return load_json(spark, path)
    if path.endswith(".graphml"):
        return load_graphml(spark, path)
    if path.endswith(".parquet"):
        return load_parquet(spark, path)
    raise ValueError(f"unknown graph format: {path}")


def save(graph: Graph, path: str) -> None:
    if path.endswith(".json"):
        save_json(graph, path)
    elif path.endswith(".graphml"):
        save_graphml(graph, path)
    elif path.endswith(".parquet"):
        save_parquet(graph, path)
    else:
        raise ValueError(f"unknown graph format: {path}")


def empty(spark: SparkSession) -> Graph:
    from kgspark.schemas import EDGES

    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
