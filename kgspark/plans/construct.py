"""Building a graph from a corpus, from model answers, or from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import EXTRACTION, parsed
from kgspark.operators.projections import chunked
from kgspark.operators.relational import first_seen
from kgspark.providers import LanguageModel
from kgspark.sources.graphs import Graph, numbered


def extraction_prompts(chunks: DataFrame, ontology: str, template: str = "Ontology: {schema}\nText: {chunk}") -> DataFrame:
    """(call_id, kind, prompt, chunk text) for each chunk."""
    head, _, tail = template.partition("{chunk}")
    prompt = F.concat(F.lit(head.replace("{schema}", ontology)), F.col("text"), F.lit(tail.replace("{schema}", ontology)))
    return chunks.select(F.col("chunk_id").alias("call_id"), F.lit("extraction").alias("kind"), prompt.alias("prompt"), "text")


def extracted(answers: DataFrame) -> DataFrame:
    """(chunk_id, attributes, triples, entity_types, new_schema_types) of answers; those that can't be read go."""
    rows = answers.select(F.col("call_id").alias("chunk_id"), parsed("response", EXTRACTION).alias("x"))
    return rows.where("x.attributes is not null or x.triples is not null").select("chunk_id", "x.*")


def graph_of_extractions(records: DataFrame) -> Graph:
    """Entities by exact name (first chunk and type count), an attribute node for each mention, and edges.

    Triples of more than three parts are cut, shorter ones dropped.
    """
    t = records.select("chunk_id", "entity_types", F.posexplode("triples").alias("pos", "t")).where("size(t) >= 3")
    triples = t.select("chunk_id", "entity_types", "pos", F.trim(F.col("t")[0]).alias("s"), F.col("t")[1].alias("relation"), F.trim(F.col("t")[2]).alias("o"))
    a = records.select("chunk_id", "entity_types", F.explode("attributes").alias("entity", "values"))
    attrs = a.select("chunk_id", "entity_types", F.trim("entity").alias("entity"), F.posexplode("values").alias("pos", "value"))
    named = triples.select("chunk_id", "entity_types", "pos", F.col("s").alias("name")).union(triples.select("chunk_id", "entity_types", "pos", "o")).union(attrs.select("chunk_id", "entity_types", "pos", "entity"))
    seq = F.struct("chunk_id", "pos")
    ents = named.groupBy("name").agg(F.min_by("chunk_id", seq).alias("chunk_id"), F.min_by(F.col("entity_types")[F.col("name")], seq).alias("schema_type"))
    ents = numbered(ents, "number", "name").withColumn("node_id", F.concat(F.lit("entity_"), F.col("number").cast("string")))
    values = numbered(attrs.select("chunk_id", "entity", "pos", "value"), "number", "chunk_id", "entity", "pos").withColumn("node_id", F.concat(F.lit("attribute_"), F.col("number").cast("string")))
    text = lambda c: F.lit(c).cast("string")
    row = lambda df, label, level, name, kind: df.select(
        "node_id", F.lit(label).alias("label"), F.lit(level).alias("level"), name.alias("name"), text(None).alias("description"), kind.alias("schema_type"), F.array("chunk_id").alias("chunk_ids"),
        F.lit(None).cast("array<string>").alias("members"), text(None).alias("node_role"), text(None).alias("alias_of"),
        F.map_filter(F.create_map(F.lit("name"), name, F.lit("chunk id"), F.col("chunk_id"), F.lit("schema_type"), kind), lambda k, v: v.isNotNull()).alias("props"),
    )
    nodes = row(ents, "entity", 2, F.col("name"), F.col("schema_type")).unionByName(row(values, "attribute", 1, F.col("value"), text(None)))
    key = ents.select("name", F.col("node_id").alias("id"))
    e = triples.join(key.select(F.col("name").alias("s"), F.col("id").alias("src")), "s").join(key.select(F.col("name").alias("o"), F.col("id").alias("dst")), "o")
    has = values.join(key.select(F.col("name").alias("entity"), F.col("id").alias("src")), "entity").select("src", F.col("node_id").alias("dst"), F.lit("has_attribute").alias("relation"), "chunk_id", "pos")
    edges = numbered(e.select("src", "dst", "relation", "chunk_id", "pos").unionByName(has), "edge_id", "chunk_id", "relation", "pos", "src", "dst")
    return Graph(nodes, edges.select("edge_id", "src", "dst", "relation", F.array("chunk_id").alias("source_chunks")))


def build(docs: DataFrame, model: LanguageModel, ontology: str = "") -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, chunks, failed calls): one extraction a document, exact triple dedup; failures are set aside."""
    chunks = chunked(docs)
    answers = model.complete(extraction_prompts(chunks, ontology))
    failed = answers.where("error is not null")
    g = graph_of_extractions(extracted(answers.where("error is null")))
    return Graph(g.nodes, first_seen(g.edges, "src", "dst", "relation")), chunks, failed


def hashed_id(*parts):
    """A 60-bit id of a row's own values, for tables without a key of their own."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def graph_of_tables(t: dict[str, DataFrame]) -> Graph:
    """Orders, customers, parts and places as a graph: located_in, part_of, placed_by, contains, supplied_by and
    has_attribute edges. Edge ids are built from the rows' own keys, so that nothing has to be counted."""
    key = lambda label, c: F.concat(F.lit(f"{label}_"), F.col(c).cast("string"))
    text = lambda c: F.lit(c).cast("string")

    def nodes(df: DataFrame, label: str, level: int, ident, name, kind: str, **props) -> DataFrame:
        pairs = [x for k, c in {"name": name, **props}.items() for x in (F.lit(k), c.cast("string"))]
        return df.select(
            ident.alias("node_id"), F.lit(label).alias("label"), F.lit(level).alias("level"), name.alias("name"), text(None).alias("description"), F.lit(kind).cast("string").alias("schema_type"),
            F.array().cast("array<string>").alias("chunk_ids"), F.lit(None).cast("array<string>").alias("members"), text(None).alias("node_role"), text(None).alias("alias_of"),
            F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("props"),
        )

    every = [
        nodes(t["region"], "community", 4, key("region", "r_regionkey"), F.col("r_name"), "region"),
        nodes(t["nation"], "entity", 2, key("nation", "n_nationkey"), F.col("n_name"), "nation"),
        nodes(t["customer"], "entity", 2, key("customer", "c_custkey"), F.col("c_name"), "customer", segment=F.col("c_mktsegment")),
        nodes(t["supplier"], "entity", 2, key("supplier", "s_suppkey"), F.col("s_name"), "supplier"),
        nodes(t["part"], "entity", 2, key("part", "p_partkey"), F.col("p_name"), "part", brand=F.col("p_brand"), type=F.col("p_type")),
        nodes(t["orders"], "entity", 2, key("order", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), None, priority=F.col("o_orderpriority")),
        nodes(t["customer"].select("c_mktsegment").distinct(), "attribute", 1, key("segment", "c_mktsegment"), F.col("c_mktsegment"), None),
        nodes(t["part"].select("p_brand").distinct(), "keyword", 3, key("brand", "p_brand"), F.col("p_brand"), None),
    ]
    n = every[0]
    for x in every[1:]:
        n = n.unionByName(x)
    edge = lambda df, kind, ident, src, dst, relation: df.select((F.lit(kind).cast("long") * F.lit(1 << 58) + ident).cast("long").alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))
    line = lambda kind: hashed_id(F.lit(kind), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edges = [
        edge(t["nation"], 1, F.col("n_nationkey"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "part_of"),
        edge(t["customer"], 2, F.col("c_custkey"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "located_in"),
        edge(t["supplier"], 3, F.col("s_suppkey"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "located_in"),
        edge(t["orders"], 4, F.col("o_orderkey"), key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
        edge(t["lineitem"], 0, line(5), key("order", "l_orderkey"), key("part", "l_partkey"), "contains"),
        edge(t["lineitem"], 0, line(6), key("part", "l_partkey"), key("supplier", "l_suppkey"), "supplied_by"),
        edge(t["customer"], 7, F.col("c_custkey"), key("customer", "c_custkey"), key("segment", "c_mktsegment"), "has_attribute"),
        edge(t["part"], 8, F.col("p_partkey"), key("part", "p_partkey"), key("brand", "p_brand"), "represented_by"),
    ]
    e = edges[0]
    for x in edges[1:]:
        e = e.union(x)
    return Graph(n, e.withColumn("source_chunks", F.array().cast("array<string>")))
