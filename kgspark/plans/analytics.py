"""Statistics of graphs and dedup runs, and data for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_labels_and_relations(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(kind, name, n): nodes by label, and the k most frequent relations."""
    n = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    e = edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(k)
    return n.union(e.select(F.lit("relation"), "relation", "n"))


def interchange_stats(groups: DataFrame) -> DataFrame:
    """(groups, clusters, members, relations, labels) of dedup groups."""
    rows = groups.select("relation", F.col("head_node.label").alias("label"), F.map_values("dedup_results").alias("c"))
    sizes = F.transform("c", lambda c: F.size(c["member"]))
    return rows.agg(F.count("*").alias("groups"), F.sum(F.size("c")).alias("clusters"), F.sum(F.aggregate(sizes, F.lit(0), lambda s, x: s + x)).alias("members"), F.count_distinct("relation").alias("relations"), F.count_distinct("label").alias("labels"))


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """One row on clusters (cluster_id, size): how much merges, how large they are, and what looks wrong."""
    c = clusters.agg(
        F.count("*").alias("clusters"), F.sum("size").alias("candidates"), F.sum(F.col("size") - 1).alias("merged"), F.count_if(F.col("size") == 1).alias("single"),
        F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"),
    )
    rate, single = F.col("merged") / F.col("candidates"), F.col("single") / F.col("clusters")
    notes = F.array_compact(F.array(F.when(single > 0.7, F.lit("mostly single")), F.when(rate < 0.05, F.lit("merges little")), F.when(rate > 0.5, F.lit("merges much"))))
    return c.withColumn("dedup_rate", rate).withColumn("single_share", single).withColumn("notes", F.concat_ws("; ", notes))


def run_stats(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(candidates, merges, aliases, main, reduction_rate) of a head dedup with (dup, canon, method)."""
    total = nodes.where("label = 'entity'").agg(F.count("*").alias("candidates"))
    m = mapping.agg(F.count("*").alias("merges"), F.count_if(F.col("method") == "exact").alias("exact"), F.count_if(F.col("method") == "semantic").alias("semantic"), F.count_distinct("canon").alias("representatives"))
    out = total.crossJoin(m)
    return out.withColumn("main", F.col("candidates") - F.col("merges")).withColumn("reduction_rate", F.when(F.col("candidates") > 0, 100.0 * F.col("merges") / F.col("candidates")).otherwise(0.0))


def merge_frequency(mapping: DataFrame) -> DataFrame:
    """(node_id, n): in how many pairs each node stands, on either side."""
    return mapping.select(F.col("dup").alias("node_id")).union(mapping.select("canon")).groupBy("node_id").agg(F.count("*").alias("n"))


def chart_nodes(nodes: DataFrame, edges: DataFrame, most: int = 500) -> DataFrame:
    """(name, category, size): the first node of each name, its type or label, larger with more attributes."""
    attrs = edges.where("relation = 'has_attribute'").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))
    rows = nodes.join(attrs, "node_id", "left")
    first = rows.groupBy("name").agg(F.min_by(F.coalesce("schema_type", "label"), "node_id").alias("category"), F.min_by(F.coalesce("n", F.lit(0)), "node_id").alias("n"))
    return first.select("name", "category", F.least(F.lit(40), F.greatest(F.lit(15), F.col("n") * 3 + 15)).alias("size")).orderBy("name").limit(most)


def chart_links(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    n = nodes.select("node_id", "name")
    rows = edges.join(n.select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst")
    return rows.orderBy("edge_id").limit(most).select("source", "target", "relation")


def sub_query_star(subs: DataFrame) -> DataFrame:
    """(source, target): each question with its sub-questions."""
    return subs.select(F.concat(F.lit("question_"), F.col("qid").cast("string")).alias("source"), F.concat_ws("_", F.lit("sub"), F.col("qid").cast("string"), F.col("pos").cast("string")).alias("target"))


def before_after(profile: DataFrame) -> DataFrame:
    """(total, merged, kept, kept_share) of a cluster profile."""
    kept = F.col("candidates") - F.col("merged")
    return profile.select(F.col("candidates").alias("total"), "merged", kept.alias("kept"), F.when(F.col("candidates") > 0, kept / F.col("candidates")).otherwise(0.0).alias("kept_share"))


def graph_stats(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, most_edges: int = 1000) -> DataFrame:
    """(nodes, edges, shown_nodes, shown_edges): how large a graph is, and how much of it a chart shows."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.least("nodes", F.lit(most_nodes)).alias("shown_nodes"), F.least("edges", F.lit(most_edges)).alias("shown_edges"))


def chart_of(nodes: DataFrame | None, edges: DataFrame | None, triples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) for a chart, from a graph or from a relationship list, whichever is given."""
    if triples is not None:
        from kgspark.sources.graphs import graph_of

        g = graph_of(triples)
        nodes, edges = g.nodes, g.edges
    if nodes is None or edges is None:
        raise ValueError("a chart needs nodes and edges, or triples")
    return chart_nodes(nodes, edges), chart_links(nodes, edges)


def retrieved_chart(lines: DataFrame, most: int = 10) -> DataFrame:
    """(qid, source, relation, target) of the first `most` lines (qid, pos, line) of each question that are lists of three
    strings, `[a, b, c]`; other lines are left out."""
    first = lines.where(F.col("pos") < most).withColumn("p", F.from_json(F.when(F.col("line").startswith("[") & F.col("line").endswith("]"), F.col("line")), "array<string>", {"allowSingleQuotes": "true"}))
    ok = first.where(F.size("p") == 3)
    return ok.select("qid", F.col("p")[0].alias("source"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("target"))


def reasoning_flow(steps: DataFrame) -> DataFrame:
    """(qid, step, type, question, triples, chunks, seconds) of steps (qid, pos, type, question, triples, chunks, seconds): numbered
    from 1, questions cut to 50 characters, what is missing as 0 or `unknown`."""
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return steps.select("qid", (F.col("pos") + 1).alias("step"), F.coalesce("type", F.lit("unknown")).alias("type"), F.substring(F.coalesce("question", F.lit("")), 1, 50).alias("question"), none("triples"), none("chunks"), none("seconds"))


def edge_run_summary(before: DataFrame, after: DataFrame, keepers: DataFrame) -> DataFrame:
    """(total, groups, merges, merged_edges, final) of a tail dedup: edges before and after, groups with keepers, keepers
    that stand for others, and edges that went into them."""
    k = keepers.agg(F.count_distinct("src", "relation").alias("groups"), F.count_distinct(F.when(F.col("dst") != F.col("keeper"), F.struct("src", "relation", "keeper"))).alias("merges"), F.count_if(F.col("dst") != F.col("keeper")).alias("merged_edges"))
    return before.agg(F.count("*").alias("total")).crossJoin(k).crossJoin(after.agg(F.count("*").alias("final")))
