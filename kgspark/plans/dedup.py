"""Dedup of triples, keywords and heads, and applying merge mappings to a graph, all set-based."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import canonical_json, coreference, id_number, node_identifier, normalize_name
from kgspark.functions.vector import cosine
from kgspark.operators.communities import average_link_groups, average_link_kinds
from kgspark.operators.graph import combined_mappings, connected_components, resolved
from kgspark.operators.relational import contexts, degrees, first_seen, representative_score, with_overflow
from kgspark.providers import LanguageModel
from kgspark.schemas import ALIAS_RELATIONS, PROTECTED_RELATIONS
from kgspark.sources.graphs import Graph

Store = Callable[[DataFrame, str], DataFrame]


def exact_triples(edges: DataFrame) -> DataFrame:
    """The earliest edge of each (src, dst, relation)."""
    return first_seen(edges, "src", "dst", "relation")


def exact_tails(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The earliest edge of each (src, relation, tail) with equal tail properties, keys in order."""
    props = nodes.select(F.col("node_id").alias("dst"), canonical_json("props").alias("attrs"))
    return first_seen(edges.join(props, "dst", "left"), "src", "relation", "dst", "attrs").drop("attrs")


def semantic_triples(graph: Graph, vectors: DataFrame, store: Store, threshold: float = 0.85, batch: int = 8, most: int = 0) -> DataFrame:
    """(src, relation, dst, keeper): tails of each (head, relation) clustered by average link on their vectors
    (node_id, vec), clusters cut into batches, and each batch's first tail its keeper.

    Groups of one and protected relations are left alone; entries past `most` in a cluster keep themselves.
    """
    own = graph.edges.where(~F.col("relation").isin(*PROTECTED_RELATIONS))
    edges = store(own.groupBy("src", "relation", "dst").agg(F.min("edge_id").alias("edge_id")), "tail_edges")
    if edges.isEmpty():
        return edges.select("src", "relation", "dst", F.col("dst").alias("keeper"))
    size = edges.groupBy("src", "relation").agg(F.count("*").alias("n")).where("n > 1")
    # a vector may be far larger than an edge: edges carry its kind, the first node that has it
    kinds = store(vectors.groupBy("vec").agg(F.min("node_id").alias("kind")), "kinds")
    kind = store(vectors.join(kinds, "vec").select(F.col("node_id").alias("dst"), "kind"), "kind")
    rows = edges.join(size, ["src", "relation"], "left_semi").join(kind, "dst")
    rows = store(rows.select(F.concat_ws("\u0001", F.hex(F.xxhash64("src", "relation")), "src", "relation").alias("grp"), F.col("edge_id").alias("pos"), "src", "relation", "dst", "kind"), "tail_rows")
    marked = rows.join(average_link_kinds(rows, kinds, threshold), ["grp", "kind"])
    cut = with_overflow(marked, ["grp", "cluster"], "pos", batch, most)
    keeper = F.first("dst").over(Window.partitionBy("grp", "cluster", "batch").orderBy("pos"))  # entries past `most` come last
    return cut.select("src", "relation", "dst", F.when(F.col("is_overflow"), F.col("dst")).otherwise(keeper).alias("keeper"))


def final_edges(edges: DataFrame, keepers: DataFrame) -> DataFrame:
    """Edges after tail dedup: each group's keeper, with the chunks of all it stands for; others as they were."""
    h = F.xxhash64("src", "dst", "relation").alias("_h")  # sorts on long names that begin alike are slow
    rows = exact_triples(edges).select("*", h).join(keepers.select("src", "relation", "dst", "keeper", h), ["_h", "src", "dst", "relation"], "left")
    rows = rows.withColumn("to", F.coalesce("keeper", "dst"))
    flat = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "source_chunks"))), lambda x: x["source_chunks"])))
    g = rows.groupBy(F.xxhash64("src", "relation", "to"), "src", "relation", "to").agg(F.min("edge_id").alias("edge_id"), flat.alias("source_chunks"), F.count("*").alias("merged"))
    return g.select("edge_id", "src", F.col("to").alias("dst"), "relation", "source_chunks", (F.col("merged") - 1).alias("n_merged"))


def interchange_of(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dedup groups (src, relation, cluster, member, is_rep, reason) as one row a (head, relation): clusters of two or
    more, each as member identifiers with the representative last, and the tails that stay."""
    ident = nodes.select("node_id", node_identifier("name", F.coalesce(F.get("chunk_ids", F.lit(0)), F.lit("")), "label").alias("ident"))
    rows = groups.join(ident, F.col("member") == F.col("node_id"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("is_rep", "ident"))), lambda x: x["ident"])
    c = rows.groupBy("src", "relation", "cluster").agg(order.alias("members"), F.max("reason").alias("reason"), F.max(F.when(F.col("is_rep"), F.col("ident"))).alias("kept"))
    entry = F.struct(F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("key"), F.struct(F.col("members").alias("member"), F.col("reason").alias("llm_judge_reason")).alias("value"))
    g = c.groupBy("src", "relation").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.size("members") > 1, entry)))).alias("dedup_results"),
        F.array_sort(F.flatten(F.collect_list("members"))).alias("tail_nodes_to_dedup"),
        F.array_sort(F.collect_list("kept")).alias("deduped_tails"),
    )
    head = nodes.select(F.col("node_id").alias("src"), F.struct("label", F.col("props").alias("properties")).alias("head_node"))
    return g.join(head, "src").select("head_node", "relation", "tail_nodes_to_dedup", "dedup_results", "deduped_tails")


# mappings ------------------------------------------------------------------------------------------------


def exact_heads(nodes: DataFrame) -> DataFrame:
    """(dup, canon): entities of one normalised name, the one of smallest number canonical; a name that is empty
    once normalised merges nothing."""
    n = nodes.where("label = 'entity'").select("node_id", normalize_name("name").alias("norm"), id_number("node_id").alias("number"))
    best = n.where("norm <> ''").groupBy("norm").agg(F.min_by("node_id", F.struct(F.coalesce("number", F.lit(2**62)), F.col("node_id"))).alias("canon"))
    return n.join(best, "norm").where("node_id <> canon").select(F.col("node_id").alias("dup"), "canon")


def similar_pairs(vectors: DataFrame, threshold: float = 0.75, most: int | None = None, bits: int = 0, tables: int = 16) -> DataFrame:
    """(a, b, sim), a < b, of rows (node_id, vec) with cosine at least threshold, best first, `most` at most.

    bits = 0 compares in blocks: rows are dealt into blocks and each pair of blocks is one group, which
    gives only its close pairs, so no task holds more than two blocks. With bits, only pairs that share the signs of `bits` random
    projections in one of `tables` tables are compared.
    """
    rows = vectors.select("node_id", F.col("vec").cast("array<double>").alias("vec"))
    if bits:
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        f = rows.withColumn("features", array_to_vector("vec"))
        lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.5, numHashTables=tables, seed=7).fit(f)
        near = lsh.approxSimilarityJoin(f, f, (2 - 2 * threshold) ** 0.5 + 1e-9, "dist").where("datasetA.node_id < datasetB.node_id")
        pairs = near.select(F.col("datasetA.node_id").alias("a"), F.col("datasetB.node_id").alias("b"), cosine("datasetA.vec", "datasetB.vec").alias("sim"))
    else:
        # each pair of blocks i <= j is one job, so a row goes to about half as many jobs as there are blocks, on either side
        blocks = max(1, -(-rows.count() // 512))
        dealt = rows.withColumn("blk", F.pmod(F.xxhash64("node_id"), F.lit(blocks)))
        span = lambda lo, hi: F.explode(F.sequence(lo.cast("long"), hi.cast("long")))
        left = dealt.select(F.col("blk").alias("i"), span(F.col("blk"), F.lit(blocks - 1)).alias("j"), F.lit(0).alias("side"), "node_id", "vec")
        right = dealt.select(span(F.lit(0), F.col("blk")).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "node_id", "vec")

        def close(g: pd.DataFrame) -> pd.DataFrame:
            """The pairs of two blocks that are close enough, by one matrix product; of a block with itself, each once."""
            a, b = g[g["side"] == 0], g[g["side"] == 1]
            if a.empty or b.empty:
                return pd.DataFrame({"a": [], "b": [], "sim": []})
            unit = [np.array(x["vec"].tolist(), float) for x in (a, b)]
            size = [np.linalg.norm(x, axis=1, keepdims=True) for x in unit]
            unit = [np.divide(x, n, out=np.zeros_like(x), where=n > 0) for x, n in zip(unit, size)]
            sim = unit[0] @ unit[1].T
            x, y = np.nonzero(sim >= threshold)
            out = pd.DataFrame({"a": a["node_id"].to_numpy()[x], "b": b["node_id"].to_numpy()[y], "sim": sim[x, y]})
            if len(g) and g["i"].iloc[0] == g["j"].iloc[0]:
                return out[out["a"] < out["b"]]
            turn = out["a"] > out["b"]
            out.loc[turn, ["a", "b"]] = out.loc[turn, ["b", "a"]].to_numpy()
            return out[out["a"] != out["b"]]

        kind = rows.schema["node_id"].dataType.simpleString()
        pairs = left.union(right).groupBy("i", "j").applyInPandas(close, f"a {kind}, b {kind}, sim double")
    pairs = pairs.where(F.col("sim") >= threshold)
    return pairs.orderBy(F.desc("sim"), "a", "b").limit(most) if most else pairs


def judged_pairs(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, model: LanguageModel, relations: int = 10) -> DataFrame:
    """(dup, canon, method, confidence, rationale) of pairs (a, b) that a model calls coreferent. Its representative
    must be one of the two; the other becomes the duplicate."""
    ctx = node_context(nodes, edges, relations)
    n = nodes.select("node_id", "name")
    rows = pairs.select("a", "b")
    for side, name in (("a", "left"), ("b", "right")):
        rows = rows.join(n.select(F.col("node_id").alias(side), F.col("name").alias(f"{name}_name")), side)
        rows = rows.join(ctx.select(F.col("node_id").alias(side), F.col("context").alias(f"{name}_context")), side, "left")
    rows = rows.withColumn("left_id", F.col("a")).withColumn("right_id", F.col("b")).withColumn("call_id", F.concat_ws("|", "a", "b")).withColumn("kind", F.lit("coreference"))
    prompt = F.concat_ws("\n", F.lit("Do these two denote the same thing?"), F.concat(F.lit("1: "), "left_name"), F.coalesce("left_context", F.lit("")), F.concat(F.lit("2: "), "right_name"), F.coalesce("right_context", F.lit("")))
    answers = model.complete(rows.withColumn("prompt", prompt))
    out = rows.join(answers, "call_id").withColumn("j", coreference("response"))
    out = out.where(F.col("j.is_coreferent") & ((F.col("j.representative") == F.col("a")) | (F.col("j.representative") == F.col("b"))))
    canon = F.col("j.representative")
    return out.select(F.when(canon == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("dup"), canon.alias("canon"), F.lit("semantic").alias("method"), F.col("j.confidence").alias("confidence"), F.col("j.rationale").alias("rationale"))


def node_context(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(node_id, context): up to `most` out-edges, then in-edges, of each node as lines."""
    name = nodes.select("node_id", F.coalesce("name", "node_id").alias("name"))

    def side(own: str, other: str, text: Column, order: int) -> DataFrame:
        e = edges.select(F.col(own).alias("node_id"), F.col(other).alias("o"), "relation", "edge_id")
        e = e.withColumn("rn", F.row_number().over(Window.partitionBy("node_id").orderBy("edge_id"))).where(F.col("rn") <= most)
        return e.join(name.select(F.col("node_id").alias("o"), "name"), "o").select("node_id", F.struct(F.lit(order).alias("side"), "rn", text.alias("line")).alias("x"))

    rows = side("src", "dst", F.concat(F.lit("-> "), "relation", F.lit(" "), "name"), 0).union(side("dst", "src", F.concat(F.lit("<- "), "relation", F.lit(" "), "name"), 1))
    return rows.groupBy("node_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])).alias("context"))


def without_conflicts(pairs: DataFrame, edges: DataFrame, store: Store, alias_of: tuple[str, ...] = ("alias_of", "等同于"), includes: tuple[str, ...] = ("alias_includes", "also_known_as")) -> DataFrame:
    """(dup, canon, kind) of judged pairs and the aliases that edges name already, which win.

    Both ends of a pair move to the nodes that the graph's aliases end at. kind is `graph` for an alias of the
    graph, `none` for a pair that no alias touches, `cascade` for one that moved; one whose ends meet says nothing new
    and goes. What is left is resolved to its ends, and a pair that would close a circle against the graph goes with it.
    """
    own = edges.where(F.col("relation").isin(*alias_of)).select(F.col("src").alias("dup"), F.col("dst").alias("canon"))
    own = own.union(edges.where(F.col("relation").isin(*includes)).select(F.col("dst"), F.col("src")))
    root = store(resolved(own, lambda df, n: store(df, f"own_{n}")), "own")
    to = lambda c: root.select(F.col("dup").alias(c), F.col("canon").alias(f"_{c}"))
    moved = pairs.select("dup", "canon").join(to("dup"), "dup", "left").join(to("canon"), "canon", "left")
    moved = moved.select(F.coalesce("_dup", "dup").alias("dup"), F.coalesce("_canon", "canon").alias("canon"), (F.col("_dup").isNotNull() | F.col("_canon").isNotNull()).alias("cascade")).where("dup <> canon")
    kinds = root.select("dup", F.lit("graph").alias("kind")).union(moved.groupBy("dup").agg(F.when(F.bool_or("cascade"), "cascade").otherwise("none")))
    every = resolved(root.select("dup", "canon").union(moved.select("dup", "canon")), lambda df, n: store(df, f"all_{n}"))
    return every.join(kinds, "dup", "left").select("dup", "canon", F.coalesce("kind", F.lit("cascade")).alias("kind"))


def head_mapping(graph: Graph, vectors: DataFrame, model: LanguageModel | None, store: Store, prefilter: float = 0.75) -> DataFrame:
    """(dup, canon) of exact and semantic head dedup, chains resolved. All pairs that are similar enough are taken. Without a model,
    entities that similar pairs link, directly or over others, merge into the one of smallest number."""
    exact = exact_heads(graph.nodes)
    left = graph.nodes.join(exact.select(F.col("dup").alias("node_id")), "node_id", "left_anti").where("label = 'entity'")
    own = vectors.join(left.select("node_id"), "node_id", "left_semi")
    semantic = linked_heads(own, store, prefilter) if model is None else judged_pairs(similar_pairs(own, prefilter), graph.nodes, graph.edges, model).select("dup", "canon")
    return combined_mappings(exact, semantic, store)


def linked_heads(vectors: DataFrame, store: Store, threshold: float) -> DataFrame:
    """(dup, canon) of rows (node_id, vec): the groups that pairs of similar_pairs() link, each led by its smallest number.

    Equal vectors are linked with the first node that has them, not with each other, so n copies give n links.
    """
    kinds = store(vectors.groupBy("vec").agg(F.min("node_id").alias("node_id")), "head_kinds")
    zero = F.forall("vec", lambda x: x == 0)  # similar to nothing, itself included
    copies = vectors.where(~zero).join(kinds.select("vec", F.col("node_id").alias("a")), "vec").select("a", F.col("node_id").alias("b")).where("a <> b")
    links = copies.unionByName(similar_pairs(kinds, threshold).select("a", "b"))
    groups = store(connected_components(links, lambda df, n: store(df, f"linked_{n}")), "linked")
    first = groups.groupBy("component").agg(F.min_by("node", F.struct(F.coalesce(id_number("node"), F.lit(2**62)), F.col("node"))).alias("canon"))
    return groups.join(first, "component").where("node <> canon").select(F.col("node").alias("dup"), "canon")


def best_representatives(mapping: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The mapping with each merge group's best-connected member as its representative."""
    group = mapping.select(F.col("canon").alias("grp"), F.col("dup").alias("node_id")).union(mapping.select("canon", "canon").distinct())
    rows = group.join(nodes.select("node_id", "name", "chunk_ids"), "node_id").join(degrees(edges), "node_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = representative_score(zero("out_degree"), zero("in_degree"), F.col("name"), F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))), zero(id_number("node_id")))
    rows = rows.withColumn("score", score)
    best = rows.groupBy("grp").agg(F.max_by("node_id", F.struct("score", F.col("node_id"))).alias("canon"))
    return rows.join(best, "grp").where("node_id <> canon").select(F.col("node_id").alias("dup"), "canon")


def mapping_of_interchange(groups: DataFrame) -> DataFrame:
    """(dup, canon) identifiers: every member of a cluster to its last one; of two clusters the last one read counts."""
    c = groups.select(F.posexplode(F.map_values("dedup_results")).alias("pos", "c")).select("pos", F.col("c.member").alias("m")).where(F.size("m") > 0)
    rows = c.select("pos", F.explode("m").alias("dup"), F.element_at("m", -1).alias("canon"))
    return rows.where("dup <> canon").groupBy("dup").agg(F.max_by("canon", "pos").alias("canon"))


# rewriting ------------------------------------------------------------------------------------------------


#: A mapping of at most this many rows, which are counted first, is sent to every task; a larger one is joined by shuffles.
SENT_ROWS = 500_000


def rewritten(edges: DataFrame, mapping: DataFrame, both_ends: bool = True, only: Column | None = None) -> DataFrame:
    """Edges with ends replaced by their canonical nodes. A changed edge that becomes a loop goes, unless it was
    one; changed edges that fall on an edge of the same relation join it, their chunks united; parallel edges
    that nothing changed stay as they are. `only` limits the rewrite to some edges, of which tails alone
    change if both_ends is false.

    Only what changed is grouped; the rest is joined with it.
    """
    m = mapping.select("dup", "canon")
    if m.count() <= SENT_ROWS:
        m = F.broadcast(m)
    e = edges.withColumn("_own", only if only is not None else F.lit(True))
    e = e.join(m.select(F.col("dup").alias("dst"), F.col("canon").alias("_d")), "dst", "left")
    if both_ends:
        e = e.join(m.select(F.col("dup").alias("src"), F.col("canon").alias("_s")), "src", "left")
    else:
        e = e.withColumn("_s", F.lit(None).cast("string"))
    e = e.withColumn("_src", F.when(F.col("_own"), F.coalesce("_s", "src")).otherwise(F.col("src"))).withColumn("_dst", F.when(F.col("_own"), F.coalesce("_d", "dst")).otherwise(F.col("dst")))
    e = e.withColumn("_changed", (F.col("_src") != F.col("src")) | (F.col("_dst") != F.col("dst")))
    e = e.where(~F.col("_changed") | (F.col("_src") != F.col("_dst")) | (F.col("src") == F.col("dst")))
    key = ["src", "dst", "relation"]
    same = e.where("not _changed").select("edge_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "relation", "source_chunks")
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("source_chunks") > 0, F.col("source_chunks"))))))
    moved = e.where("_changed").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "relation").agg(F.min("edge_id").alias("_first"), united.alias("_chunks"))
    # what changed edges fall on: of parallel edges the first
    onto = same.join(moved.drop("_chunks"), key).groupBy(*key).agg(F.min("edge_id").alias("_least"))
    alone = moved.join(onto, key, "left_anti").select(F.col("_first").alias("edge_id"), *key, F.col("_chunks").alias("source_chunks"))
    more = moved.join(onto, key).select(*key, "_least", "_chunks")
    united = F.when(F.col("edge_id") == F.col("_least"), F.array_union("source_chunks", "_chunks")).otherwise(F.col("source_chunks"))
    return same.join(more, key, "left").select("edge_id", *key, united.alias("source_chunks")).unionByName(alone)


def alias_edges(edges: DataFrame, mapping: DataFrame, relation: str = "等同于", touched_only: bool = True) -> DataFrame:
    """Edges canon -relation-> dup to add, with ids after the last one, for duplicates that edges touch and that
    no alias edge connects yet."""
    m = mapping.select("dup", "canon").distinct()
    if touched_only:
        ends = edges.select(F.col("src").alias("dup")).union(edges.select("dst")).distinct()
        m = m.join(ends, "dup", "left_semi")
    have = edges.where(F.col("relation").isin(*ALIAS_RELATIONS, relation))
    have = have.select(F.col("src").alias("canon"), F.col("dst").alias("dup")).union(have.select("dst", "src")).distinct()
    m = m.join(have, ["canon", "dup"], "left_anti")
    last = edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1)).alias("last"))
    rows = m.crossJoin(F.broadcast(last))
    return rows.select((F.col("last") + 1 + F.monotonically_increasing_id()).alias("edge_id"), F.col("canon").alias("src"), F.col("dup").alias("dst"), F.lit(relation).alias("relation"), F.array().cast("array<string>").alias("source_chunks"))


def apply_mapping(graph: Graph, mapping: DataFrame, store: Store, keep_aliases: bool = True, relation: str = "等同于") -> Graph:
    """A graph with a resolved (dup, canon) mapping applied everywhere: at both ends of edges, in communities and
    keyword edges; alias edges added if duplicates are kept, duplicates removed otherwise; isolated nodes go."""
    m, old = store(resolved(mapping, store), "mapping"), store(graph.edges, "old_edges")
    edges = old
    if not m.isEmpty():
        edges = rewritten(old, m)
        if keep_aliases:
            edges = edges.unionByName(alias_edges(old, m, relation))
        edges = store(edges, "edges")
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return Graph(graph.nodes.join(ends, "node_id", "left_semi"), edges)


def apply_interchange(graph: Graph, groups: DataFrame, store: Store, keep_aliases: bool = True) -> Graph:
    """apply_mapping() of stored dedup results, whose members are identifiers."""
    ident = graph.nodes.select("node_id", node_identifier("name", F.coalesce(F.get("chunk_ids", F.lit(0)), F.lit("")), "label").alias("ident"))
    ident = ident.groupBy("ident").agg(F.min("node_id").alias("node_id"))
    m = mapping_of_interchange(groups)
    m = m.join(ident.select(F.col("ident").alias("dup"), F.col("node_id").alias("d")), "dup").join(ident.select(F.col("ident").alias("canon"), F.col("node_id").alias("c")), "canon")
    return apply_mapping(graph, m.select(F.col("d").alias("dup"), F.col("c").alias("canon")), store, keep_aliases)


def merged_with_aliases(graph: Graph, mapping: DataFrame, store: Store, relation: str = "等同于", v1: bool = False) -> Graph:
    """Head merge. v1 deletes duplicates, uniting their chunks into the canonical node; otherwise duplicates stay as
    aliases with one edge, dup -relation-> canon, and roles are set. Pairs that another relation links directly
    are not merged as aliases."""
    m = store(resolved(mapping, store), "heads")
    if not v1:
        direct = graph.edges.where(~F.col("relation").isin(*ALIAS_RELATIONS, relation))
        linked = direct.select(F.col("src").alias("dup"), F.col("dst").alias("canon")).union(direct.select("dst", "src")).distinct()
        m = store(m.join(linked, ["dup", "canon"], "left_anti"), "heads_free")
    old = graph.edges.where(~F.col("relation").isin(*ALIAS_RELATIONS, relation)) if not v1 else graph.edges
    edges = rewritten(old, m)
    members = m.join(graph.nodes.select(F.col("node_id").alias("dup"), F.col("name").alias("alias_name"), F.col("chunk_ids").alias("_chunks")), "dup")
    by = members.groupBy(F.col("canon").alias("node_id")).agg(F.array_distinct(F.flatten(F.collect_list("_chunks"))).alias("_more"), F.to_json(F.array_sort(F.collect_list(F.struct("dup", "alias_name")))).alias("_aliases"))
    nodes = graph.nodes.join(by, "node_id", "left").withColumn("chunk_ids", F.when(F.col("_more").isNull(), F.col("chunk_ids")).otherwise(F.array_union(F.coalesce("chunk_ids", F.array().cast("array<string>")), "_more")))
    nodes = nodes.withColumn("props", F.when(F.col("_aliases").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", lambda k, v: k != "aliases"), F.create_map(F.lit("aliases"), "_aliases"))))
    nodes = nodes.withColumn("node_role", F.when(F.col("_aliases").isNotNull(), "representative").otherwise(F.col("node_role"))).drop("_more", "_aliases")
    if v1:
        nodes = nodes.join(m.select(F.col("dup").alias("node_id")), "node_id", "left_anti")
        return Graph(nodes, edges)
    nodes = nodes.join(m.select(F.col("dup").alias("node_id"), F.col("canon").alias("_to")), "node_id", "left")
    nodes = nodes.withColumn("node_role", F.when(F.col("_to").isNotNull(), "alias").otherwise(F.col("node_role"))).withColumn("alias_of", F.coalesce("_to", "alias_of")).drop("_to")
    turned = alias_edges(graph.edges.limit(0).unionByName(edges), m, relation, touched_only=False)
    return Graph(nodes, edges.unionByName(turned.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "source_chunks")))


def keyword_candidates(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(community, keyword, pos, description, context) of communities with two keywords or more; a keyword's source
    is the entity it represents."""
    of = edges.where("relation = 'keyword_of'").select(F.col("dst").alias("community"), F.col("src").alias("keyword"), F.col("edge_id").alias("pos"))
    many = of.groupBy("community").agg(F.count("*").alias("n")).where("n > 1").select("community")
    rows = of.join(many, "community", "left_semi")
    source = edges.where("relation = 'represented_by'").groupBy(F.col("dst").alias("keyword")).agg(F.max_by("src", "edge_id").alias("source"))
    rows = rows.join(source, "keyword", "left")
    rows = rows.join(nodes.select(F.col("node_id").alias("keyword"), F.col("name").alias("kw")), "keyword")
    rows = rows.join(nodes.select(F.col("node_id").alias("source"), F.col("name").alias("source_name"), "chunk_ids"), "source", "left")
    ctx = contexts(rows.select(F.col("keyword").alias("item"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")).dropDuplicates(["item"]), chunks)
    rows = rows.join(ctx.withColumnRenamed("item", "keyword"), "keyword", "left")
    text = F.when(F.col("source_name").isNull(), F.col("kw")).otherwise(F.format_string("%s (from %s)", "kw", "source_name"))
    return rows.select("community", "keyword", "pos", text.alias("description"), "context")


def keyword_mapping(candidates: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(dup, canon) of keywords that cluster within a community; the first of a cluster stays."""
    rows = candidates.join(vectors.select(F.col("node_id").alias("keyword"), "vec"), "keyword")
    found = average_link_groups(rows.select(F.col("community").alias("grp"), "pos", "vec"), threshold)
    marked = candidates.select(F.col("community").alias("grp"), "pos", "keyword").join(found, ["grp", "pos"])
    first = marked.groupBy("grp", "cluster").agg(F.min_by("keyword", "pos").alias("canon"))
    return marked.join(first, ["grp", "cluster"]).where("keyword <> canon").select(F.col("keyword").alias("dup"), "canon").dropDuplicates(["dup"])


def workflow(graph: Graph, vectors: DataFrame, model: LanguageModel | None, store: Callable[[str], Store]) -> Graph:
    """Aliases named by edges, then tails, then heads, then tails of merged heads once more."""
    keep = lambda g, step: Graph(store(step)(g.nodes, "nodes"), store(step)(g.edges, "edges"))
    named = graph.edges.where(F.col("relation").isin("alias_includes", "also_known_as")).select(F.col("dst").alias("dup"), F.col("src").alias("canon"))
    g = keep(apply_mapping(graph, named, store("alias"), keep_aliases=False), "aliased")
    g = keep(Graph(g.nodes, final_edges(g.edges, semantic_triples(g, vectors, store("tails"))).drop("n_merged")), "tailed")
    s = store("heads")
    m = s(head_mapping(g, vectors, model, s), "found")
    g = keep(merged_with_aliases(g, m, s), "merged")
    heads = g.nodes.where("node_role = 'representative'").select("node_id")
    part = Graph(g.nodes, g.edges.join(heads, F.col("src") == F.col("node_id"), "left_semi"))
    last = semantic_triples(part, vectors, store("last"))
    return Graph(g.nodes, final_edges(g.edges, last).drop("n_merged"))


def preloaded_clusters(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """rows (grp, pos) with the cluster that a stored run (grp, pos, cluster) gave them; a group without one is a
    single cluster, and an entry that its group's clusters leave out a cluster of its own after them."""
    known = clusters.groupBy("grp").agg((F.max("cluster") + 1).alias("next"))
    out = rows.join(clusters.select("grp", "pos", "cluster"), ["grp", "pos"], "left").join(known, "grp", "left")
    w = Window.partitionBy("grp", F.col("cluster").isNull()).orderBy("pos")
    alone = F.col("next") + F.row_number().over(w) - 1
    return out.withColumn("cluster", F.when(F.col("next").isNull(), F.lit(0)).otherwise(F.coalesce("cluster", alone)).cast("int")).drop("next")


def chunk_context(nodes: DataFrame, chunks: DataFrame, chars: int = 500) -> DataFrame:
    """(node_id, context): the first characters of each node's first chunk that there is."""
    ids = nodes.select("node_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    found = ids.join(chunks.select("chunk_id", F.substring("text", 1, chars).alias("t")), "chunk_id")
    return found.groupBy("node_id").agg(F.min_by("t", "pos").alias("context"))
