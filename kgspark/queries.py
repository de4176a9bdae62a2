"""The engine's operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import language, text, vector
from kgspark.operators import communities, graph, projections, relational
from kgspark.plans import agent, analytics, construct, dedup, retrieve
from kgspark.providers import ExpressionModel, HashingEmbedder
from kgspark.sources.graphs import Graph, triples_of
from kgspark.sources.texts import stale
from kgspark.store import shared_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def tables_graph(s: SparkSession, d: str) -> Graph:
    return construct.graph_of_tables({n: table(s, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "lang", "source")


def unit_vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("node_id"), "vec_id", F.col("embedding").alias("vec"), "label")


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return unit_vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"))


def supplies(s: SparkSession, d: str) -> DataFrame:
    """Edges supplier -supplies-> part, one for each line item."""
    line = construct.hashed_id("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(s, d, "lineitem").select(line.alias("edge_id"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("supplies").alias("relation"), F.array(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"))).alias("source_chunks"))


def part_entities(s: SparkSession, d: str) -> DataFrame:
    return tables_graph(s, d).nodes.where("schema_type = 'part'")


# sources, projections and filters ---------------------------------------------------------------------------


@query
def src1_node_table(s, d):
    return tables_graph(s, d).nodes.select("node_id", "label", "level", "name", "schema_type")


@query
def snk1_triples(s, d):
    t = triples_of(tables_graph(s, d))
    return t.select("edge_id", F.col("start_node.label").alias("start_label"), F.col("start_node.properties")["name"].alias("start_name"), "relation", F.col("end_node.label").alias("end_label"), F.col("end_node.properties")["name"].alias("end_name"))


@query
def prj1_chunks(s, d):
    return projections.chunked(docs(s, d)).select("chunk_id", "doc_id", "pos", F.char_length("text").cast("long").alias("chars"))


@query
def prj1_split_chunks(s, d):
    c = projections.chunked(docs(s, d), size=1000, overlap=200)
    return c.select("doc_id", "pos", F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


@query
def prj3_valid_triples(s, d):
    rows = table(s, d, "events").select("event_id", F.array_append(F.split("event_type", "_"), F.col("user_id").cast("string")).alias("a"))
    rows = rows.select("event_id", F.concat("a", F.array(F.lit("x")), F.array_repeat(F.lit("y"), (F.col("event_id") % 3).cast("int"))).alias("triple"))
    return projections.valid_triples(rows).select("event_id", F.concat_ws(",", "triple").alias("triple"))


@query
def prj14_index_text(s, d):
    return tables_graph(s, d).nodes.select("node_id", projections.index_text().alias("text"))


@query
def prj16_describe_node(s, d):
    return tables_graph(s, d).nodes.select("node_id", projections.describe_node().alias("description"))


@query
def prj23_community_text(s, d):
    g = tables_graph(s, d)
    named = g.edges.where("relation = 'part_of'").join(g.nodes.select(F.col("node_id").alias("src"), "name"), "src")
    m = named.groupBy(F.col("dst").alias("community")).agg(F.array_sort(F.collect_list("name")).alias("members"))
    return m.select("community", projections.community_text().alias("text"))


@query
def flt2_type_filter(s, d):
    return projections.typed_nodes(tables_graph(s, d).nodes, ["part", "nation"]).select("node_id", "schema_type")


@query
def flt8_main_entities(s, d):
    return projections.main_entities(tables_graph(s, d).nodes).groupBy("schema_type").agg(F.count("*").alias("n"))


# joins --------------------------------------------------------------------------------------------------


@query
def join1_edge_ends(s, d):
    g = tables_graph(s, d)
    rows = relational.with_ends(g.edges, g.nodes, "name", "label")
    return rows.groupBy("relation", "src_label", "dst_label").agg(F.count("*").alias("n"), F.min("src_name").alias("first_src"), F.max("dst_name").alias("last_dst"))


@query
def join2_chunk_fetch(s, d):
    chunks = docs(s, d).select(F.col("doc_id").alias("chunk_id"), "text")
    ids = table(s, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return relational.chunk_texts(ids, chunks).select("chunk_id", "quality", F.char_length("text").cast("long").alias("chars"))


@query
def join3_missing_content(s, d):
    chunks = docs(s, d).select(F.col("doc_id").alias("chunk_id"), "text")
    ids = table(s, d, "conversations").select(F.col("conv_id").alias("chunk_id")).distinct()
    return relational.chunk_texts(ids, chunks, keep_missing=True)


@query
def join4_relation_match(s, d):
    g = tables_graph(s, d)
    ids = g.nodes.where("props['segment'] = 'BUILDING'").select("node_id")
    wanted = s.createDataFrame([("located_in",), ("placed_by",)], "relation string")
    return relational.relation_matched(g.edges, ids, wanted).select("edge_id", "src", "relation", "dst")


@query
def join5_one_hop(s, d):
    g = tables_graph(s, d)
    return relational.one_hop(g.edges, g.nodes.where("schema_type = 'nation'"), 20).select("edge_id", "src", "relation", "dst")


@query
def join6_neighbors(s, d):
    g = tables_graph(s, d)
    return relational.neighbour_edges(g.edges, g.nodes.where("schema_type = 'supplier'")).select("start", "src", "relation", "dst")


@query
def join7_sim_pairs(s, d):
    return dedup.similar_pairs(unit_vectors(s, d), 0.30).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def join8_identifier(s, d):
    n = tables_graph(s, d).nodes.where("label = 'entity'").withColumn("chunk_ids", F.array(F.lit("c1")))
    ident = n.select(text.node_identifier("name", F.lit("c1"), "label").alias("identifier")).distinct()
    return relational.node_of_identifier(ident, n)


@query
def join9_cache_check(s, d):
    return stale(table(s, d, "orders").select("o_custkey"), table(s, d, "customer").select("c_custkey"))


@query
def join14_comm_members(s, d):
    comms = table(s, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("community")).agg(F.collect_list("n_name").alias("members"))
    return relational.community_members(comms, tables_graph(s, d).nodes)


@query
def join16_keyword_links(s, d):
    kw = table(s, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("node_id"), F.substring("p_brand", -2, 2).alias("name"))
    comm = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_name").alias("name"))
    return relational.keyword_links(kw, comm)


@query
def join17_last_source(s, d):
    return relational.last_source(supplies(s, d), "supplies")


@query
def join20_edge_exists(s, d):
    pairs = table(s, d, "part").select(F.concat(F.lit("supplier_"), (F.col("p_partkey") % 50 + 1).cast("string")).alias("src"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("dst"), F.when(F.col("p_partkey") % 2 == 0, F.lit("supplies")).alias("relation"))
    return relational.edge_exists(pairs, supplies(s, d))


# aggregations, windows, sets ------------------------------------------------------------------------------


@query
def agg1_head_relation(s, d):
    t = relational.tails(tables_graph(s, d).edges)
    return t.select("src", "relation", F.col("n").alias("n"), F.col("tails")[0].alias("first_tail"), F.element_at("tails", -1).alias("last_tail"))


@query
def agg3_exact_heads(s, d):
    g = relational.name_groups(part_entities(s, d), text.id_number("node_id"))
    return g.select("node_id", "norm", "canonical", "size")


@query
def agg4_degree(s, d):
    return relational.degrees(tables_graph(s, d).edges)


@query
def agg5_token_count(s, d):
    return docs(s, d).groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("tokens"))


@query
def agg11_label_relation_top10(s, d):
    g = tables_graph(s, d)
    return analytics.top_labels_and_relations(g.nodes, g.edges)


@query
def agg12_cluster_profile(s, d):
    sizes = table(s, d, "part").groupBy(text.normalize_name("p_name").alias("cluster_id")).agg(F.count("*").alias("size"))
    p = analytics.cluster_profile(sizes)
    return p.select("clusters", "candidates", "merged", "single", "max_size", "min_size", "notes", *[F.round(c, 6).alias(c) for c in ("mean_size", "median_size", "dedup_rate", "single_share")])


@query
def agg14_merge_frequency(s, d):
    return analytics.merge_frequency(dedup.exact_heads(part_entities(s, d)))


@query
def agg16_accuracy(s, d):
    rows = table(s, d, "labels").select((F.col("quality") == 1 - F.col("toxic")).alias("correct"))
    return agent.accuracy(rows).select("n", F.round("accuracy", 6).alias("accuracy"))


@query
def agg19_edge_chunks(s, d):
    e = supplies(s, d).groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))).alias("c"))
    return e.select("src", "dst", F.size("c").cast("long").alias("n_chunks"), F.concat_ws(",", "c").alias("chunks"))


@query
def agg20_contexts(s, d):
    items = table(s, d, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")).alias("chunk_ids"))
    return relational.contexts(items, docs(s, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text"))


@query
def win1_first_seen(s, d):
    return relational.first_seen(supplies(s, d), "src", "dst", "relation").select("edge_id", "src", "dst")


@query
def win2_batches(s, d):
    rows = table(s, d, "part").select("p_brand", "p_partkey")
    return relational.batched(rows, ["p_brand"], "p_partkey", 30)


@query
def win3_overflow(s, d):
    rows = table(s, d, "part").select("p_brand", "p_partkey")
    return relational.with_overflow(rows, ["p_brand"], "p_partkey", 8, 50)


@query
def win4_top_keywords(s, d):
    v = unit_vectors(s, d)
    edges = v.select(F.col("vec_id").alias("edge_id"), F.col("node_id").alias("src"), F.concat(F.lit("vec_"), (F.col("vec_id") % 7).cast("string")).alias("dst"), F.lit("r").alias("relation"))
    top = communities.community_keywords(v.select("node_id", F.col("label").alias("community")), edges, v.select("node_id", "vec"))
    return top.select("community", "node_id", "rank")


@query
def win5_norm_degree(s, d):
    g = tables_graph(s, d)
    deg = relational.degrees(g.edges).join(g.nodes.select("node_id", "label"), "node_id")
    top = deg.groupBy("label").agg(F.max("degree").alias("most"))
    return deg.join(top, "label").select("node_id", F.round(F.col("degree") / F.col("most"), 6).alias("share"))


@query
def win7_best_rep(s, d):
    parts = part_entities(s, d)
    return dedup.best_representatives(dedup.exact_heads(parts), parts, supplies(s, d))


def keyword_reranked(s, d, q: DataFrame) -> DataFrame:
    """(qid, pos, score, rank): for each question (qid, question) the five documents with most of its words."""
    words = q.select("qid", F.explode(text.question_words("question")).alias("w"))
    low = docs(s, d).select(F.col("doc_id").alias("pos"), F.lower("text").alias("low"))
    return relational.most_words(words, low, 5)


@query
def top1_keyword_rerank(s, d):
    return keyword_reranked(s, d, table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))


@query
def set1_distinct_triples(s, d):
    return tables_graph(s, d).edges.select("src", "relation", "dst").distinct().groupBy("relation").agg(F.count("*").alias("n"))


@query
def set2_ordered_distinct(s, d):
    return relational.ordered_distinct(supplies(s, d).withColumnRenamed("edge_id", "pos"), ["src", "relation", "dst"])


@query
def set4_exact_attrs(s, d):
    e = dedup.exact_tails(supplies(s, d), part_entities(s, d))
    return e.select("edge_id", "src", "dst")


@query
def set5_chunk_union(s, d):
    return table(s, d, "labels").select("doc_id").union(table(s, d, "conversations").select("conv_id")).distinct()


@query
def set10_difference(s, d):
    return docs(s, d).select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query
def set11_relations(s, d):
    return tables_graph(s, d).edges.select("relation").distinct()


# text, JSON and hashes --------------------------------------------------------------------------------------


@query
def str1_normalize(s, d):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" ("), "p_brand", F.lit(").  X"))
    return table(s, d, "part").select("p_partkey", text.normalize_name(raw).alias("norm"))


@query
def str2_identifier_parse(s, d):
    n = tables_graph(s, d).nodes.where("label = 'entity'")
    p = n.select("node_id", text.parse_identifier(text.node_identifier("name", F.lit("c9"), "label")).alias("p"))
    return p.select("node_id", "p.name", "p.chunk_id", "p.label", "p.exact")


@query
def str9_tokens(s, d):
    return docs(s, d).select("doc_id", F.size(text.tokens("text")).cast("long").alias("n_tokens"))


@query
def str10_snippet(s, d):
    return docs(s, d).select("doc_id", text.snippet("text").alias("snippet"))


@query
def str12_id_number(s, d):
    return tables_graph(s, d).nodes.where("label = 'entity'").select("node_id", text.id_number("node_id").alias("number"))


@query
def jsn9_canonical(s, d):
    m = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("name"), "p_name")
    return table(s, d, "part").select("p_partkey", text.canonical_json(m).alias("json"))


@query
def hsh1_cache_key(s, d):
    return docs(s, d).groupBy("source").agg(text.cache_key(F.collect_list(F.md5("text"))).alias("key"))


@query
def lng1_detect(s, d):
    rows = docs(s, d).select("lang", language.detect("text")["lang"].alias("found"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("found")).alias("right"))


# vectors ----------------------------------------------------------------------------------------------------


@query
def vec13_topk(s, d):
    items = unit_vectors(s, d).select(F.col("vec_id").alias("id"), "vec")
    return vector.top_k(vector_queries(s, d), items, 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query
def vec19_filtered_topk(s, d):
    items = unit_vectors(s, d).where("label in (1, 2)").select(F.col("vec_id").alias("id"), "vec")
    return vector.top_k(vector_queries(s, d), items, 5).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query
def vec20_cosine(s, d):
    rows = vector.with_queries(unit_vectors(s, d), vector_queries(s, d))
    return rows.select("qid", "vec_id", F.round(F.greatest(F.lit(0.0), vector.cosine("qvec", "vec")), 6).alias("sim"))


@query
def vec27_centroid(s, d):
    c = vector.centroids(unit_vectors(s, d), "label")
    return c.select("label", F.posexplode("vec").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


# graph --------------------------------------------------------------------------------------------------------


@query
def grf1_neighbors(s, d):
    return tables_graph(s, d).edges.select("src", "dst").distinct()


@query
def grf2_3hop(s, d):
    g = tables_graph(s, d)
    starts = g.nodes.where("schema_type in ('customer', 'supplier')").select(F.col("node_id").alias("start"))
    return graph.hops(g.edges, starts, 3, shared_store(s))


@query
def grf5_paths(s, d):
    g = tables_graph(s, d)
    starts = g.nodes.where("schema_type = 'customer'").select("node_id")
    return graph.keyword_paths(g.edges, g.nodes.select("node_id", F.col("name").alias("text")), starts, ["asia", "europe"])


@query
def grf6_components(s, d):
    pairs = dedup.similar_pairs(unit_vectors(s, d), 0.30).select("a", "b")
    return graph.connected_components(pairs, shared_store(s))


@query
def grf8_chain(s, d):
    nxt = F.lead("p_partkey").over(Window.partitionBy("p_name").orderBy("p_partkey"))
    m = table(s, d, "part").select(F.col("p_partkey").alias("dup"), nxt.alias("canon")).where("canon is not null")
    return graph.resolved(m, shared_store(s))


@query
def grf13_jaccard(s, d):
    g = tables_graph(s, d)
    members = g.nodes.where("schema_type in ('supplier', 'nation')")
    return graph.jaccard(g.edges.where("relation = 'located_in'"), members).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def grf15_triple_strings(s, d):
    g = tables_graph(s, d)
    return graph.triple_strings(g.edges, g.nodes).groupBy("node_id").agg(F.count("*").alias("n"), F.min("triple").alias("first"))


@query
def grf17_integrity(s, d):
    g = tables_graph(s, d)
    some = g.nodes.where("label <> 'keyword'")  # so that brand edges dangle, and orders without customers stand alone
    return graph.issues(some, g.edges.where("relation not in ('contains', 'placed_by')")).groupBy("issue").agg(F.count("*").alias("n"))


@query
def grf20_isolated(s, d):
    g = tables_graph(s, d)
    return graph.without_isolated(g.nodes, g.edges.where("relation in ('placed_by', 'supplied_by')")).groupBy("label").agg(F.count("*").alias("n"))


# communities and dedup ------------------------------------------------------------------------------------------


@query
def clu1_kmeans(s, d):
    return communities.kmeans(unit_vectors(s, d)).groupBy("cluster").agg(F.count("*").alias("n"))


@query
def clu2_communities(s, d):
    v = unit_vectors(s, d)
    edges = v.select(F.col("node_id").alias("src"), F.concat(F.lit("vec_"), (F.col("vec_id") % 7).cast("string")).alias("dst"))
    return communities.communities(edges, v.select("node_id", "vec"), shared_store(s))


@query
def clu14_average_link(s, d):
    rows = unit_vectors(s, d).select(F.col("label").alias("grp"), F.col("vec_id").alias("pos"), "vec")
    return communities.average_link_groups(rows, 0.30)


@query
def ded1_semantic_tails(s, d):
    """Tails of each supplier and brand, clustered by the vector of their name."""
    names = part_entities(s, d).select("node_id", "name")
    vec = HashingEmbedder(64).embed(names.select("name").distinct(), "name", "name")
    own = names.join(vec, "name").select("node_id", "vec")
    brands = tables_graph(s, d).edges.where("relation = 'represented_by'").select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("brand_of").alias("relation"), "source_chunks")
    g = Graph(part_entities(s, d), brands.unionByName(supplies(s, d)))
    keep = dedup.semantic_triples(g, own, shared_store(s))
    return dedup.final_edges(g.edges, keep).groupBy("src").agg(F.count("*").alias("n"), F.sum("n_merged").alias("merged"))


@query
def ded7_final_edges(s, d):
    keep = part_entities(s, d).select(F.col("node_id").alias("dst"), text.normalize_name("name").alias("norm"), text.id_number("node_id").alias("num"))
    e = relational.first_seen(supplies(s, d), "src", "dst", "relation").join(keep, "dst")
    best = e.groupBy("src", "relation", "norm").agg(F.min_by("dst", "num").alias("keeper"))
    groups = e.join(best, ["src", "relation", "norm"]).select("src", "relation", "dst", "keeper")
    out = dedup.final_edges(supplies(s, d), groups)
    return out.select("edge_id", "src", "dst", "n_merged", F.size("source_chunks").cast("long").alias("n_chunks"))


@query
def ded16_exact_heads(s, d):
    return dedup.exact_heads(part_entities(s, d))


@query
def ded18_reassign(s, d):
    out = dedup.rewritten(tables_graph(s, d).edges, dedup.exact_heads(part_entities(s, d)))
    return out.select("edge_id", "src", "relation", "dst")


@query
def ded36_apply(s, d):
    g = tables_graph(s, d)
    out = dedup.apply_mapping(g, dedup.exact_heads(part_entities(s, d)), shared_store(s))
    return out.edges.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query
def ded24_alias_merge(s, d):
    g = tables_graph(s, d)
    out = dedup.merged_with_aliases(g, dedup.exact_heads(part_entities(s, d)), shared_store(s))
    return out.nodes.groupBy("label", F.coalesce("node_role", F.lit("none")).alias("role")).agg(F.count("*").alias("n"))


@query
def viz1_graph(s, d):
    g = tables_graph(s, d)
    return analytics.chart_nodes(g.nodes, g.edges)


# retrieval ------------------------------------------------------------------------------------------------------


@query
def ret18_inverted_index(s, d):
    index = retrieve.inverted_index(docs(s, d).select(F.col("doc_id").alias("node_id"), "text"))
    return index.groupBy("word").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


def keyword_found(s, d, q: DataFrame) -> DataFrame:
    """(qid, n, ids): how many documents the keywords (qid, keywords) find, and the sum of their ids."""
    index = retrieve.inverted_index(docs(s, d).select(F.col("doc_id").alias("node_id"), "text"))
    return retrieve.keyword_nodes(q, index).groupBy("qid").agg(F.count("*").alias("n"), F.sum("node_id").alias("ids"))


@query
def ret13_keyword_search(s, d):
    return keyword_found(s, d, table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_sort(text.tokens("text")).alias("keywords")))


@query
def ret12_community_path(s, d):
    v = unit_vectors(s, d)
    comm = vector.centroids(v, "label").withColumnRenamed("label", "community")
    return retrieve.community_path(vector_queries(s, d), comm, v.select(F.col("label").alias("community"), "node_id"), 2).select("qid", "node_id", "rank")


@query
def ret1_batch_retrieval(s, d):
    """The nearest nodes of each query vector, the triples that touch them and the chunks that belong to them."""
    v = unit_vectors(s, d)
    edges = v.select(F.col("vec_id").alias("edge_id"), F.col("node_id").alias("src"), F.lit("in_class").alias("relation"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("dst"))
    hit = vector.top_k(vector_queries(s, d), v.select(F.col("node_id").alias("id"), "vec"), 20, 0.05)
    rows = hit.join(edges, F.col("id") == F.col("src"))
    chunks = docs(s, d).select(F.concat(F.lit("vec_"), F.col("doc_id").cast("string")).alias("id"), F.char_length("text").cast("long").alias("chars"))
    return rows.join(chunks, "id", "left").select("qid", "rank", "id", "relation", "dst", F.coalesce("chars", F.lit(0)).alias("chars"))


@query
def ret8_text_retrieval(s, d):
    """Both retrieval paths for the benchmark's questions over the whole graph of the tables."""
    g, store, e = tables_graph(s, d), shared_store(s), HashingEmbedder(64)
    # unions of eight tables, which every stage would work out again
    nodes = store(g.nodes.select("node_id", "name", "description").withColumn("chunk_ids", F.array("name")), "graph_nodes")
    name = nodes.select("node_id", F.struct("name").alias("name")).hint("shuffle_hash")
    edges = g.edges.select("edge_id", "src", "relation", "dst")
    for end in ("src", "dst"):
        edges = edges.join(name.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_node")), end, "left")
    text = F.when(F.col("src_node").isNotNull() & F.col("dst_node").isNotNull(), F.concat_ws(",", "src_node.name", "relation", "dst_node.name"))
    edges = store(edges, "graph_edges").select("edge_id", "src", "relation", "dst", text.alias("text"))
    chunks = nodes.select(F.col("name").alias("chunk_id"), F.col("name").alias("text"))
    vectors = {
        "node": retrieve.TextVectors(nodes, "node_id", "name", e),
        "triple": retrieve.TextVectors(edges.where("text is not null"), "edge_id", "text", e),
        "chunk": retrieve.TextVectors(chunks, "chunk_id", "text", e),
    }
    q = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    q = store(q.join(e.embed(q, "qid", "question").withColumnRenamed("vec", "qvec"), "qid"), "q")
    out = retrieve.retrieve(q, nodes, edges, chunks, vectors, store)
    t = out["triples"].groupBy("qid").agg(F.count("*").alias("n_triples"))
    c = out["chunks"].groupBy("qid").agg(F.count("*").alias("n_chunks"))
    return t.join(c, "qid")


@query
def agt4_agent_loop(s, d):
    """In which region is each nation? Answered in two rounds by a rule that reads the retrieved lines."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    facts = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.concat(F.lit("region: "), "r_name").alias("fact"))
    q = n.select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("In which region is "), "n_name", F.lit("?")).alias("question"), "n_name")
    seen = F.regexp_extract("context", "region: ([A-Z ]+)", 1)
    rule = F.when(seen != "", F.concat(F.lit("So the answer is: "), seen)).otherwise(F.concat(F.lit("The new query is: "), F.regexp_extract("question", "is (.*)\\?", 1)))
    search = lambda todo: todo.join(facts, F.col("query") == F.col("key"), "left").select("qid", F.col("fact").alias("context"))
    return agent.answers(q, search, ExpressionModel({"answer": rule}), shared_store(s))
