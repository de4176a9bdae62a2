"""More of the engine's operators as queries over the driver's tables: sources and sinks, text, JSON, filters, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text, vector
from kgspark.operators import projections, relational
from kgspark.plans import agent, analytics, construct, dedup
from kgspark.providers import ExpressionModel, RecordedModel, complete_cached, linear
from kgspark.queries import docs, part_entities, query, supplies, table, tables_graph, unit_vectors, vector_queries
from kgspark.sources import graphs, texts
from kgspark.sources.graphs import Graph
from kgspark.store import shared_folder, shared_store


def places(s, d) -> Graph:
    """The part of the tables' graph about regions, nations, customers and suppliers."""
    g = tables_graph(s, d)
    return Graph(g.nodes.where("schema_type in ('region', 'nation', 'customer', 'supplier')"), g.edges.where("relation in ('part_of', 'located_in')"))


def named_edges(g: Graph) -> DataFrame:
    rows = relational.with_ends(g.edges, g.nodes, "name", "label")
    return rows.select("src_label", "src_name", "relation", "dst_label", "dst_name")


def part_names(s, d) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.col("p_name").alias("text"), "p_partkey")


# sources and sinks ------------------------------------------------------------------------------------------


@query
def src1_json_round_trip(s, d):
    path = shared_folder(s) + "/graph.json"
    graphs.save(places(s, d), path)
    return named_edges(graphs.load(s, path))


@query
def src2_graphml_round_trip(s, d):
    path = shared_folder(s) + "/graph.graphml"
    graphs.save(places(s, d), path)
    return graphs.load(s, path).nodes.select("node_id", "label", "level", "name", "schema_type")


@query
def src2_graphml_edges(s, d):
    path = shared_folder(s) + "/graph.graphml"
    graphs.save(places(s, d), path)
    return graphs.load(s, path).edges.select("src", "dst", "relation")


@query
def src3_parquet_round_trip(s, d):
    path = shared_folder(s) + "/graph.parquet"
    graphs.save(tables_graph(s, d), path)
    return graphs.load(s, path).edges.groupBy("relation").agg(F.count("*").alias("n"), F.min("edge_id").alias("first"), F.count_distinct("src").alias("sources"))


@query
def src4_corpus_scan(s, d):
    path = shared_folder(s) + "/corpus.json"
    docs(s, d).select(F.col("source").alias("title"), "text").write.json(path)
    return texts.corpus(s, path).groupBy("title").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("first"), F.sum(F.char_length("text")).alias("chars"))


@query
def src6_chunk_mapping(s, d):
    path = shared_folder(s) + "/chunks"
    rows = part_names(s, d)
    line = F.concat(F.lit("id: "), "chunk_id", F.lit("\tChunk: "), "text")
    rows.where("p_partkey % 2 = 0").select(line).write.text(f"{path}/a.txt")
    rows.where("p_partkey % 2 = 1").select(F.concat("chunk_id", F.lit("\t"), "text")).write.text(f"{path}/b.txt")
    return texts.chunk_mapping(s, path)


@query
def src9_questions(s, d):
    path = shared_folder(s) + "/qa.json"
    table(s, d, "benchmark").select(F.col("text").alias("question"), F.col("item_id").cast("string").alias("answer")).write.json(path)
    return texts.questions(s, path).select(F.md5("question").alias("question"), "answer")


@query
def snk6_chunk_upsert(s, d):
    path, rows = shared_folder(s) + "/chunks.parquet", part_names(s, d)
    texts.save_chunks(s, rows.where("p_partkey % 3 <> 0").select("chunk_id", "text"), path)
    return texts.save_chunks(s, rows.where("p_partkey % 2 = 0").select("chunk_id", F.upper("text").alias("text")), path)


@query
def snk7_evolved_ontology(s, d):
    p = table(s, d, "part")
    known = p.where("p_partkey % 2 = 0").select(F.lit("node").alias("kind"), F.col("p_type").alias("type_name")).distinct()
    return texts.evolved(known, p.select(F.lit("node").alias("kind"), F.col("p_type").alias("type_name")).union(p.select(F.lit("attribute"), "p_brand")))


def head_merges(s, d) -> DataFrame:
    """Merges of parts by name, with a confidence from 0 to 0.99 by number."""
    m = dedup.exact_heads(part_entities(s, d))
    return m.select("dup", "canon", F.lit("exact").alias("method"), ((text.id_number("dup") % 100) / 100.0).alias("confidence"), F.lit("same name").alias("rationale"))


@query
def snk8_review_export(s, d):
    path = shared_folder(s) + "/review"
    texts.export_review(head_merges(s, d), path)
    return s.read.csv(path, header=True, schema="dup string, canon string, method string, confidence double, rationale string").select("dup", "canon", "confidence")


@query
def snk9_alias_export(s, d):
    path = shared_folder(s) + "/aliases"
    texts.export_aliases(part_entities(s, d), head_merges(s, d), path)
    kind = "representative string, representative_name string, alias string, alias_name string, confidence double, method string"
    return s.read.csv(path, header=True, schema=kind)


@query
def snk10_answer_cache(s, d):
    """Calls whose prompts are in a saved cache of answers are not made again."""
    path = shared_folder(s) + "/answers"
    prompts = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("call_id"), F.lit("echo").alias("kind"), F.col("n_name").alias("prompt"), F.col("n_regionkey").alias("r"))
    old = prompts.where("r < 2").select(text.prompt_hash("prompt").alias("prompt_hash"), F.concat(F.lit("old "), "prompt").alias("response"))
    known = texts.cache(old, path)
    answers, new = complete_cached(ExpressionModel({"echo": F.concat(F.lit("new "), "prompt")}), prompts, known)
    return answers.join(new.agg(F.count("*").alias("made")), how="cross").select("call_id", "response", "made")


@query
def snk12_embedding_cache(s, d):
    path = shared_folder(s) + "/vectors"
    texts.cache(unit_vectors(s, d).select("node_id", "vec", "label"), path, "label")
    return texts.cached(s, path).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("vec", 1).cast("double")), 5).alias("x"))


@query
def snk15_index_cache(s, d):
    path = shared_folder(s) + "/index"
    texts.cache(part_names(s, d).select(F.explode(text.tokens("text")).alias("word"), "chunk_id"), path)
    return texts.cached(s, path).groupBy("word").agg(F.count("*").alias("n"))


@query
def snk18_cleared_caches(s, d):
    path = shared_folder(s)
    n = table(s, d, "nation").select("n_name")
    for name in ("a_faiss", "b_faiss", "c_other"):
        texts.cache(n, f"{path}/{name}")
    gone = texts.clear(s, f"{path}/*_faiss")
    left = texts.cached(s, f"{path}/c_other").count()
    return n.agg(F.lit(gone).alias("gone"), F.lit(texts.cached(s, f"{path}/a_faiss") is None).alias("missing"), (F.count("*") - left).alias("lost"))


@query
def snk21_datasets(s, d):
    up = table(s, d, "nation").select(F.lower("n_name").alias("name"))
    return texts.datasets(up, table(s, d, "nation").where("n_regionkey = 1").select(F.lower("n_name").alias("name")))


@query
def src23_restored_answers(s, d):
    """Stored groups as the answers they came from, and those parsed again."""
    rows = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("cluster_id")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    member = F.transform(F.sequence(F.lit(0), F.size("k") - 1), lambda i: F.struct(F.array(i).alias("members"), F.lit(None).cast("int").alias("representative"), F.lit("kept").alias("rationale")))
    back = texts.restored_answers(rows.select("cluster_id", F.lit(0).alias("batch"), member.alias("groups")))
    return back.select("cluster_id", F.explode(text.parsed("response", text.GROUPS)["groups"]).alias("g")).select("cluster_id", F.col("g.members")[0].alias("member"), text.representative(F.col("g")).alias("representative"))


# projections and filters -----------------------------------------------------------------------------------------


@query
def prj2_clean_text(s, d):
    return docs(s, d).select("doc_id", F.md5(projections.clean_text("text")).alias("clean"))


@query
def prj5_extraction_graph(s, d):
    """A graph of records as a model would extract them: each nation in its region, with its key as attribute."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    answer = F.to_json(F.struct(
        F.create_map("n_name", F.array(F.concat(F.lit("key: "), F.col("n_nationkey").cast("string")))).alias("attributes"),
        F.array(F.array(F.col("n_name"), F.lit("lies in"), F.col("r_name"), F.lit("and more")), F.array(F.col("n_name"), F.lit("too short"))).alias("triples"),
        F.create_map("n_name", F.lit("country"), "r_name", F.lit("region")).alias("entity_types"),
    ))
    answers = n.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("call_id"), F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("response"))
    g = construct.graph_of_extractions(construct.extracted(answers))
    rows = relational.with_ends(g.edges, g.nodes, "name", "schema_type")
    return rows.select("src_name", "src_schema_type", "relation", "dst_name", "dst_schema_type", F.concat_ws(",", "source_chunks").alias("chunks"))


@query
def prj10_built_graph(s, d):
    """Construction end to end: chunks, prompts, answers, graph; a document without an answer fails alone."""
    rows = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws("|", "p_name", "p_brand").alias("text"))
    part = F.split("text", r"\|")
    rule = F.when(~F.col("text").contains("#13"), F.to_json(F.struct(F.create_map().cast("map<string,array<string>>").alias("attributes"), F.array(F.array(part[0], F.lit("has brand"), part[1])).alias("triples"), F.create_map(part[0], F.lit("part")).alias("entity_types"))))
    g, chunks, failed = construct.build(rows, ExpressionModel({"extraction": rule}))
    out = relational.with_ends(g.edges, g.nodes, "name").groupBy(F.col("dst_name").alias("brand")).agg(F.count("*").alias("n"))
    return out.union(failed.agg(F.lit("failed"), F.count("*"))).union(chunks.agg(F.lit("chunks"), F.count("*")))


@query
def flt1_levels(s, d):
    return tables_graph(s, d).nodes.where("level in (3, 4)").select("node_id", "level", "label")


@query
def flt3_score_threshold(s, d):
    items = unit_vectors(s, d).select(F.col("vec_id").alias("id"), "vec")
    return vector.top_k(vector_queries(s, d), items, 50, 0.2).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.min("score"), 5).alias("least"))


@query
def flt4_valid_text(s, d):
    k = F.col("p_partkey") % 5
    rows = table(s, d, "part").select("p_partkey", F.when(k == 0, "[Error: none]").when(k == 1, "").when(k == 2, F.lit(None).cast("string")).when(k == 3, "[Unknown node]").otherwise(F.col("p_name")).alias("t"))
    return rows.where(projections.has_text("t")).select("p_partkey")


@query
def flt5_shown_triples(s, d):
    g = tables_graph(s, d)
    some = g.edges.where("relation in ('part_of', 'represented_by', 'has_attribute')")
    return projections.shown_triples(some, g.nodes.withColumn("props", F.map_filter("props", lambda k, v: k == "segment")))


@query
def prj27_scored_triples(s, d):
    g = tables_graph(s, d)
    scored = g.edges.where("relation = 'part_of'").withColumn("score", (F.col("edge_id") % 7) / 10.0)
    return projections.shown_triples(scored, g.nodes.withColumn("props", F.map_filter("props", lambda k, v: F.lit(False))), "score")


@query
def flt7_alias_nodes(s, d):
    n = part_entities(s, d).withColumn("node_role", F.when(text.id_number("node_id") % 3 == 0, "alias").when(text.id_number("node_id") % 3 == 1, "representative"))
    alias = n.where(projections.is_alias()).select("node_id", F.lit(True).alias("is_alias"))
    return alias.union(projections.main_entities(n).select("node_id", F.lit(False)))


@query
def prj13_node_text(s, d):
    n = tables_graph(s, d).nodes
    k = text.id_number("node_id")
    n = n.withColumn("name", F.when(k % 4 != 0, F.col("name"))).withColumn("description", F.when(k % 2 == 0, F.concat(F.lit("about "), "label")))
    return n.select("node_id", projections.node_name(n).alias("name"), projections.node_text().alias("text"), projections.short_node_text().alias("short"))


@query
def prj15_node_properties(s, d):
    return tables_graph(s, d).nodes.select("node_id", projections.node_properties().alias("properties"), projections.describe_node(for_clustering=True).alias("described"))


@query
def prj20_chunk_ids(s, d):
    by = supplies(s, d).groupBy("dst").agg(F.collect_list(F.concat(F.array(F.lit("")), "source_chunks")).alias("c"))
    return by.select("dst", F.concat_ws(",", projections.merged_chunk_ids(F.flatten("c"))).alias("chunk_ids"))


@query
def prj24_level_report(s, d):
    g = tables_graph(s, d)
    return projections.report(g.nodes.where("schema_type in ('region', 'nation') or label in ('keyword', 'attribute')"))


@query
def prj25_subgraph_text(s, d):
    g = tables_graph(s, d)
    return projections.subgraph_text(g.nodes.where("schema_type in ('region', 'nation')"), g.edges.where("relation = 'part_of'")).select(F.col("text"))


# joins and aggregations ----------------------------------------------------------------------------------------


@query
def join18_preloaded_clusters(s, d):
    rows = table(s, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("pos"))
    stored = rows.where("grp % 3 <> 0 and pos % 5 <> 0").select("grp", "pos", (F.col("pos") % 2).cast("int").alias("cluster"))
    return dedup.preloaded_clusters(rows, stored).select("grp", "pos", "cluster")


@query
def join21_similar_edge(s, d):
    pairs = table(s, d, "part").select(F.concat(F.lit("supplier_"), (F.col("p_partkey") % 50 + 1).cast("string")).alias("src"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("dst"), F.lit("supplies").alias("relation"))
    return relational.similar_edge(pairs, supplies(s, d)).select("src", "dst", F.coalesce("edge_id", F.lit(-1).cast("long")).alias("edge_id"))


@query
def join22_prompt_response(s, d):
    """Recorded answers by the hash of their prompts; a prompt without one is an error."""
    p = table(s, d, "nation").select(F.col("n_nationkey").alias("call_id"), F.lit("any").alias("kind"), F.col("n_name").alias("prompt"))
    recorded = p.where("call_id % 2 = 0").select(text.prompt_hash("prompt").alias("prompt_hash"), F.reverse("prompt").alias("response"))
    return RecordedModel(recorded).complete(p)


@query
def agg8_run_stats(s, d):
    return analytics.run_stats(part_entities(s, d), head_merges(s, d).withColumn("method", F.when(text.id_number("dup") % 2 == 0, "exact").otherwise("semantic"))).withColumn("reduction_rate", F.round("reduction_rate", 5))


@query
def agg13_before_after(s, d):
    sizes = table(s, d, "part").groupBy(text.normalize_name("p_name").alias("cluster_id")).agg(F.count("*").alias("size"))
    return analytics.before_after(analytics.cluster_profile(sizes)).select("total", "merged", "kept", F.round("kept_share", 6).alias("kept_share"))


@query
def agg15_merged_values(s, d):
    """Tails of each (head, relation), one as it is, several as a list."""
    e = supplies(s, d).select("src", "dst").distinct()
    return e.groupBy("src").agg(text.merged_values(F.array_sort(F.collect_list("dst"))).alias("tails"))


@query
def agg17_detector_accuracy(s, d):
    """Accuracy of language detection over all documents, for long and short texts apart."""
    from kgspark.functions import language

    rows = docs(s, d).select("lang", "text", F.when(F.char_length("text") > 100, "long").otherwise("short").alias("length"))
    return language.evaluated(rows, "text", "lang", "length")


@query
def agg18_graph_stats(s, d):
    g = tables_graph(s, d)
    return analytics.graph_stats(g.nodes, g.edges)


@query
def top10_chart_links(s, d):
    g = tables_graph(s, d)
    return analytics.chart_links(g.nodes, g.edges)


@query
def set13_united(s, d):
    """Results of sub-questions by their parent, each entry once with its best score."""
    from kgspark.plans.retrieve import united

    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("sub"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("score"))
    return united(rows, F.col("sub") % 10, "part")


# text and JSON -------------------------------------------------------------------------------------------------------


@query
def str4_triple_strings(s, d):
    rows = table(s, d, "part").select("p_partkey", F.concat(F.lit("("), "p_name", F.lit(" [brand: "), "p_brand", F.lit(", type: "), "p_type", F.lit("], is, thing, really)"), F.when(F.col("p_partkey") % 2 == 0, F.format_string(" [score: %.2f]", (F.col("p_partkey") % 100) / 100.0)).otherwise("")).alias("t"))
    p = rows.select("p_partkey", text.parse_triple("t").alias("p"))
    return p.select("p_partkey", "p.head", "p.relation", "p.tail", F.round("p.score", 2).alias("score"))


@query
def str7_cleaned_answers(s, d):
    rows = table(s, d, "nation").select("n_nationkey", F.concat(F.lit("​ Sure:\r\n```json\n{\"name\": \""), "n_name", F.lit("\"}\n```  ")).alias("t"))
    return rows.select("n_nationkey", text.clean_llm_text("t").alias("clean"))


@query
def str8_keyword_score(s, d):
    words = F.array(F.lit("the"), F.lit("and"), F.lit("ch"), F.lit("xyzzy"), F.lit("the"))
    return docs(s, d).select("doc_id", text.keyword_score("text", words).alias("score"))


@query
def str11_dataset_names(s, d):
    return table(s, d, "part").select("p_partkey", text.dataset_name(F.concat(F.lit("a/b "), "p_name", F.lit(".json ("), "p_brand", F.lit(") -x  "))).alias("name"))


@query
def str13_answers_and_queries(s, d):
    k = F.col("n_nationkey") % 3
    said = F.when(k == 0, F.concat(F.lit("I think. So the ANSWER is:  "), "n_name", F.lit("\nyes "))).when(k == 1, F.concat(F.lit("The new query is: where is "), "n_name", F.lit("? \nmore"))).otherwise(F.col("n_name"))
    return table(s, d, "nation").select("n_nationkey", text.final_answer(said).alias("answer"), text.new_query(said).alias("query"))


@query
def str14_rationale_flags(s, d):
    k = F.col("n_nationkey") % 4
    why = F.when(k == 0, "Belongs to group 3, same entity as member 2.").when(k == 1, "The same as cluster 4 but should stay separate.").when(k == 2, "与组1/组2的成员应该合并").otherwise("Unrelated.")
    members = F.when(F.col("n_nationkey") % 8 < 4, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    return table(s, d, "nation").select("n_nationkey", text.rationale_flag(why, members).alias("flag"), F.concat_ws(",", text.rationale_numbers(why)).alias("numbers"))


@query
def jsn3_cluster_answers(s, d):
    """Clusters in a model's answer, 1-based, some out of range or named twice; the rest on their own."""
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").cast("int").alias("n"))
    said = F.concat(F.lit('{"clusters": [{"members": [1, 2, 99]}, {"members": [2, 3]},]}'))
    g = n.select("n_regionkey", text.member_groups(text.parsed(said, text.CLUSTERS)["clusters"], F.col("n"), 10).alias("g"))
    return g.select("n_regionkey", F.posexplode("g").alias("cluster", "m")).select("n_regionkey", "cluster", F.concat_ws(",", "m").alias("members"))


@query
def jsn6_coreference_answers(s, d):
    k = F.col("n_nationkey") % 4
    said = F.when(k == 0, F.concat(F.lit("{'is_coreferent': true, 'confidence': 0.9, 'representative': '"), "n_name", F.lit("'}"))).when(k == 1, '{"is_coreferent": true, "confidence": 0.5}').when(k == 2, "no JSON").otherwise('{"is_coreferent": false, "preferred_representative": "x"}')
    return table(s, d, "nation").select("n_nationkey", text.coreference(said).alias("c")).select("n_nationkey", "c.is_coreferent", F.round("c.confidence", 2).alias("confidence"), "c.representative")


@query
def jsn8_decompositions(s, d):
    """Sub-questions of each nation's question; one that can't be split is its own part."""
    q = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"))
    split = F.concat(F.lit('{"sub_questions": [{"sub-question": "a '), "question", F.lit('"}, {"sub-question": "b"}], "involved_types": {"nodes": ["country"]}}'))
    model = ExpressionModel({"decomposition": F.when(F.col("call_id") % 2 == 0, split).otherwise("none")})
    return agent.decompose(q, model).select("qid", "pos", "sub_question", F.size("nodes").alias("types"))


@query
def hsh2_prompt_hash(s, d):
    return table(s, d, "benchmark").select("item_id", text.prompt_hash("text").alias("hash"))


@query
def val3_group_issues(s, d):
    """What is wrong with dedup groups made of the nations, some of them broken on purpose."""
    k = F.col("n_nationkey") % 5
    head = F.when(k != 0, F.struct(F.when(k != 1, "entity").alias("label"), F.create_map(F.lit("name"), F.col("n_name")).alias("properties")))
    size = F.when(k == 2, F.array(F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("two")))
    results = F.when(k != 3, F.create_map(F.lit("cluster_0"), F.struct(size.alias("member"), F.lit("why").alias("llm_judge_reason"))))
    return table(s, d, "nation").select("n_nationkey", F.concat_ws("; ", text.group_issues(head, F.when(k != 4, "likes"), results)).alias("issues"))


@query
def val5_member_issues(s, d):
    k = F.col("n_nationkey") % 4
    member = F.when(k == 0, F.concat("n_name", F.lit(" (chunk id: c1) [entity]"))).when(k == 1, F.col("n_name")).when(k == 2, F.concat("n_name", F.lit(" [entity]"))).otherwise(" (chunk id: c1) [entity]")
    return table(s, d, "nation").select("n_nationkey", F.concat_ws("; ", text.member_issues(member)).alias("issues"))


@query
def vec24_dim_transform(s, d):
    matrix = [[float((i * 3 + j) % 5 - 2) for j in range(4)] for i in range(64)]
    return unit_vectors(s, d).select("vec_id", F.posexplode(linear("vec", matrix)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 5).alias("x"))


@query
def evl1_judged_answers(s, d):
    """A model's verdict on answers, and that by equal names where there is no model."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("question"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise("wrong").alias("answer"), "n_name")
    gold = n.select("qid", F.concat("n_name", F.lit(".")).alias("answer"))
    by_model = agent.judged(n, gold, ExpressionModel({"judge": F.when(F.length("answer") > 5, "1").otherwise(" 0 ")}))
    return agent.judged(n, gold).select("qid", "correct").join(by_model.select("qid", F.col("correct").alias("by_model")), "qid")


def stored_graph(s, g: Graph) -> Graph:
    store = shared_store(s)
    return Graph(store(g.nodes, "nodes"), store(g.edges, "edges"))
