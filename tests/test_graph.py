"""Graph operators, dedup and applying mappings on tiny graphs."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark import config
from kgspark.operators import communities, graph
from kgspark.plans import agent, construct, dedup
from kgspark.providers import ExpressionModel, HashingEmbedder, RecordedModel, complete_cached, same_name_rule
from kgspark.sources import graphs, texts
from kgspark.sources.graphs import Graph


def edges(spark, *rows):
    return spark.createDataFrame([(i, s, d, r, [f"c{i}"]) for i, (s, r, d) in enumerate(rows)], "edge_id long, src string, dst string, relation string, source_chunks array<string>")


def nodes(spark, *ids, label="entity"):
    schema = "node_id string, label string, level int, name string, description string, schema_type string, chunk_ids array<string>, members array<string>, node_role string, alias_of string, props map<string,string>"
    return spark.createDataFrame([(i, label, 2, n, None, None, [f"k{i}"], None, None, None, {"name": n}) for i, n in ids], schema)


def mapping(spark, *rows):
    return spark.createDataFrame(rows, "dup string, canon string")


def triples(df):
    return sorted((r["src"], r["relation"], r["dst"]) for r in df.collect())


def test_chains(spark, store):
    got = graph.resolved(mapping(spark, ("A", "B"), ("B", "C"), ("D", "C")), store)
    assert {(r["dup"], r["canon"]) for r in got.collect()} == {("A", "C"), ("B", "C"), ("D", "C")}


def test_chain_with_cycle(spark, store):
    got = {r["dup"]: r["canon"] for r in graph.resolved(mapping(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")), store).collect()}
    assert len(set(got.values())) == 1 and set(got) >= {"D"}


def test_components(spark, store):
    e = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (9, 1)], "a long, b long")
    assert {(r["node"], r["component"]) for r in graph.connected_components(e, store).collect()} == {(1, 1), (3, 1), (5, 1), (9, 1), (7, 7), (8, 7)}
    assert graph.connected_components(e.limit(0), store).count() == 0


def test_hops(spark, store):
    e = edges(spark, ("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "e"))
    got = graph.hops(e, spark.createDataFrame([("a",)], "start string"), 3, store)
    assert {(r["node_id"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_rewrite_replaces_both_ends(spark):
    e = edges(spark, ("A", "used_for", "C"), ("A", "solves", "D"), ("D", "needs", "A"), ("C", "x", "D"), ("B", "used_for", "C"), ("A", "r", "B"))
    got = dedup.rewritten(e, mapping(spark, ("A", "B")))
    assert triples(got) == [("B", "solves", "D"), ("B", "used_for", "C"), ("C", "x", "D"), ("D", "needs", "B")]
    assert sorted(got.where("relation = 'used_for'").first()["source_chunks"]) == ["c0", "c4"]


def test_rewrite_keeps_old_loops_and_parallel_edges(spark):
    e = edges(spark, ("X", "r", "X"), ("C", "r", "D"), ("C", "r", "D"))
    assert triples(dedup.rewritten(e, mapping(spark, ("A", "B")))) == [("C", "r", "D"), ("C", "r", "D"), ("X", "r", "X")]


def test_apply_with_and_without_aliases(spark, store):
    e = edges(spark, ("e0", "solution", "e1"), ("e0", "solution", "e2"), ("e0", "solution", "e3"))
    g = Graph(nodes(spark, ("e0", "head"), ("e1", "x"), ("e2", "y"), ("e3", "z")), e)
    m = mapping(spark, ("e2", "e1"), ("e3", "e1"))
    plain = dedup.apply_mapping(g, m, store, keep_aliases=False)
    assert triples(plain.edges) == [("e0", "solution", "e1")] and plain.nodes.count() == 2
    kept = dedup.apply_mapping(g, m, store)
    assert triples(kept.edges) == [("e0", "solution", "e1"), ("e1", "等同于", "e2"), ("e1", "等同于", "e3")]


def test_alias_merge_sets_roles(spark, store):
    g = Graph(nodes(spark, ("entity_1", "Acme"), ("entity_2", "ACME"), ("entity_3", "Paris")), edges(spark, ("entity_2", "in", "entity_3"), ("entity_1", "in", "entity_3")))
    m = dedup.exact_heads(g.nodes)
    assert [tuple(r) for r in m.collect()] == [("entity_2", "entity_1")]
    out = dedup.merged_with_aliases(g, m, store)
    assert triples(out.edges) == [("entity_1", "in", "entity_3"), ("entity_2", "等同于", "entity_1")]
    assert {r["node_id"]: r["node_role"] for r in out.nodes.collect()} == {"entity_1": "representative", "entity_2": "alias", "entity_3": None}
    assert graph.issues(out.nodes, out.edges, ("等同于",)).count() == 0
    gone = dedup.merged_with_aliases(g, m, store, v1=True)
    assert gone.nodes.count() == 2


def test_workflow_takes_all_similar_heads(spark, store):
    """Behind 1,225 pairs of equal vectors stand a chain whose ends aren't similar, and a pair of lower similarity."""
    vec = {i: [1.0, 0.0, 0.0, 0.0] for i in range(10, 60)} | {3: [0.0, 1.0, 0.0, 0.0], 5: [0.0, 1.0, 1.0, 0.0], 4: [0.0, 0.2, 1.0, 0.0], 2: [0.0, -1.0, 0.0, 0.9], 1: [0.0, -1.0, 0.0, 0.0], 70: [0.0] * 4, 71: [0.0] * 4}
    # similarities: 3 and 5 0.71, 4 and 5 0.83, 3 and 4 0.20, 1 and 2 0.74
    n = nodes(spark, *((f"entity_{i}", f"name {i}") for i in vec))
    e = edges(spark, *((f"entity_{i}", f"r{i}", "entity_99") for i in vec))
    vectors = spark.createDataFrame([(f"entity_{i}", v) for i, v in vec.items()], "node_id string, vec array<double>")
    g = Graph(n.unionByName(nodes(spark, ("entity_99", "end"))), e)
    want = {f"entity_{i}": "entity_10" for i in range(11, 60)} | {"entity_4": "entity_3", "entity_5": "entity_3", "entity_2": "entity_1"}
    assert {r["dup"]: r["canon"] for r in dedup.head_mapping(g, vectors, None, store, 0.7).collect()} == want
    out = dedup.workflow(g, vectors, None, lambda step: lambda df, name: store(df, f"{step}_{name}"))
    role = {r["node_id"] for r in out.nodes.where("node_role = 'alias'").collect()}
    assert role == {f"entity_{i}" for i in (*range(11, 60), 5)}  # at the workflow's own threshold of 0.75


def test_judged_pairs(spark):
    g = Graph(nodes(spark, ("entity_1", "Acme"), ("entity_2", "acme."), ("entity_3", "Paris")), edges(spark, ("entity_1", "in", "entity_3")))
    pairs = spark.createDataFrame([("entity_1", "entity_2", 0.9), ("entity_1", "entity_3", 0.8)], "a string, b string, sim double")
    got = dedup.judged_pairs(pairs, g.nodes, g.edges, ExpressionModel({"coreference": same_name_rule()}))
    assert [(r["dup"], r["canon"]) for r in got.collect()] == [("entity_2", "entity_1")]


def test_json_round_trip(spark, tmp_path):
    end = lambda label, name: {"label": label, "properties": {"name": name}}
    rows = [{"start_node": end("entity", "a"), "relation": "r", "end_node": end("attribute", "b")}, {"start_node": end("entity", "a"), "relation": "s", "end_node": end("entity", "c")}]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    g = graphs.load(spark, str(tmp_path / "g.json"))
    assert {r["node_id"]: (r["name"], r["level"]) for r in g.nodes.collect()} == {"entity_0": ("a", 2), "attribute_1": ("b", 1), "entity_2": ("c", 2)}
    graphs.save(g, str(tmp_path / "out.json"))
    again = graphs.graph_of(spark.read.schema("start_node struct<label:string,properties:map<string,string>>, relation string, end_node struct<label:string,properties:map<string,string>>").json(str(tmp_path / "out.json")))
    assert again.edges.count() == 2 and again.nodes.count() == 3
    graphs.save(g, str(tmp_path / "x.graphml"))
    with pytest.raises(ValueError):
        graphs.load(spark, "graph.txt")


def test_chunk_sources(spark, tmp_path):
    got = texts.chunks_from_content(spark, "id: a\tChunk: one\nnoise\nid: b\tChunk: two\nid: a\tChunk: three")
    assert {(r["chunk_id"], r["text"]) for r in got.collect()} == {("a", "three"), ("b", "two")}
    path = str(tmp_path / "chunks")
    texts.save_chunks(spark, spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, text string"), path)
    out = texts.save_chunks(spark, spark.createDataFrame([("b", "3")], "chunk_id string, text string"), path)
    assert {(r["chunk_id"], r["text"]) for r in out.collect()} == {("a", "1"), ("b", "3")}
    assert texts.cached(spark, str(tmp_path / "none")) is None


def test_build_from_answers(spark):
    docs = spark.createDataFrame([(1, "t", "Ann lives in Oslo")], "doc_id long, title string, text string")
    answer = json.dumps({"attributes": {"Ann": ["tall"]}, "triples": [["Ann", "lives_in", "Oslo"], ["bad"]], "entity_types": {"Ann": "person"}})
    g, chunks, failed = construct.build(docs, ExpressionModel({"extraction": F.lit(answer)}))
    assert g.nodes.count() == 3 and chunks.count() == 1 and failed.count() == 0
    assert sorted(r["relation"] for r in g.edges.collect()) == ["has_attribute", "lives_in"]


def test_average_link():
    import numpy as np

    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.05, 1]])
    assert communities.average_link(v, 0.9) == [0, 0, 1, 1]
    assert communities.average_link(v[:1], 0.9) == [0]


def test_average_link_of_a_large_group(spark):
    """Opposite signs in 16 small components, and equal vectors, among more than 2000 entries of one group."""
    import numpy as np

    rng = np.random.default_rng(5)
    vec = np.concatenate([rng.normal(0, 0.01, (2400, 16)), np.repeat(np.eye(3), 800, 0)], 1)
    vec[::2] = np.r_[np.zeros(16), 1, 0, 0]
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vec)], "grp int, pos long, vec array<double>")
    got = {r["pos"]: r["cluster"] for r in communities.average_link_groups(rows, 0.5).collect()}
    assert got == {i: 0 if i % 2 == 0 else i // 800 for i in range(2400)}


def test_average_link_against_all_distances():
    import numpy as np

    rng = np.random.default_rng(6)
    vec = np.repeat(rng.normal(size=(60, 4)), rng.integers(1, 4, 60), 0)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    d, groups = 1 - unit @ unit.T, [[i] for i in range(len(vec))]
    while len(groups) > 1:
        best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] >= 0.6:
            break
        groups[best[1]] += groups.pop(best[2])
    got = communities.average_link(vec, 0.4)
    first, n = np.unique(vec, axis=0, return_index=True)[1], np.unique(vec, axis=0, return_counts=True)[1]
    order = np.argsort(first)
    weighted = communities.average_link(vec[first[order]], 0.4, n[order])
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(np.array(got) == c).tolist()) for c in set(got)}
    assert weighted == [got[i] for i in first[order]]


def test_greedy_pairs():
    assert communities.greedy_pairs([(0.9, 0, 1), (0.8, 1, 2), (0.6, 2, 3), (0.4, 4, 5)], dict.fromkeys(range(6), 1)) == [(0, 1), (2, 3)]


def test_models_and_cache(spark):
    calls = spark.createDataFrame([("1", "k", "p1"), ("2", "k", "p2")], "call_id string, kind string, prompt string")
    answers, new = complete_cached(ExpressionModel({"k": F.upper("prompt")}), calls, None)
    assert {r["response"] for r in answers.collect()} == {"P1", "P2"}
    recorded = RecordedModel(new)
    assert recorded.complete(calls).where("error is not null").count() == 0
    again, fresh = complete_cached(ExpressionModel({}), calls, new)
    assert fresh.count() == 0 and again.where("response is null").count() == 0


def test_embedder(spark):
    rows = spark.createDataFrame([("a", "hello"), ("b", "hello"), ("c", "")], "k string, t string")
    got = {r["k"]: r["vec"] for r in HashingEmbedder(16).embed(rows, "k", "t").collect()}
    assert got["a"] == got["b"] and not any(got["c"])


def test_agent_stops(spark, store):
    q = spark.createDataFrame([(1, "q?")], "qid long, question string")
    never = ExpressionModel({"answer": F.concat(F.lit("The new query is: "), "query", F.lit("x"))})
    out = agent.answers(q, lambda todo: todo.select("qid", F.lit("ctx").alias("context")), never, store, max_steps=3)
    assert out.first()["steps"] == 3


def test_settings():
    s = config.override(config.Settings(), {"retrieval": {"top_k": 5}})
    assert s.retrieval.top_k == 5
    with pytest.raises(ValueError):
        config.override(config.Settings(), {"retrieval": {"top_k": 0}})
    with pytest.raises(ValueError):
        s.prompt("a", "b")


def test_stream_counts(spark, tmp_path):
    from kgspark.streaming.ingest import distinct_triples

    path = str(tmp_path / "in")
    spark.createDataFrame([("a", "b", "r", "2024-01-01 00:00:00"), ("a", "b", "r", "2024-01-01 00:01:00"), ("a", "c", "r", "2024-01-01 00:02:00")], "src string, dst string, relation string, ts string").write.parquet(path)
    stream = spark.readStream.schema("src string, dst string, relation string, ts string").parquet(path)
    q = distinct_triples(stream).writeStream.format("memory").queryName("distinct_triples").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("distinct_triples").count() == 2


def test_preloaded_clusters(spark):
    rows = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2), ("h", 0), ("h", 1)], "grp string, pos long")
    stored = spark.createDataFrame([("g", 0, 0), ("g", 1, 1)], "grp string, pos long, cluster int")
    got = {(r["grp"], r["pos"]): r["cluster"] for r in dedup.preloaded_clusters(rows, stored).collect()}
    assert got == {("g", 0): 0, ("g", 1): 1, ("g", 2): 2, ("h", 0): 0, ("h", 1): 0}


def test_chunk_context_and_profile(spark):
    from kgspark.functions.text import enhanced_query
    from kgspark.plans import analytics

    n = spark.createDataFrame([("a", ["x", "k"])], "node_id string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("k", "long text")], "chunk_id string, text string")
    assert [tuple(r) for r in dedup.chunk_context(n, chunks, 4).collect()] == [("a", "long")]
    sizes = spark.createDataFrame([(1, 3), (2, 1)], "cluster_id int, size int")
    r = analytics.before_after(analytics.cluster_profile(sizes)).first()
    assert (r["total"], r["merged"], r["kept"], r["kept_share"]) == (4, 2, 2, 0.5)
    q = spark.createDataFrame([("Where is the big tower?",)], "q string").select(enhanced_query("q").alias("e")).first()["e"]
    assert q == "Where is the big tower? Key terms: big, tower"


def test_tail_rows_carry_no_vectors(spark, store):
    """Edges are written with the kind of their tail's vector, whatever the vector's length; the clusters are those of the vectors."""
    seen = {}

    def noted(df, name):
        seen[name] = df.columns
        return store(df, name)

    e = edges(spark, ("H", "r", "a"), ("H", "r", "b"), ("H", "r", "c"), ("G", "r", "a"), ("H", "s", "b"), ("H", "s", "d"), ("H", "r", "a"))
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(300)]
    vec = spark.createDataFrame([("a", axis(0)), ("b", axis(1)), ("c", axis(0)), ("d", axis(1))], "node_id string, vec array<double>")
    got = dedup.semantic_triples(Graph(None, e), vec, noted)
    assert {(r["src"], r["relation"], r["dst"], r["keeper"]) for r in got.collect()} == {("H", "r", "a", "a"), ("H", "r", "b", "b"), ("H", "r", "c", "a"), ("H", "s", "b", "b"), ("H", "s", "d", "b")}
    assert "vec" not in seen["tail_rows"]


def test_steps_agree_with_paths(spark, store):
    """Chains, a ring with a long tail, a ring of two and a branch: ends, lengths and cycles are those of the whole paths."""
    tail = [(f"t{i:02}", f"t{i + 1:02}") for i in range(20)] + [("t20", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    rows = [("A", "B"), ("B", "C"), ("C", "D"), ("E", "C"), ("P", "Q"), ("Q", "P"), ("S", "S"), *tail]
    want = {(r["dup"], r["root"], len(r["path"]), r["cyclic"]) for r in graph.paths_to_root(mapping(spark, *rows), store).collect()}
    got = {(r["dup"], r["root"], r["steps"], r["cyclic"]) for r in graph.steps_to_root(mapping(spark, *rows), store).collect()}
    assert got == want and len(got) == len(rows) - 1
    assert graph.steps_to_root(mapping(spark, *rows).limit(0), store).count() == 0


def test_batches_of_texts_have_the_vectors_of_each(spark):
    texts = ["part one", "", None, "[Error x]", "Ünïcödé 漢字 😀", "a", "part one", "x" * 500, "order 12,supplied_by,y"]
    one = HashingEmbedder(64)
    assert [v.tolist() for v in one.vectors(texts)] == [one.vector(t).tolist() for t in texts]
    assert one.vectors(["", None]).tolist() == [[0.0] * 64] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(1)
    one.vector = None  # rows go through batches
    got = {r["k"]: r["vec"] for r in one.embed(rows, "k", "t").collect()}
    assert got == {k: HashingEmbedder(64).vector(t).tolist() for k, t in enumerate(texts)}
