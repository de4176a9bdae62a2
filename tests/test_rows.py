"""Functions whose results SQL can't express, or that need odd inputs: brute force and small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.functions import language, vector
from kgspark.operators import graph, relational
from kgspark.operators.communities import single_link, single_link_groups
from kgspark.plans import analytics, clustering, dedup, retrieve
from kgspark.providers import ExpressionModel, HashingEmbedder
from kgspark.sources import graphs, texts


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "dup string, canon string")


def test_single_link_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    clusters = []
    for i, v in enumerate(x):
        at = next((c for c in clusters if any(float(x[j] @ v) >= 0.8 for j in c)), None)
        if at is None:
            clusters.append(at := [])
        at.append(i)
    want = {i: k for k, c in enumerate(clusters) for i in c}
    assert single_link(x, 0.8) == [want[i] for i in range(60)]
    rows = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "grp string, pos long, vec array<double>")
    assert {r["pos"]: r["cluster"] for r in single_link_groups(rows, 0.8).collect()} == want


def test_frequent_node_represents(spark, store):
    """A stands in three pairs and becomes the representative, whichever side it was on."""
    got = graph.frequent_roots(pairs(spark, ("A", "B"), ("A", "C"), ("D", "A"), ("x", "y")), store).collect()
    assert {tuple(r) for r in got} == {("B", "A"), ("C", "A"), ("D", "A"), ("x", "y")}


def test_paths_and_cycles(spark, store):
    got = graph.paths_to_root(pairs(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "r"), ("r", "q"), ("s", "s")), store).collect()
    by = {r["dup"]: (r["path"], r["cyclic"]) for r in got}
    assert by["a"] == (["b", "c", "d"], False) and by["c"] == (["d"], False) and "s" not in by
    assert by["p"] == (["q", "r", "q"], True) and by["q"] == (["r", "q"], True)


def test_alias_conflicts(spark, store):
    """The graph says that b is an alias of a; a judged pair c -> b then means c -> a, and b -> z moves a to z."""
    edges = spark.createDataFrame([(1, "b", "a", "alias_of"), (2, "a", "e", "likes")], "edge_id long, src string, dst string, relation string")
    got = dedup.without_conflicts(pairs(spark, ("c", "b"), ("b", "z"), ("b", "a"), ("m", "n")), edges, store).collect()
    assert {(r["dup"], r["canon"], r["kind"]) for r in got} == {("b", "z", "graph"), ("c", "z", "cascade"), ("a", "z", "cascade"), ("m", "n", "none")}


def test_model_clusters_with_odd_answers(spark):
    rows = spark.createDataFrame([("g", i, f"t{i}") for i in range(5)] + [("h", 0, "x"), ("k", 0, "a"), ("k", 1, "b")], "grp string, pos long, text string")
    said = F.when(F.col("call_id").startswith("g"), '{"clusters": [{"members": [1, 2, 9]}, {"members": [2, 3]}]}').otherwise("no JSON")
    again = F.when(F.col("call_id").startswith("g"), '{"clusters": [{"members": [4, 5]}]}').otherwise("none")
    model = ExpressionModel({"cluster": said, "cluster_check": again})
    got = {(r["grp"], r["pos"]): (r["cluster"], r["changed"]) for r in clustering.model_clusters(rows, model, 8).collect()}
    assert got == {("g", 3): (0, True), ("g", 4): (0, True), ("g", 0): (1, True), ("g", 1): (2, True), ("g", 2): (3, True), ("h", 0): (0, False), ("k", 0): (0, False), ("k", 1): (0, False)}
    plain = {(r["grp"], r["pos"]): r["cluster"] for r in clustering.model_clusters(rows, model, 8, check=False).collect()}
    assert [plain["g", i] for i in range(5)] == [0, 0, 1, 2, 3]
    assert {r["grp"]: r["ok"] for r in clustering.passed(clustering.model_clusters(rows, model, 8)).collect()} == {"g": False, "h": True, "k": True}
    assert clustering.model_clusters(rows.limit(0), model).count() == 0


def test_json_lists_and_lines(spark, tmp_path):
    rows = [{"title": "a", "text": "x\ny"}, {"title": "b", "text": "z"}]
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("list", "lines"):
        assert {tuple(r) for r in texts.corpus(spark, f"file://{tmp_path}/{name}.json").collect()} == {("a", "x\ny"), ("b", "z")}
    end = lambda n: {"label": "entity", "properties": {"name": n}}
    triples = [{"start_node": end("a"), "relation": "r", "end_node": end("b")}, {"start_node": end("b"), "relation": "s", "end_node": end("a")}]
    (tmp_path / "graph.json").write_text(json.dumps(triples, indent=1))
    g = graphs.load(spark, f"file://{tmp_path}/graph.json")
    assert g.nodes.count() == 2 and {r["relation"] for r in g.edges.collect()} == {"r", "s"}


def test_stored_clusters(spark, tmp_path):
    rows = spark.createDataFrame([("g", 0, 0), ("g", 2, 0), ("g", 1, 1), ("h", 0, 0)], "grp string, pos long, cluster int")
    texts.save_cluster_results(rows, f"file://{tmp_path}/c", "keyword")
    assert {tuple(r) for r in texts.cluster_results(spark, f"file://{tmp_path}/c", "keyword").collect()} == {tuple(r) for r in rows.collect()}
    (tmp_path / "own.json").write_text(json.dumps({"triples": [{"id": "e", "clusters": [[0, 1], [2]]}]}, indent=2))
    assert texts.cluster_results(spark, f"file://{tmp_path}/own.json", "edge").count() == 3
    with pytest.raises(ValueError):
        texts.cluster_results(spark, f"file://{tmp_path}/own.json", "other")


def test_languages(spark):
    rows = spark.createDataFrame(
        [("en", "the cat is in the house and it was there"), ("fr", "le chat est dans la maison et il ne sort pas"), ("de", "die Katze ist für das Haus, ß"), ("zh", "你好世界"), ("ru", "привет, мир"), ("xx", ""), ("xx", None)],
        "lang string, t string",
    )
    got = rows.select("lang", language.detect("t")["lang"].alias("found")).collect()
    assert all(r["lang"] == r["found"] for r in got if r["lang"] != "xx") and [r["found"] for r in got if r["lang"] == "xx"] == ["unknown"] * 2
    assert [r["right"] for r in language.evaluated(rows.where("lang <> 'xx'"), "t", "lang").collect()] == [5]


def test_charts_of_odd_input(spark):
    lines = spark.createDataFrame([(1, 0, "['a', 'r', 'b']"), (1, 1, "[broken"), (1, 2, "['a', 'b']"), (1, 99, "['late', 'r', 'b']"), (1, 3, None)], "qid long, pos int, line string")
    assert [tuple(r) for r in analytics.retrieved_chart(lines).collect()] == [(1, "a", "r", "b")]
    with pytest.raises(ValueError):
        analytics.chart_of(None, None)


def test_cluster_needs_a_shared_folder(monkeypatch, spark):
    from kgspark import store

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        store.shared_folder(Session())


def test_similar_pairs_over_many_blocks(spark):
    """More rows than a block holds: every pair once, the smaller id first."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1300, 6))
    rows = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)], "node_id string, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.97, 1))
    want = sorted(tuple(sorted((f"n{a}", f"n{b}"))) for a, b in zip(i, j))
    assert sorted((r["a"], r["b"]) for r in dedup.similar_pairs(rows, 0.97).collect()) == want and len(want) > 50


def test_queries_in_blocks(spark, monkeypatch):
    from kgspark.functions import vector

    items, queries = spark.range(7).toDF("id"), spark.range(10).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double")).alias("qvec"))
    monkeypatch.setattr(vector, "SENT_QUERIES", 3)
    assert {(r["id"], r["qid"]) for r in vector.with_queries(items, queries).collect()} == {(i, q) for i in range(7) for q in range(10)}


def test_best_of_blocks_are_those_of_all(spark):
    """Equal vectors, zeros, nulls, odd lengths and infinite values: the k best by blocks are those of the expressions, bit by bit."""
    rng = np.random.default_rng(3)
    some = [[float(x) for x in np.round(rng.normal(size=5), 1)] for _ in range(40)]
    items = [(f"i{i:03}", some[i % 40], 0.1 if i % 3 == 0 else 0.0) for i in range(300)]
    items += [("zero", [0.0] * 5, 0.0), ("null", None, 0.0), ("hole", [1.0, None, 0.0, 0.0, 0.0], 0.0), ("long", [1.0] * 6, 0.1), ("inf", [float("inf"), 0.0, 0.0, 0.0, 1.0], 0.0), ("nan", [float("nan")] * 5, 0.0)]
    items = spark.createDataFrame(items, "id string, vec array<double>, plus double").repartition(3)
    queries = spark.createDataFrame([(q, some[q]) for q in range(7)] + [(7, [0.0] * 5)], "qid long, qvec array<double>")
    for by_cosine in (False, True):
        for rows in (items, items.drop("plus")):
            one = vector.cosine("qvec", "vec") if by_cosine else vector.dot("qvec", "vec")
            every = rows.crossJoin(queries).withColumn("score", one + F.col("plus") if "plus" in rows.columns else one)
            w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
            want = every.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("qid", "id", "score", "rank")
            got = vector.top_k(queries, rows, 6, by_cosine=by_cosine).select("qid", "id", "score", "rank")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = vector.top_k(queries, items.drop("plus"), 6)._jdf.queryExecution().toString()
    assert "mapInPandas" in plan or "MapInPandas" in plan  # blocks, not one expression a pair


def test_best_triples_take_the_bonus_before_the_cut(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>")
    t = spark.createDataFrame([(1, "r", [1.0, 0.45]), (2, "has", [1.0, 0.5]), (3, "r", [1.0, 0.5]), (4, "Has", [1.0, 0.5]), (5, "r", [-1.0, 0.0])], "edge_id long, relation string, vec array<double>")
    assert [(r["edge_id"], r["rank"]) for r in retrieve.best_triples(q, t, 3, 0.15).orderBy("rank").collect()] == [(2, 1), (4, 2), (1, 3)]
    assert retrieve.best_triples(q, t, 9, 0.15).count() == 4


def test_normalized_works_out_the_length_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, vec array<double>").select("id", vector.normalized("vec").alias("v"))
    assert {r["id"]: r["v"] for r in rows.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}
    plan = rows._jdf.queryExecution().toString().lower()
    assert "/ sqrt(" not in plan  # not for each element


def test_most_words_by_batches(spark):
    """Words inside other words, blank characters that aren't white space, shared and missing keys, ties: as all with all."""
    texts = [(i, t) for i, t in enumerate(["aab b", "ab\u00a0c d", "", None, "xaby abz", "d\tab\u00a0c", "cab " * 30, "y" * 300 + "ab", "q"])] + [(20, "a"), (20, "ab"), (None, "ab d"), (21, "ab")]
    low = spark.createDataFrame(texts, "pos long, low string").repartition(3)
    words = spark.createDataFrame([(q, w) for q, ws in {1: ["ab", "a", "d"], 2: ["ab\u00a0c", "q"], 3: ["zzz"], 4: ["b"]}.items() for w in ws], "qid long, w string")
    hit = words.join(low.where("low is not null"), F.col("low").contains(F.col("w"))).groupBy("qid", "pos").agg(F.count("*").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "pos")
    want = {tuple(r) for r in hit.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("qid", "pos", "score", "rank").collect()}
    got = relational.most_words(words, low, 3)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 9
    assert "MapInPandas" in got._jdf.queryExecution().toString()  # not a row for each word and text


def test_texts_are_searched_without_vectors_of_all(spark, store, monkeypatch):
    """Many batches with equal texts, other letters, empty and missing ones: what the search leaves out is not among the best, bit by bit."""
    monkeypatch.setattr(retrieve, "SENT_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        e = HashingEmbedder(16)
        words = ["order", "Ärger", "hot bolt", "[Error a", "", "Customer#1", "İx", "zz"]
        rows = [(i, f"{words[i % 8]} {i % 90}" if i % 7 else [None, "", words[1], "b"][i % 4]) for i in range(900)]
        items = spark.createDataFrame(rows, "id long, text string").repartition(5)
        q = spark.createDataFrame([(1, "hot order 7"), (2, "ärger"), (3, "[Error"), (4, "b")], "qid long, question string")
        q = q.join(e.embed(q, "qid", "question").withColumnRenamed("vec", "qvec"), "qid").withColumn("qvec", vector.normalized("qvec"))
        unit = lambda v: v.select("id", vector.normalized("vec").alias("vec"))
        want = vector.top_k(q, unit(e.embed(items, "id", "text")), 7)
        near = retrieve.TextVectors(items, "id", "text", e).near(q, 7, store, "near")
        assert sorted(map(tuple, vector.top_k(q, unit(near), 7).collect())) == sorted(map(tuple, want.collect()))
        pairs = items.select("id", "text", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 4)])).alias("qid")).withColumn("plus", F.when(F.col("id") % 3 == 0, 0.1).otherwise(0.0))
        got = e.best_pairs(pairs.withColumnRenamed("id", "edge_id"), q, 900, 0.05, floor=True).collect()
        each = pairs.drop("text").join(e.embed(items, "id", "text"), "id").join(q, "qid").select("qid", "id", F.greatest(F.lit(0.0), vector.cosine("qvec", "vec") + F.col("plus")).alias("score"))
        assert sorted(map(tuple, got)) == sorted(map(tuple, each.where("score > 0.05").collect())) and len(got) > 500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_retrieval_embeds_few_of_all_triples(spark, monkeypatch):
    from kgspark import queries

    sizes = []

    class Counting(HashingEmbedder):
        def embed(self, rows, key, text):
            sizes.append(rows.count())
            return super().embed(rows, key, text)

    monkeypatch.setattr(queries, "HashingEmbedder", Counting)
    folder = "/root/testdata/sf0.001"
    assert {tuple(r) for r in queries.QUERIES["ret8_text_retrieval"](spark, folder).collect()} == {(i, 20, 20) for i in range(40)}
    assert max(sizes) < queries.tables_graph(spark, folder).edges.count()
