"""Text, JSON and validation functions on small cases."""

from pyspark.sql import functions as F

from kgspark.functions import language, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_normalize_name(spark):
    assert one(spark, "  A.  B (c)! ", text.normalize_name("x")) == "a b c"
    assert one(spark, None, text.normalize_name("x")) == ""


def test_identifier_round_trip(spark):
    p = one(spark, "Big City (chunk id: c1, schema_type: place) [entity]", text.parse_identifier("x"))
    assert (p["name"], p["chunk_id"], p["schema_type"], p["label"], p["exact"]) == ("Big City", "c1", "place", "entity", True)
    assert not one(spark, "Big City [entity] (odd)", text.parse_identifier("x"))["exact"]


def test_split_and_triples(spark):
    assert one(spark, "a [b, c], r, t, u", text.split_top_level("x")) == ["a [b, c]", "r", "t, u"]
    t = one(spark, "(a [x, y], knows, b) [score: 0.5]", text.parse_triple("x"))
    assert (t["head"], t["relation"], t["tail"], t["score"]) == ("a [x, y]", "knows", "b", 0.5)
    assert one(spark, "no triple", text.parse_triple("x")) is None


def test_clean_llm_text(spark):
    assert one(spark, "```json\r\n{\"a\": 1}\r\n```", text.clean_llm_text("x")) == '{"a": 1}'
    assert one(spark, "json\n{}", text.clean_llm_text("x")) == "{}"


def test_answers(spark):
    assert one(spark, "Hm.\nSo the answer is: 42", text.final_answer("x")) == "42"
    assert one(spark, "The new query is: where?\nmore", text.new_query("x")) == "where?"
    assert one(spark, "nothing", text.final_answer("x")) is None


def test_rationale(spark):
    single = F.array(F.lit(1))
    assert one(spark, "Same entity as group 2", text.rationale_flag("x", single))
    assert not one(spark, "Same entity but should be separate", text.rationale_flag("x", single))
    assert one(spark, "see group 2 and cluster #3", text.rationale_numbers("x")) == [2, 3]


def test_cluster_answers(spark):
    answer = '{"clusters": [{"members": [1, 3]}, {"members": [3, 9]}]}'
    groups = text.member_groups(text.parsed("x", text.CLUSTERS)["clusters"], F.lit(4))
    assert one(spark, answer, groups) == [[0, 2], [1], [3]]
    assert one(spark, "garbage", groups) == [[0, 1, 2, 3]]


def test_representative_and_coreference(spark):
    g = text.parsed("x", text.GROUPS)["groups"]
    assert one(spark, '{"groups": [{"members": [2, 3], "representative": 9}]}', F.transform(g, text.representative)) == [2]
    yes = one(spark, '{"is_coreferent": true, "preferred_representative": "a"}', text.coreference("x"))
    assert yes["is_coreferent"] and yes["representative"] == "a"
    assert not one(spark, '{"is_coreferent": true}', text.coreference("x"))["is_coreferent"]
    assert not one(spark, "oops", text.coreference("x"))["is_coreferent"]


def test_decomposition(spark):
    assert one(spark, '[{"sub-question": "a?"}, {"sub-question": "b?"}]', text.decomposition("x"))["sub_questions"] == ["a?", "b?"]
    obj = one(spark, '{"sub_questions": [{"sub-question": "a?"}], "involved_types": {"nodes": ["n"]}}', text.decomposition("x"))
    assert obj["sub_questions"] == ["a?"] and obj["nodes"] == ["n"] and obj["relations"] == []


def test_member_issues(spark):
    assert one(spark, "a (chunk id: 1) [entity]", text.member_issues("x")) == []
    assert one(spark, "a [entity]", text.member_issues("x")) == ["warning: no chunk id"]
    assert "error: no label" in one(spark, "a (chunk id: 1)", text.member_issues("x"))


def test_sql_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 0D)) AS c, normalize_entity_name(' A  b! ') AS n").first() == (1.0, "a b")


def test_language(spark):
    for value, lang in (("the cat is in the house and it was on the mat", "en"), ("der Hund und die Katze sind nicht in dem Haus", "de"), ("le chat est dans la maison et les chiens", "fr"), ("el perro y los gatos en la casa con una", "es"), ("", "unknown"), ("12345", "unknown"), (None, "unknown"), ("我们在这里", "zh")):
        assert one(spark, value, language.detect("x"))["lang"] == lang
    assert one(spark, "zh-CN", language.base_language("x")) == "zh"
