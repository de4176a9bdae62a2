"""Answering questions in rounds: all open questions take each step together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import decomposition, final_answer, new_query, normalize_name
from kgspark.providers import LanguageModel

Store = Callable[[DataFrame, str], DataFrame]


def decompose(questions: DataFrame, model: LanguageModel, ontology: str = "") -> DataFrame:
    """(qid, pos, sub_question, nodes, relations, attributes); a question that can't be split is its own part."""
    prompt = F.concat(F.lit(f"Ontology: {ontology}\nSplit into two or three questions: "), "question")
    calls = questions.select(F.col("qid").alias("call_id"), F.lit("decomposition").alias("kind"), prompt.alias("prompt"), "question")
    out = calls.join(model.complete(calls), "call_id", "left").withColumn("d", decomposition("response"))
    subs = F.when(F.size("d.sub_questions") > 0, F.col("d.sub_questions")).otherwise(F.array("question"))
    return out.select(F.col("call_id").alias("qid"), F.posexplode(subs).alias("pos", "sub_question"), F.col("d.nodes"), F.col("d.relations"), F.col("d.attributes"))


def answer_prompt(question: str = "question", context: str = "context"):
    return F.concat(F.lit("Question: "), question, F.lit("\nKnowledge:\n"), F.coalesce(context, F.lit("")), F.lit("\nThink, then write `So the answer is:` or `The new query is:`."))


def answers(questions: DataFrame, search: Callable[[DataFrame], DataFrame], model: LanguageModel, store: Store, max_steps: int = 5) -> DataFrame:
    """(qid, question, answer, steps): rounds of retrieving and reasoning. search maps (qid, query) to (qid, context).

    A question ends with an answer, when its new query repeats the last one or is missing, or after max_steps;
    then what was thought last is its answer.
    """
    state = store(questions.select("qid", "question", F.col("question").alias("query"), F.lit("").alias("thought"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("steps"), F.lit(False).alias("done"), F.lit("").alias("context")), "step0")
    for step in range(1, max_steps + 1):
        todo = state.where("not done")
        if todo.isEmpty():
            break
        found = search(todo.select("qid", "query")).select("qid", F.col("context").alias("found"))
        rows = todo.join(found, "qid", "left").withColumn("context", F.concat_ws("\n", F.nullif(F.col("context"), F.lit("")), "found"))
        calls = rows.select(F.col("qid").alias("call_id"), F.lit("answer").alias("kind"), answer_prompt().alias("prompt"), "question", "query", "context", F.lit(step).alias("step"))
        rows = rows.join(model.complete(calls).select(F.col("call_id").alias("qid"), "response"), "qid", "left")
        said, ask = final_answer("response"), new_query("response")
        stuck = ask.isNull() | (ask == F.col("query"))
        rows = rows.select("qid", "question", F.coalesce(ask, "query").alias("query"), F.coalesce("response", "thought").alias("thought"), said.alias("answer"), F.lit(step).alias("steps"), (said.isNotNull() | stuck).alias("done"), "context")
        state = store(state.where("done").unionByName(rows), f"step{step}")
    return state.select("qid", "question", F.coalesce("answer", "thought").alias("answer"), "steps")


def judged(results: DataFrame, gold: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(qid, correct): by a model's `1`, or else by equal normalised text."""
    rows = results.join(gold.select("qid", F.col("answer").alias("gold")), "qid")
    if model is None:
        return rows.select("qid", (normalize_name("answer") == normalize_name("gold")).alias("correct"))
    prompt = F.concat_ws("\n", F.lit("Is the answer right? 1 or 0."), "question", "gold", "answer")
    calls = rows.select(F.col("qid").alias("call_id"), F.lit("judge").alias("kind"), prompt.alias("prompt"), "question", "gold", "answer")
    return calls.join(model.complete(calls), "call_id", "left").select(F.col("call_id").alias("qid"), F.coalesce(F.trim("response") == "1", F.lit(False)).alias("correct"))


def accuracy(judgements: DataFrame) -> DataFrame:
    return judgements.agg(F.count("*").alias("n"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"))
