"""Rounds of clustering by a language model: batches, answers, a second look, and what it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import CLUSTERS, member_groups, parsed
from kgspark.operators.relational import batched
from kgspark.providers import LanguageModel


def model_clusters(rows: DataFrame, model: LanguageModel, size: int = 30, check: bool = True) -> DataFrame:
    """(grp, pos, cluster, changed) of rows (grp, pos, text), whose entries a model clusters in batches of `size`.

    An answer lists clusters of members, numbered from 1 in their batch; members that it leaves out stand alone, a
    member named twice belongs to the first cluster, and an answer that can't be read leaves the batch together.
    With `check` the model sees its clusters again: corrected ones replace them, members that these leave out
    stand alone, and an unreadable answer or a batch of one changes nothing. Cluster numbers of a group are
    batch * size and up. changed tells whether the second look gave a batch other clusters.
    """
    rows = batched(rows.select("grp", "pos", "text"), ["grp"], "pos", size)
    item = F.struct("local", "pos", "text")
    calls = rows.groupBy("grp", "batch").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("n", F.size("items"))
    calls = calls.withColumn("call_id", F.concat_ws("|", F.col("grp").cast("string"), "batch"))
    shown = F.concat_ws("\n", F.transform("items", lambda x: F.concat_ws(". ", x["local"].cast("string"), x["text"])))
    first = calls.select("call_id", F.lit("cluster").alias("kind"), F.concat(F.lit("Which of these mean the same?\n"), shown).alias("prompt"), "n")
    said = first.join(model.complete(first).select("call_id", "response"), "call_id", "left")
    found = calls.join(said.select("call_id", member_groups(parsed("response", CLUSTERS)["clusters"], F.col("n")).alias("clusters")), "call_id")
    found = found.withColumn("changed", F.lit(False))
    if check:
        again = found.where("n > 1").select("call_id", F.lit("cluster_check").alias("kind"), F.concat(shown, F.lit("\nAre these clusters right?\n"), F.to_json("clusters")).alias("prompt"), "n")
        answer = again.join(model.complete(again).select("call_id", "response"), "call_id", "left").select("call_id", "n", parsed("response", CLUSTERS)["clusters"].alias("c"))
        better = answer.where("c is not null").select("call_id", member_groups(F.col("c"), F.col("n")).alias("better"))
        found = found.join(better, "call_id", "left")
        found = found.withColumn("changed", F.col("better").isNotNull() & (F.col("better") != F.col("clusters"))).withColumn("clusters", F.coalesce("better", "clusters"))
    each = found.select("grp", "batch", "items", "changed", F.posexplode("clusters").alias("k", "members"))
    each = each.select("grp", "items", "changed", (F.col("batch") * size + F.col("k")).alias("cluster"), F.explode("members").alias("m"))
    return each.select("grp", F.expr("items[m].pos").alias("pos"), F.col("cluster").cast("int").alias("cluster"), "changed")


def passed(clusters: DataFrame) -> DataFrame:
    """(grp, clusters, ok): how many clusters each group has, and whether the second look left all of them as they were."""
    return clusters.groupBy("grp").agg(F.count_distinct("cluster").alias("clusters"), (~F.bool_or("changed")).alias("ok"))
