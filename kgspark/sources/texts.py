"""Corpora, chunks, questions, ontologies, caches and dedup files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions.text import INTERCHANGE

_CHUNK_LINE = r"^id: ([^\t]*)\tChunk: (.*)$"


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file, or the files of a folder, must be read whole; else they have an object on each line."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("v")).first()
    return bool(first) and not (first["v"].startswith("{") and first["v"].endswith("}"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a JSON list, or of JSON lines, which are read in parts; records that can't be read are left out."""
    rows = spark.read.schema("title string, text string, _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=is_whole(spark, path))
    return rows.where("title is not null or text is not null").select("title", "text")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, answer string").json(path, multiLine=is_whole(spark, path)).where("question is not null")


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(kind, type_name) of a file with lists of node, relation and attribute types; none if there is no file."""
    try:
        raw = spark.read.schema("Nodes array<string>, Relations array<string>, Attributes array<string>").json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "kind string, type_name string")
    parts = [raw.select(F.lit(k).alias("kind"), F.explode(c).alias("type_name")) for k, c in (("node", "Nodes"), ("relation", "Relations"), ("attribute", "Attributes"))]
    return parts[0].union(parts[1]).union(parts[2])


def ontology_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def evolved(known: DataFrame, proposed: DataFrame) -> DataFrame:
    """The ontology with proposed (kind, type_name) that it lacks added."""
    return known.unionByName(proposed.distinct().join(known, ["kind", "type_name"], "left_anti"))


def chunk_lines(lines: DataFrame) -> DataFrame:
    """(chunk_id, text) of lines (at, value) of the form `id: X<tab>Chunk: Y`; of equal ids the last line wins."""
    rows = lines.select("at", F.regexp_extract("value", _CHUNK_LINE, 1).alias("chunk_id"), F.regexp_extract("value", _CHUNK_LINE, 2).alias("text"), F.col("value").rlike(_CHUNK_LINE).alias("ok"))
    return rows.where("ok").groupBy("chunk_id").agg(F.max_by("text", "at").alias("text"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return chunk_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value"))


def chunks_from_content(spark: SparkSession, content: str) -> DataFrame:
    lines = spark.createDataFrame([(content,)], "c string").select(F.posexplode(F.split("c", "\n")).alias("at", "value"))
    return chunk_lines(lines.select(F.col("at").cast("long"), "value"))


def chunk_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a file or folder: JSON objects (id or chunk_id, text or chunk) and chunk lines, or tab-separated ones."""
    files = spark.read.option("recursiveFileLookup", "true")
    json = files.option("pathGlobFilter", "*.json").schema("id string, chunk_id string, text string, chunk string").json(path, multiLine=True)
    j = json.select(F.coalesce("id", "chunk_id").alias("chunk_id"), F.coalesce("text", "chunk").alias("text")).where("chunk_id is not null and text is not null")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    plain = raw.where(~F.col("value").rlike(_CHUNK_LINE) & F.col("value").contains("\t"))
    p = plain.groupBy(F.regexp_extract("value", r"^([^\t]*)\t", 1).alias("chunk_id")).agg(F.max_by(F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1), "at").alias("text"))
    return j.unionByName(chunk_lines(raw)).unionByName(p)


def save_chunks(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Upserts chunks into the Parquet table at path, new texts winning; writes a new version beside the old one
    and returns what the table then holds."""
    try:
        old = spark.read.parquet(path)
        rows = old.join(new.select(F.col("chunk_id"), F.col("text").alias("_new")), "chunk_id", "full_outer").select("chunk_id", F.coalesce("_new", "text").alias("text"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = new
    rows.write.mode("overwrite").parquet(f"{path}.next")
    fresh = spark.read.parquet(f"{path}.next")
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, text): text files whole, JSON lists and objects by entry; JSON that can't be read is text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    entry = "title string, text string"
    listed = F.from_json("value", f"array<struct<title:string,text:string>>")
    single = F.from_json("value", entry)
    found = F.when(F.col("file").endswith(".json"), F.coalesce(F.when(F.ltrim("value").startswith("["), listed), F.when(F.ltrim("value").startswith("{"), F.array(single))))
    own = F.array(F.struct(F.regexp_extract("file", r"([^/]*)$", 1).alias("title"), F.col("value").alias("text")))
    return files.select("file", F.inline(F.coalesce(found, own)))


def interchange(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERCHANGE).json(path, multiLine=is_whole(spark, path))


def restored_answers(intermediate: DataFrame) -> DataFrame:
    """From stored phases (cluster_id, batch, groups with 0-based members and representative) the answers they came
    from: members and representative counted from 1, a null representative as the first."""
    group = F.transform(
        "groups",
        lambda g: F.struct(F.transform(g["members"], lambda m: m + 1).alias("members"), (F.coalesce(g["representative"], F.lit(0)) + 1).alias("representative"), g["rationale"].alias("rationale")),
    )
    return intermediate.select("cluster_id", "batch", F.to_json(F.struct(group.alias("groups"))).alias("response"))


def restored_kind(kind: str) -> str:
    """The list that a stored file of this dedup type holds."""
    kinds = {"edge": "triples", "keyword": "communities"}
    if kind not in kinds:
        raise ValueError(f"unknown dedup_type: {kind}")
    return kinds[kind]


def export_review(merges: DataFrame, path: str, low: float = 0.70, high: float = 0.90) -> int:
    """Writes merges (dup, canon, method, confidence, rationale) of middling confidence as CSV; none, no file."""
    rows = merges.where(F.col("confidence").between(low, high))
    n = rows.count()
    if n:
        rows.write.mode("overwrite").csv(path, header=True)
    return n


def export_aliases(nodes: DataFrame, aliases: DataFrame, path: str) -> None:
    """Writes (representative, name, alias, alias name, confidence, method) of alias rows (canon, dup, confidence, method)."""
    rep = nodes.select(F.col("node_id").alias("canon"), F.col("name").alias("representative_name"))
    dup = nodes.select(F.col("node_id").alias("dup"), F.col("name").alias("alias_name"))
    rows = aliases.join(rep, "canon").join(dup, "dup")
    rows.select("canon", "representative_name", "dup", "alias_name", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("method", F.lit("unknown")).alias("method")).write.mode("overwrite").csv(path, header=True)


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """A cached table (embeddings, node texts, postings, answers), or None if it was never written."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def cache(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def clear(spark: SparkSession, *paths: str) -> int:
    """Deletes cached tables and files, globs included; how many paths went."""
    jvm, gone = spark.sparkContext._jvm, 0
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(at) or []:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def datasets(uploaded: DataFrame, graphs: DataFrame) -> DataFrame:
    """(name, status): `ready` where a graph exists, else `needs_construction`; the demo set is always listed."""
    demo = uploaded.sparkSession.createDataFrame([("demo",)], "name string")
    names = uploaded.select("name").union(demo).distinct()
    have = graphs.select(F.col("name").alias("_n")).distinct()
    out = names.join(have, F.col("name") == F.col("_n"), "left")
    return out.select("name", F.when(F.col("_n").isNull(), "needs_construction").otherwise("ready").alias("status"), (F.col("name") != "demo").alias("can_delete"))


def stale(cached_ids: DataFrame, current_ids: DataFrame, extra_share: float = 0.1) -> DataFrame:
    """(missing, extra, current, stale) for two tables of one id column: stale if ids are missing from the cache,
    or if it holds more than a tenth too many."""
    c, n = cached_ids.toDF("id").distinct(), current_ids.toDF("id").distinct()
    both = c.withColumn("c", F.lit(1)).join(n.withColumn("n", F.lit(1)), "id", "full_outer")
    out = both.agg(F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("n").isNull()).alias("extra"), F.count("n").alias("current"))
    return out.withColumn("stale", (F.col("missing") > 0) | (F.col("extra") > extra_share * F.col("current")))


def per_key_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def trimmed(cache: DataFrame, order: str, most: int = 5000) -> DataFrame:
    """The `most` newest rows of a cache; each task keeps its own newest before any are compared."""
    return cache.orderBy(F.desc(order)).limit(most)


def cluster_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(grp, pos, cluster) of a stored clustering run: JSON with a list (`triples` of an edge run, `communities` of a keyword run) of
    groups, each with an id and clusters of 0-based members."""
    group = "struct<id:string,clusters:array<array<long>>>"
    raw = spark.read.schema(f"{restored_kind(kind)} array<{group}>").json(path, multiLine=is_whole(spark, path))
    each = raw.select(F.inline(restored_kind(kind))).select(F.col("id").alias("grp"), F.posexplode("clusters").alias("cluster", "members"))
    return each.select("grp", F.explode("members").alias("pos"), "cluster")


def save_cluster_results(rows: DataFrame, path: str, kind: str) -> None:
    """Writes (grp, pos, cluster) the way cluster_results() reads them, a group on each line."""
    one = rows.groupBy(F.col("grp").cast("string").alias("id"), "cluster").agg(F.array_sort(F.collect_list(F.col("pos").cast("long"))).alias("m"))
    g = one.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "m"))), lambda x: x["m"]).alias("clusters"))
    g.select(F.array(F.struct("id", "clusters")).alias(restored_kind(kind))).write.mode("overwrite").json(path)
