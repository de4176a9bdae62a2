"""The thin registered queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.quality_classifier import remainder, score, train

    docs, held_out = table(spark, sf_dir, "documents"), remainder(3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(docs, *train(docs, labels, ~held_out), held_out)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.context_mixing import lm_scores
    from kgspark.llm.quality_classifier import remainder

    return lm_scores(table(spark, sf_dir, "documents"), remainder(10) == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.quality_rules import judged

    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *base, "base_failed", "kept", "good")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.sentencepiece_codec import decode, encode

    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scores": op2_lm_scores,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
}

_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
        keyed AS (SELECT *, translate(trim(line, {_EDGE}), {_LOW}) AS key FROM lines),
        often AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.top AS gone
            FROM keyed k LEFT JOIN often o ON k.key = o.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op6_substring_dedup": f"""
        WITH words AS (
            SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS word FROM (
                SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS a FROM documents WHERE text IS NOT NULL)),
        wins AS (
            SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win,
                count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM words),
        hashed AS (SELECT doc_id, i, md5(win) AS h FROM wins WHERE n = 35),
        twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
        hits AS (SELECT doc_id, i FROM hashed SEMI JOIN twice USING (h)),
        marked AS (
            SELECT w.doc_id, w.i, w.word, max(h.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) >= w.i - 34 AS gone
            FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.i = h.i)
        SELECT d.doc_id, count(m.i) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
            sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT coalesce(gone, false) AND word IS NOT NULL), '')) AS kept_sha256
        FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
