"""Line dedup on levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased, known by the first 16 bytes
of its SHA-256. A run is a sorted table key -> number of documents and largest doc_id. Each new batch is
merge-anti-joined against the runs: keys that no run knows start with their own counts, known ones carry
on from the runs' totals; the batch then adds its own run, and full levels are compacted (runs.py).

Defined results: a null or empty text is one empty line. A doc_id is one document even if its rows are
repeated; each row gets its own result row. Rows without doc_id count together as one document smaller
than any other. Lines of a key in one document count once. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import LOWER, SPACE, UPPER, discard, join_by_weight, pick, shared_dir, stored
from kgspark.llm.runs import Runs

RUN = "key binary, n_docs long, top_doc long"


class LineRuns(Runs):
    """Runs of key -> documents that hold it so far and the largest of them, as of the run's time.

    Totals only grow, so of several rows of a key the one with the most documents is the newest, and merging
    runs is a maximum.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        newest = lambda rows: rows.groupBy("key").agg(F.max("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))
        super().__init__(spark, "key", newest, path, fanout)

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (key, n_docs, top_doc), a key once.

        The merge anti-join with the runs finds the new keys, which start with their own counts; the others
        carry on from the totals that the merge join with the runs finds. Both make up the batch's run.
        """
        came = self.written(batch)
        rows = self.table(came)
        before = self.known(rows)
        if before is None:
            self.push(came)
            return
        past = self.merge(before).select("key", F.col("n_docs").alias("_n"), F.col("top_doc").alias("_top")).hint("merge")
        top = F.greatest("top_doc", "_top")  # skips nulls
        grown = rows.join(past, "key").select("key", (F.col("n_docs") + F.col("_n")).alias("n_docs"), top.alias("top_doc"))
        own = self.written(self.unknown(rows).unionByName(grown))
        self.drop([came])
        self.push(own)

    def totals(self) -> DataFrame:
        """key, n_docs, top_doc of all that was added, from one run."""
        found = self.compacted()
        return self.spark.createDataFrame([], RUN) if found is None else found


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and key of each line that is long enough, once for each row of docs."""
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), "\n", -1)
    keys = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), lambda x: F.char_length(x) >= min_chars)
    keys = F.transform(F.array_distinct(keys), lambda x: F.substring(F.unhex(F.sha2(x, 256)), 1, 16))
    return docs.select("doc_id", F.explode(keys).alias("key"))


def _rewritten(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, gone, texts = [], [], [], []
            for doc, text, drops in zip(*(c.to_pylist() for c in b.columns)):
                parts = (text or "").split("\n")
                if drops:
                    drop = set(drops)
                    left = [x for x in parts if not _goes(x, drop, min_chars)]
                else:
                    left = parts
                ids.append(doc)
                lines.append(len(parts))
                gone.append(len(parts) - len(left))
                texts.append("\n".join(left))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return run


def _goes(line: str, drop: set[bytes], min_chars: int) -> bool:
    key = line.strip(SPACE)
    return len(key) >= min_chars and hashlib.sha256(key.encode().lower()).digest()[:16] in drop


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for each row of docs.

    Keys of at least min_chars code points found in min_docs documents or more lose all their lines
    except in the largest doc_id that holds them. The rows come in `batches` hash-dealt batches, as
    they would over time; the result is the same for any number of them.
    """
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    path = shared_dir(docs.sparkSession)
    keys = stored(line_keys(rows, min_chars).distinct().withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), f"{path}/keys", "batch")
    runs = LineRuns(docs.sparkSession, f"{path}/runs", fanout)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc")))
    often = stored(runs.totals().where(F.col("n_docs") >= min_docs), f"{path}/often")
    runs.drop()
    held = join_by_weight(keys.select("doc_id", "key"), often, ["key"], "n_docs", keys.count())
    lost = held.where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
    drops = stored(lost.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("key").alias("drops")), f"{path}/drops")
    discard(docs.sparkSession, f"{path}/keys", f"{path}/often")
    both = rows.join(drops, rows["doc_id"].eqNullSafe(drops["_doc"]), "left").select("doc_id", "text", "drops")
    return both.mapInArrow(_rewritten(min_chars), "doc_id long, n_lines long, n_dropped long, text string")
