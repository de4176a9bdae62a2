"""Quality classifier on supervised subword embeddings, in the manner of fastText (Joulin et al. 2016).

A text's features are its words, its neighbouring words' pairs and its character 3-, 4- and 5-grams, hashed into 2^BUCKET_BITS learned
vectors; their average goes through a softmax over the two classes. Training is plain stochastic gradient
descent in numpy over a bounded sample of labelled rows (TRAIN_ROWS and TRAIN_BYTES, in the order of a hash of
doc_id), so it costs the same at every corpus size. As the output is linear in the average, scoring needs one
number for each bucket: the vector's difference of logits. That table (512 KB, fixed) is all that executors
receive; every whole text is scored in its own partition without a shuffle.

Defined results: a null or empty text scores by the bias alone. Rows repeated are scored each, and learned
once. Without labelled rows, or with one class only, the score is the smoothed share of label 1. Labels of
unknown documents, null labels and labels other than 0 and 1 are ignored; a doc_id labelled twice takes its
larger label. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import Words, pick, slices

BUCKET_BITS, DIM, GRAMS = 17, 16, (3, 4, 5)
#: At most so many labelled rows, and bytes of whole texts, are learned from, in EPOCHS passes.
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, RATE = 4096, 1 << 26, 6, 1.0
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the text of each; null counts as empty."""
    whole = "".join(texts.fill_null("").to_pylist())
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
    return points, np.repeat(np.arange(len(texts), dtype=np.int32), size)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features, and the number of the text each belongs to (in no special order)."""
    w = Words(texts)
    shift = np.uint64(64 - BUCKET_BITS)
    h, whose = w.hashes(), np.repeat(np.arange(len(w.doc) - 1, dtype=np.int32), w.counts())
    pair = (h[:-1] * _MIX ^ h[1:]) * _MIX
    inside = whose[1:] == whose[:-1]
    ids, owner = [(h * _MIX >> shift).astype(np.int32), (pair[inside] >> shift).astype(np.int32)], [whose, whose[1:][inside]]
    points, text = characters(texts)
    gram = points.astype(np.uint64) + np.uint64(1)
    for k in range(2, max(GRAMS) + 1):
        m = len(points) - k + 1
        if m <= 0:
            break
        gram = gram[:m] * _STEP + points[k - 1 :]
        if k in GRAMS:
            inside = text[:m] == text[k - 1 :]
            ids.append(((gram ^ np.uint64(k)) * _MIX >> shift).astype(np.int32)[inside])
            owner.append(text[:m][inside])
    return np.concatenate(ids), np.concatenate(owner)


def learn(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Trains vectors and softmax; returns each bucket's logit difference (class 1 less class 0) and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias[:] = np.log(1 - share), np.log(share)
    if 0 < sum(labels) < len(labels):
        bags = []
        for t in texts:
            ids, count = np.unique(features(pa.array([t], pa.string()))[0], return_counts=True)
            bags.append((ids.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
        steps, done = EPOCHS * len(bags), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(bags)):
                ids, weight = bags[i]
                rate = np.float32(RATE * (1 - done / steps))
                done += 1
                own = vectors[ids]
                hidden = weight @ own
                logit = hidden @ out + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = out @ p
                out -= rate * np.outer(hidden, p)
                bias -= rate * np.float32(0.1) * p
                # fastText gives each feature's vector the whole gradient of the average
                vectors[ids] = own - rate * np.sqrt(weight)[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _scored(table: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, owner = features(b.column(2))
            n = np.bincount(owner, minlength=b.num_rows)
            logit = np.bincount(owner, weights=table[ids], minlength=b.num_rows) / np.maximum(n, 1) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))))], ["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, learned: Column, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """Learns from labelled documents (columns doc_id, label) where `learned` holds of doc_id: at most `rows` rows
    of at most `most` bytes together.

    The ids are chosen among the labels first, in the order of a hash; then rows by their sizes, a text that no
    longer fits being passed over; so texts are only filtered by lists of bounded size and none is shuffled or cut.
    """
    known = pick(labels, "doc_id", "label").where("label in (0, 1) and doc_id is not null").where(learned)
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(known), "doc_id")
    texts = texts.withColumn("th", F.xxhash64("text"))
    sizes = texts.groupBy("doc_id", "th").agg(F.max(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(rows)
    chosen, room = [], most
    for r in sizes.collect():  # at most `rows` rows of three numbers
        if r["size"] <= room:
            chosen.append((r["doc_id"], r["th"]))
            room -= r["size"]
    only = docs.sparkSession.createDataFrame(chosen, known.select("doc_id", F.lit(0).cast("long").alias("th")).schema)
    sample = texts.join(F.broadcast(only), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    sample = sample.toArrow().sort_by([("doc_id", "ascending"), ("th", "ascending")])
    return learn(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def score(docs: DataFrame, table: np.ndarray, bias: float, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out.alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_scored(table, bias), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo: the split into learned and held-out rows. A null doc_id is as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
