"""SentencePiece encoding and decoding of whole documents, giant ones in parallel chunks.

Ordinary texts are encoded where they are read. A text of more than GIANT characters is dealt in chunks of
CHUNK characters to many tasks. Each chunk gives a max-plus transfer matrix between the pieces that can hold
its left cut and those that can hold its right cut (piece_lattice). The matrices of a text, a few hundred
bytes for each chunk, are combined by an associative scan, which tells the piece that holds every cut;
then each chunk is traced back on its own, and the pieces of the chunks are put together.

Defined results: a null or empty text has no ids. Rows repeated are encoded each. A null doc_id is passed on.
An empty table gives no rows. Decoding gives the text back unless it holds the space mark itself, which
becomes a space. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import pick, shared_dir, slices, stored
from kgspark.llm.piece_lattice import decoder, lattice, marked, max_plus, text_of

GIANT, CHUNK = 1 << 16, 1 << 14
_LOW = float("-inf")


def _ids(parts: list[np.ndarray]) -> pa.ListArray:
    off = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _encoded(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for b in slices(batches, most=1 << 20):
            ids = pieces.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), _ids(ids)], ["doc_id", "ids"])

    return run


def _chunks(longest: int):
    """(uid, k, left, right, text, at): chunk k of each text with `longest` characters more on either side;
    at is where that stretch begins in the marked text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                whole = marked(text)
                cuts = [*range(0, len(whole) - CHUNK // 2, CHUNK), len(whole)]
                for k, (left, right) in enumerate(zip(cuts, cuts[1:])):
                    at = max(0, left - longest)
                    columns = [[row], [doc], [k], [left], [right], [at], [right == len(whole)], [whole[at : right + longest]]]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["uid", "doc_id", "k", "start", "stop", "at", "last", "text"])
                row += 1

    return run


def _matrices(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for b in batches:
            for uid, k, left, right, at, last, text in zip(*(c.to_pylist() for c in b.columns)):
                m = pieces.transfer(text, left - at, right - at, k == 0)
                if last:  # only the piece that ends with the text can hold the last cut
                    over = [pieces._end(h) != right - at for h in pieces.holders(text, right - at)]
                    m[:, over] = _LOW
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([k], pa.int64()), pa.array([list(m.shape)], pa.list_(pa.int32())), pa.array([m.astype(np.float32).tobytes()], pa.binary())], ["uid", "k", "shape", "weights"])

    return run


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products in max-plus algebra, by halving: products of neighbours, their prefixes, and one more each."""
    if len(matrices) < 2:
        return matrices
    pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
    even = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(even[i // 2] if i % 2 else max_plus(even[i // 2 - 1], matrices[i]))
    return out


def _held(rows: pd.DataFrame) -> pd.DataFrame:
    """For one text's matrices: which holder (by number) each cut has, (uid, k, left, right)."""
    rows = rows.sort_values("k")
    m = [np.frombuffer(w, np.float32).reshape(tuple(s)) for w, s in zip(rows["weights"], rows["shape"])]
    prefix = scan(m)
    to = int(prefix[-1][0].argmax())
    left, right = [0] * len(m), [0] * len(m)
    for k in range(len(m) - 1, -1, -1):
        right[k] = to
        to = int((prefix[k - 1][0] + m[k][:, to]).argmax()) if k else 0
        left[k] = to
    return pd.DataFrame({"uid": rows["uid"].to_numpy(), "k": rows["k"].to_numpy(), "left": left, "right": right})


def _traced(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for b in batches:
            for uid, doc, k, left, right, at, text, a, z in zip(*(c.to_pylist() for c in b.columns)):
                i, j = left - at, right - at
                ids = np.frombuffer(pieces.between(text, i, j, None if k == 0 else pieces.holders(text, i)[a], pieces.holders(text, j)[z]), "<u2")
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([doc], pa.int64()), pa.array([k], pa.int64()), _ids([ids])], ["uid", "doc_id", "k", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids of each row's text. model is the path of a BPE model on the executors."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    giant = F.char_length(F.coalesce("text", F.lit(""))) > GIANT
    plain = rows.where(~giant).mapInArrow(_encoded(model), "doc_id long, ids array<int>")

    path, longest = shared_dir(spark), lattice(model).longest
    chunk = rows.where(giant).mapInArrow(_chunks(longest), "uid long, doc_id long, k long, start long, stop long, at long, last boolean, text string")
    chunk = stored(chunk, f"{path}/chunks").repartition("uid", "k")
    matrix = chunk.select("uid", "k", "start", "stop", "at", "last", "text").mapInArrow(_matrices(model), "uid long, k long, shape array<int>, weights binary")
    held = matrix.groupBy("uid").applyInPandas(_held, "uid long, k long, left int, right int")
    full = chunk.join(stored(held, f"{path}/held"), ["uid", "k"]).select("uid", "doc_id", "k", "start", "stop", "at", "text", "left", "right")
    traced = full.mapInArrow(_traced(model), "uid long, doc_id long, k long, ids array<int>")
    joined = traced.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return plain.union(joined.select("doc_id", F.flatten("parts.ids").alias("ids")))


def _decoded(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = decoder(model)
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
            off = off - off[0]
            texts, crc = [], []
            for i in range(b.num_rows):
                own = flat[off[i] : off[i + 1]]
                texts.append(text_of(raw, own.tolist()))
                crc.append(zlib.crc32(own.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_ids", "ids_crc32", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as unsigned 32-bit numbers) and the text, from doc_id and ids."""
    return pick(encoded, "doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, n_ids long, ids_crc32 long, text string")
