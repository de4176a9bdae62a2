"""Sequence packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Rows are dealt evenly over partitions; there they are ordered by a hash and cut into groups of GROUP_TOKENS
tokens, each packed on its own, so a task holds one group at a time whatever ids and texts repeat. A document
of more than `length` tokens first gives full sequences; the remainders go, longest first, into the first
bin with room, found by descending a tournament tree of the bins' free capacities.

Defined results: a null or empty text is its end token alone. A null doc_id is packed like any other.
Repeated rows are packed each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.byte_bpe import byte_bpe
from kgspark.llm.common import pick

#: A group ends with the document that brings it to this many tokens. A partition has about PART_ROWS rows.
GROUP_TOKENS, PART_ROWS = 1 << 21, 1 << 15

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free capacities of n bins, all `room` at first; each inner node holds the larger of its two."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first bin with at least `need` free; one must exist."""
        at, best, leaves = 1, self.best, self.leaves
        while at < leaves:
            at *= 2
            if best[at] < need:
                at += 1
        return at - leaves

    def take(self, bin_: int, need: int) -> None:
        best, at = self.best, bin_ + self.leaves
        best[at] -= need
        while at > 1:
            at //= 2
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers; items are at most `length` each and taken longest first."""
    tree, bins = Tournament(max(1, len(sizes)), length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.first_with(sizes[i])
        tree.take(b, sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def packed(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length), for items of any size from 1."""
    full = [[(i, at, length)] for i, n in enumerate(sizes) for at in range(0, n - n % length, length)]
    rest = [(i, n - n % length, n % length) for i, n in enumerate(sizes) if n % length]
    return full + [[rest[j] for j in b] for b in first_fit_decreasing([n for _, _, n in rest], length)]


def _pack(path: str | None, length: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        first = TaskContext.get().partitionId() << 40
        number, docs, ids, total = 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, docs, ids, total
            sequences = packed([len(x) for x in ids], length)
            for at in range(0, len(sequences), 512):
                rows, tokens = [], []
                for k, sequence in enumerate(sequences[at : at + 512]):
                    offset = 0
                    for item, start, n in sequence:
                        piece = ids[item][start : start + n]
                        rows.append((docs[item], start, n, zlib.crc32(piece.tobytes()), len(ids[item]), first + number + at + k, offset))
                        tokens.append(piece)
                        offset += n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = SCHEMA.replace(" long", "").split(", ")
                if with_ids:
                    off = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(tokens).astype(np.int32))))
                    names = [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
            number += len(sequences)
            docs, ids, total = [], [], 0

        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if total >= GROUP_TOKENS:
                    yield from flush()
                ids.append(np.append(encoder.encode(text or ""), np.uint32(end)).astype("<u4"))
                docs.append(doc)
                total += len(ids[-1])
        if docs:
            yield from flush()

    return run


def pack(docs: DataFrame, length: int = 2048, end: int = 1, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of docs in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked.

    tokenizer is the path of a vocabulary file on the executors (by default the public byte-level BPE).
    """
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # by number and not by a key: equal ids or texts do not meet in one task
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    rows = rows.repartition(parts).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return rows.mapInArrow(_pack(tokenizer, length, end, with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))
