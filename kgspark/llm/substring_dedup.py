"""Substring dedup on a log-structured index of window fingerprints.

A window is 35 consecutive words. Each window chooses its smallest 8-word hash as anchor, so equal windows
choose equal anchors at equal offsets; neighbouring windows mostly share one, and about 7 % of the word
positions become anchors. The fingerprint of an anchor is that hash; its block is all the words of the
windows that chose it, known by an independent second hash.

The index holds sorted immutable runs of (fingerprint, block) -> occurrences (runs.py). Each batch is merge-
joined with the runs of earlier batches, which tells the fingerprints that repeat; it then adds its own run,
and full levels are compacted. A repeated fingerprint is verified before it counts:
- one block, several occurrences: all windows of the block repeat;
- several blocks with one fingerprint: one place of each block is read again and its windows are hashed
  singly; a window repeats if its hash, under this fingerprint, has two occurrences or more.
So no window row is made for unique text, and copies are counted, not expanded.

Defined results: null, empty and short texts (under 35 words) lose nothing. A row repeated whole repeats
its windows. Rows with one doc_id, or none, but different texts are told apart by a hash of the text.
An empty table gives no rows. Other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import Words, discard, join_by_weight, pick, shared_dir, slices, splitmix, spread, stored, windows
from kgspark.llm.runs import Runs

WINDOW, GRAM = 35, 8
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = "rid long, lo int, wins int"


class FingerprintRuns(Runs):
    """Runs of (fp, bh, n): how often a run's batches hold each block under each fingerprint."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        super().__init__(spark, "fp", lambda rows: rows.groupBy("fp", "bh").agg(F.sum("n").alias("n")), path, fanout)

    def add(self, anchors: DataFrame) -> DataFrame:
        """Adds the anchors of a batch as a run; gives the fingerprints of the batch that repeat by then.

        Those are the ones that the merge join with the earlier runs finds there, and those that the batch
        holds more than once. The result does not read the runs again.
        """
        own = self.written(anchors.groupBy("fp", "bh").agg(F.count("*").alias("n")))
        rows = self.table(own)
        fps = rows.groupBy("fp").agg(F.sum("n").alias("n"))
        hits = fps.where("n > 1").select("fp")
        before = self.known(fps)
        if before is not None:
            hits = hits.union(before.select("fp")).distinct()
        hits = stored(hits, f"{self.path}/hits{self.made}")
        self.push(own)
        return hits


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of each w consecutive values."""
    value, at, size = g, np.arange(len(g)), 1
    while size * 2 <= w:
        m = len(value) - size
        left = value[:m] <= value[size:]
        value, at, size = np.where(left, value[:m], value[size:]), np.where(left, at[:m], at[size:]), size * 2
    m, rest = len(g) - w + 1, w - size
    return np.where(value[:m] <= value[rest : rest + m], at[:m], at[rest : rest + m])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = Words(b.column(1))
        starts = spread(w.first, WINDOW)
        if not len(starts):
            continue
        g = windows(w.hashes(), GRAM)
        chosen = _least(g, WINDOW - GRAM + 1)[starts]
        head = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        lo, at, wins = starts[head], chosen[head], np.diff(np.r_[head, len(starts)])
        end = lo + wins + WINDOW - 1
        x, n = splitmix(w.hashes(2)), int(w.first[-1])
        power = np.cumprod(np.full(n, _B, np.uint64))
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(x * power, dtype=np.uint64)]
        back = np.cumprod(np.full(n, _B_INVERSE, np.uint64))
        size = ((at - lo) * 256 + wins).astype(np.uint64)
        block = splitmix((total[end] - total[lo]) * back[lo] + splitmix(size))
        doc = np.searchsorted(w.first, lo, side="right") - 1
        columns = [pa.array(g[at].view(np.int64)), pa.array(block.view(np.int64)), b.column(0).take(pa.array(doc)), pa.array((lo - w.first[doc]).astype(np.int32)), pa.array(wins.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["fp", "bh", "rid", "lo", "wins"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (text, places) of contested blocks; gives (fp, bh, i, wh, n) for each of their windows."""
    for b in slices(batches):
        w = Words(b.column(0))
        if len(w.start) < WINDOW:
            continue
        h = windows(w.hashes(2), WINDOW)
        lists = b.column(1)
        rows = lists.flatten()
        count = np.diff(lists.offsets.to_numpy())
        base = np.repeat(w.first[:-1], count)
        fp, bh, lo, wins, n = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        which = np.repeat(np.arange(len(fp)), wins)
        i = np.arange(len(which)) - np.repeat(np.cumsum(wins) - wins, wins)
        yield pa.RecordBatch.from_arrays([pa.array(fp[which]), pa.array(bh[which]), pa.array(i.astype(np.int32)), pa.array(h[base[which] + lo[which] + i].view(np.int64)), pa.array(n[which])], ["fp", "bh", "i", "wh", "n"])


def _left(texts: pa.Array, places: pa.Array) -> tuple[list[bytes], list[int], list[int]]:
    """The words that no repeated window covers, joined; the number of words, and of those that go."""
    rows, count = places.flatten(), np.diff(places.offsets.to_numpy())
    lo, mask = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    off = np.r_[0, np.cumsum(count)]
    out, words, removed = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        all_ = (text or "").encode().split()
        left = all_
        if count[i]:
            start = np.repeat(lo[off[i] : off[i + 1]], 32) + np.tile(np.arange(32), count[i])
            bits = (mask[off[i] : off[i + 1], None] >> np.arange(32)) & 1
            start = start[bits.ravel().astype(bool)]
            depth = np.bincount(start, minlength=len(all_) + 1) - np.bincount(start + WINDOW, minlength=len(all_) + 1)
            left = list(compress(all_, np.cumsum(depth)[: len(all_)] == 0))
        out.append(b" ".join(left))
        words.append(len(all_))
        removed.append(len(all_) - len(left))
    return out, words, removed


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        left, words, removed = _left(b.column(1), b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def repeated_windows(rows: DataFrame, path: str, batches: int, fanout: int) -> DataFrame:
    """(rid, places) for each text with repeated windows, from rows (rid, text): places lists (lo, mask), bit i
    of mask standing for the window that starts at word lo + i."""
    spark = rows.sparkSession
    save = lambda df, name: stored(df, f"{path}/{name}")
    deal = F.pmod(F.xxhash64("rid"), F.lit(batches)).cast("int")
    anchors = save(rows.mapInArrow(_anchors, f"fp long, bh long, {PLACE}").withColumn("batch", deal), "anchors")
    index = FingerprintRuns(spark, f"{path}/runs", fanout)
    hits = reduce(DataFrame.union, [index.add(anchors.where(F.col("batch") == i)) for i in range(batches)])
    discard(spark)

    # what the batches' merge joins found, with the counts of the compacted run
    again = save(index.compacted().join(hits.distinct().hint("merge"), "fp", "left_semi"), "repeated")
    index.drop()
    blocks = again.groupBy("fp").agg(F.count("*").alias("blocks"))
    again = save(join_by_weight(again, blocks, ["fp"], "blocks", again.count()).select("fp", "bh", "n", (F.col("blocks") > 1).alias("contested")), "again")
    met = join_by_weight(anchors.drop("batch"), again.where("contested or n > 1"), ["fp", "bh"], "n", anchors.count())
    met = save(met.select("fp", "bh", "rid", "lo", "wins", "n", "contested"), "met")
    discard(spark, f"{path}/anchors", f"{path}/runs", f"{path}/repeated")

    # one place of each contested block is read again, and its windows are told apart
    place = F.struct("rid", "lo", "wins").alias("at")
    first = met.where("contested").groupBy("fp", "bh").agg(F.min(place).alias("at"), F.first("n").alias("n"))
    open_ = first.groupBy(F.col("at.rid").alias("_r")).agg(F.collect_list(F.struct("fp", "bh", F.col("at.lo").alias("lo"), F.col("at.wins").alias("wins"), "n")).alias("places"))
    read = open_.join(rows, F.col("rid") == F.col("_r"))
    single = save(read.select("text", "places").mapInArrow(_single_windows, "fp long, bh long, i int, wh long, n long").distinct(), "single")
    discard(spark)
    twice = single.groupBy("fp", "wh").agg(F.sum("n").alias("total")).where("total > 1").select("fp", "wh")
    some = single.join(twice, ["fp", "wh"]).groupBy("fp", "bh").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    whole = again.where("n > 1").select("fp", "bh", "n", F.lit(-1).alias("mask"))
    parts = again.where("contested and n = 1").select("fp", "bh", "n").join(some, ["fp", "bh"])
    masks = save(parts.union(whole), "masks")
    discard(spark, f"{path}/single", f"{path}/again")

    kept = join_by_weight(met.select("fp", "bh", "rid", "lo", "wins"), masks, ["fp", "bh"], "n", met.count())
    full = F.expr("shiftleft(1, wins) - 1")
    places = kept.groupBy("rid").agg(F.collect_set(F.struct("lo", F.col("mask").bitwiseAND(full).alias("mask"))).alias("places"))
    places = save(places, "places")
    discard(spark, f"{path}/masks", f"{path}/met")
    return places


def _with_places(docs: DataFrame, flat: DataFrame, doc: str, text: str, batches: int, fanout: int) -> DataFrame:
    """flat (docs by other column names) with what repeated_windows says of each row's text.

    A row is known by a hash of its doc_id and text; rows that are repeated whole share it, and their places.
    """
    rid = lambda d, t: F.xxhash64(F.col(d).cast("long"), t)
    rows = pick(docs, "doc_id", "text").select(rid("doc_id", "text").alias("rid"), "text")
    places = repeated_windows(rows, shared_dir(docs.sparkSession), batches, fanout).withColumnRenamed("rid", "_r")
    both = flat.join(places, rid(doc, text) == F.col("_r"), "left")
    none = F.array().cast("array<struct<lo:int,mask:int>>")
    return both.select(*flat.columns, F.coalesce("places", none).alias("_places"))


def substring_dedup(docs: DataFrame, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words left, joined by one space), for each row.

    The rows come in `batches` hash-dealt batches; the result is the same for any number of them.
    """
    flat = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return _with_places(docs, flat, "doc_id", "text", batches, fanout).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")


def _cut_in_place(text: int, n_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"_c{text}"):
            columns, old = b.columns[:-1], b.column(text)
            left, words, removed = _left(old, b.columns[-1])
            cut = pa.array(np.array(removed) > 0)
            new = pc.if_else(cut, pa.array(left, pa.binary()).cast(pa.string()), old.cast(pa.string()))
            columns[text] = new.cast(old.type)
            if n_chars is not None:
                was = columns[n_chars]
                columns[n_chars] = pc.if_else(cut, pc.utf8_length(new).cast(was.type), was)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return run


def substring_cut(docs: DataFrame, batches: int = 3, fanout: int = 2) -> DataFrame:
    """docs with repeated passages cut out; all columns as they were, a whole-number n_chars following the text.

    A text that loses words becomes its remaining words, joined by one space; others stay as they are.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = names.index("text")
    counts = "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")
    both = _with_places(docs, flat, f"_c{names.index('doc_id')}", f"_c{text}", batches, fanout)
    return both.mapInArrow(_cut_in_place(text, names.index("n_chars") if counts else None), flat.schema).toDF(*names)
