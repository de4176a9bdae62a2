"""Quality rules as weak supervision: each rule votes good, bad or abstains; EM weighs the rules.

Rules are conditions on counts of the whole text. All documents are tallied by vote pattern (at most
3^rules rows, whatever the number of documents), and expectation-maximisation on that tally estimates, for
each rule, how often it votes each way on good and on bad documents (Dawid and Skene 1979). The posterior
probability that a document is good replaces the demand that it pass every rule.

Defined results: a null or empty text, or one of white space, has no words and fails the base rule. Each
row gets a result row, repeated or not, with or without doc_id. An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import SPACE, Words, pick, shared_dir, slices, splitmix, spread, stored, windows

#: Frequent function words of the four languages (fixed values).
FUNCTION_WORDS = (
    "the of and to in a is that it for on was be with as by this are or from at an "
    "de la le et des les en un une du que est pour dans qui par sur au ne pas "
    "der die das und den von zu mit sich dem nicht ein eine als auch es auf für ist im "
    "el los las y del se por con no su para al lo como más o pero sus si"
)

FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits",
    "n_shouts", "n_function", "n_distinct", "n_stops", "n_lines", "n_ended",
)

_FUNCTION = np.array(sorted({int(x) for x in Words(pa.array([FUNCTION_WORDS])).hashes()}), np.uint64)


def _flag(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


_SYMBOL, _SHOUT, _DIGIT = _flag(b"#*$%&|<>"), _flag(b"!?"), _flag(b"0123456789")
_UPPER, _ASCII = _flag(bytes(range(65, 91))), _flag(bytes(range(65, 91)) + bytes(range(97, 123)))
_STOP = _flag(b".,;:")
_ENDS = tuple('.!?:;"…»”)')


def _by_doc(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[doc[1:]] - total[doc[:-1]]


def repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes with the number of their text: which occur twice or more in it, which come first in it."""
    mixed = splitmix(h + splitmix(doc.astype(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    again = ~new
    again[:-1] |= ~new[1:]
    out, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
    out[order], first[order] = again, new
    return out, first


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The FEATURES of each text."""
    w = Words(texts)
    data, doc, n = w.data, w.doc, w.counts()
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    point = (data & 0xC0) != 0x80
    h = w.hashes()
    owner = np.repeat(np.arange(len(n)), n)
    at = spread(w.first, 5)
    twice = repeats(windows(h, 5)[at], owner[at])[0] if len(at) else np.zeros(0, bool)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out = {
        "n_words": n,
        "word_chars": _by_doc(inside & point, doc),
        "n_symbols": _by_doc(_SYMBOL[data], doc),
        "n_repeat_words": _by_doc(covered, w.first),
        "n_upper": _by_doc(_UPPER[data], doc),
        "n_letters": _by_doc(_ASCII[data] | (data >= 0xC0), doc),
        "n_digits": _by_doc(_DIGIT[data], doc),
        "n_shouts": _by_doc(_SHOUT[data], doc),
        "n_function": _by_doc(np.isin(Words(texts, lower=True).hashes(), _FUNCTION), w.first),
        "n_distinct": _by_doc(repeats(h, owner)[1], w.first),
        "n_stops": _by_doc(_STOP[data[w.end - 1]] if len(h) else np.zeros(0, bool), w.first),
    }
    dup, lines, ended = [], [], []
    for text in texts.to_pylist():
        own = [x for x in (text or "").split("\n") if x.strip(SPACE)]
        dup.append(len(own) - len(set(own)))
        lines.append(len(own))
        ended.append(sum(x.rstrip(SPACE).endswith(_ENDS) for x in own))
    return out | {"n_dup_lines": np.array(dup), "n_lines": np.array(lines), "n_ended": np.array(ended)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        c = counts(b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c[f].astype(np.int64)) for f in FEATURES)], ["doc_id", "th", *FEATURES])


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule the conditions under which it votes good and bad; neither: it abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda x, of=words: F.col(x) / of
    letters, lines = F.greatest(F.col("n_letters"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    length = F.col("word_chars") / words
    return {
        "symbols": (share("n_symbols") < 0.02, share("n_symbols") > 0.1),
        "word_length": (length.between(3, 10), (length < 2) | (length > 14)),
        "capitals": (share("n_upper", letters) < 0.1, share("n_upper", letters) > 0.3),
        "shouting": (share("n_shouts") < 0.03, share("n_shouts") > 0.15),
        "same_lines": ((F.col("n_lines") > 3) & (F.col("n_dup_lines") == 0), share("n_dup_lines", lines) > 0.3),
        "repetition": (share("n_repeat_words") < 0.03, share("n_repeat_words") > 0.1),
        "function_words": (share("n_function") > 0.1, share("n_function") < 0.03),
        "variety": ((F.col("n_words") >= 30) & (share("n_distinct") > 0.4), (F.col("n_words") >= 30) & (share("n_distinct") < 0.2)),
        "punctuation": (share("n_stops").between(0.03, 0.4), share("n_stops") < 0.01),
        "digits": (F.col("n_digits") < 0.05 * F.col("word_chars"), F.col("n_digits") > 0.2 * F.col("word_chars")),
        "line_ends": (share("n_ended", lines) >= 0.5, share("n_ended", lines) < 0.1),
    }


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """EM on vote patterns (rows of 0 bad, 1 abstain, 2 good) with their numbers of documents.

    Returns the share of good documents and accuracy[rule, class] (0 bad, 1 good): how often the rule is
    right on documents of that class when it votes. That a rule abstains says nothing. EM starts from the
    belief that a document with two bad votes or more is bad.
    """
    up, down = votes == 2, votes == 0
    post = 1 / (1 + np.exp(-3 * (1.5 - down.sum(1))))
    prior, accuracy = 0.5, np.full((votes.shape[1], 2), 0.5)
    for _ in range(rounds):
        good, bad = weight * post, weight * (1 - post)
        prior = (good.sum() + smooth) / (weight.sum() + 2 * smooth)
        accuracy = np.stack([(bad @ down + smooth) / (bad @ (up | down) + 2 * smooth), (good @ up + smooth) / (good @ (up | down) + 2 * smooth)], 1)
        log_good, log_bad = evidence(accuracy)
        odds = np.log(prior / (1 - prior)) + up @ log_good + down @ log_bad
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if not len(post) or np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(prior), accuracy


def evidence(accuracy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a good and a bad vote of each rule add to the log odds that a document is good."""
    bad, good = accuracy[:, 0], accuracy[:, 1]
    return np.log(good / (1 - bad)), np.log((1 - good) / bad)


def _judged(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    schema = "doc_id long, th long, " + ", ".join(f"{f} long" for f in FEATURES)
    seen = stored(rows.mapInArrow(_counted, schema), shared_dir(docs.sparkSession) + "/counts")
    votes = [F.when(bad, 0).when(good, 2).otherwise(1) for good, bad in rules().values()]
    pattern = sum((v * 3**i for i, v in enumerate(votes)), F.lit(0)).cast("long")
    tally = seen.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n")).collect()  # at most 3^11 rows
    tally = sorted((r["pattern"], r["n"]) for r in tally)
    table = np.array([[x // 3**i % 3 for i in range(len(votes))] for x, _ in tally], np.int64).reshape(-1, len(votes))
    prior, accuracy = fit(table, np.array([n for _, n in tally], float))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for v, up, down in zip(votes, *evidence(accuracy)):
        odds = odds + F.when(v == 2, float(up)).when(v == 0, float(down)).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = seen.withColumn("base_failed", failed).withColumn("good", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= 0.5))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the FEATURES, base_failed, good (the posterior probability) and kept, for each row."""
    return _judged(docs).drop("th")


def quality_filter(docs: DataFrame) -> DataFrame:
    """docs whose verdict is to keep; all columns as they were. Of rows that share a doc_id, or lack one,
    those stay whose own text is kept."""
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    good = _judged(docs).where("kept").select("doc_id", "th").distinct()
    mine = F.col(f"_c{at}").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(f"_c{text}") == F.col("th"))
    return flat.join(good, mine, "left_semi").toDF(*docs.columns)
