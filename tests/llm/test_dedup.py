"""Exact, line, near and substring dedup: odd rows, deletion, batches, brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgspark.llm.exact_dedup import CuckooIndex, ExactDedup, exact_dedup, exact_groups
from kgspark.llm.line_dedup import LineRuns, line_dedup
from kgspark.llm.near_dedup import _exact_links, near_dedup, near_groups
from kgspark.llm.minmax import band_keys, band_values, sketches
from kgspark.llm.substring_dedup import FingerprintRuns, substring_cut, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_insert_delete_resize():
    index = CuckooIndex(buckets=4)
    for i in range(3000):
        index.insert(digest(i), i, i, i, 1)
    assert index.mask + 1 > 4 and all(index.find(digest(i), i, i) >= 0 for i in range(3000))
    assert index.find(digest(5), 6, 5) < 0  # same print, other content
    assert all(index.delete(digest(i), i, i) for i in range(0, 3000, 2)) and not index.delete(digest(0), 0, 0)
    assert all((index.find(digest(i), i, i) >= 0) == bool(i % 2) for i in range(3000))
    index.insert(digest(0), 0, 0, 7, 1)
    index.insert(digest(0), 0, 0, 9, 2)
    entry = index.find(digest(0), 0, 0)
    assert (index.keep[entry], index.copies[entry], index.live) == (9, 3, 1501)


def test_exact_groups_of_odd_rows(odd, none):
    got = exact_groups(odd).collect()
    assert len(got) == odd.count() and exact_groups(none).count() == 0
    fox = [r for r in got if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in fox} == {2} and {r["group_size"] for r in fox} == {3} and sum(r["kept"] for r in fox) == 1
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {4} and len(empty) == 3  # 3, 4 and the row without id
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_exact_groups_of_one_repeated_row(spark):
    """Rows that are repeated whole, beyond what one task should hold: one of them stays."""
    docs = spark.createDataFrame([(7, "same")] * 5000 + [(8, "same")] * 3 + [(None, "x")] * 4 + [(1, "y")], "doc_id long, text string").repartition(6)
    got = exact_groups(docs).toPandas()
    assert len(got) == 5008 and got.kept.sum() == 3 and got[got.kept & (got.group_size == 5003)].doc_id.tolist() == [8]
    assert exact_dedup(docs).count() == 3


def test_exact_dedup_keeps_columns(odd, none):
    out = exact_dedup(odd)
    assert out.columns == odd.columns and out.count() == len({t or "" for t in (r["text"] for r in odd.collect())})
    assert exact_dedup(none).columns == odd.columns


def test_index_over_time(spark):
    index = ExactDedup(spark)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.insert(docs((1, "a"), (2, "b")))
    index.insert(docs((3, "a")))
    assert {(r["keep_id"], r["copies"]) for r in index.live().collect()} == {(3, 2), (2, 1)}
    index.delete(docs((9, "a")))
    assert {r["keep_id"] for r in index.live().collect()} == {2}
    index.insert(docs((1, "a")))
    assert {(r["keep_id"], r["copies"]) for r in index.live().collect()} == {(1, 1), (2, 1)}


def test_lines_of_odd_rows(odd, none):
    got = line_dedup(odd).collect()
    assert len(got) == odd.count() and line_dedup(none).count() == 0
    by = {(r["doc_id"], r["n_lines"]): r for r in got}
    assert by[(3, 1)]["text"] == "" and by[(9, 31)]["n_dropped"] == 0  # one document has it thirty times, which is once


@pytest.mark.parametrize("batches", [1, 3])
def test_lines_by_hand(spark, batches):
    line = "a line that is long enough"
    rows = [(1, f"{line}\nx"), (2, f"  {line.upper()}  \ny\n{line}"), (3, f"z\n{line}\n"), (4, "short\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup(docs, batches=batches).collect()}
    assert got == {1: (2, 1, "x"), 2: (3, 2, "y"), 3: (3, 0, f"z\n{line}\n"), 4: (2, 0, "short\nshort")}


def brute_lines(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key, held = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low), defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (5, 2), (9, 4)])
def test_lines_against_brute_force(spark, batches, fanout):
    """Line ends of other kinds are part of a line; only \\n ends one and only the six white spaces are stripped."""
    line = "the same words in each of them"
    ends = ["", "  ", "\u2028", "  \u2028", "\u2029", " \u0085", "\x0b\x0c", "\r", "\u3000", "\x1c"]
    rows = [(10 * i + k, f"own line number {i} and {k}\n\t{line.upper() if k % 2 else line}{end}\nshort") for i, end in enumerate(ends) for k in range(2 + i % 3)]
    rows += [(None, f"{line}\n{line}"), (None, line), (500, None), (501, ""), (502, f"{' ' * 30_000}{line}{' ' * 30_000}x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup(docs, batches=batches, fanout=fanout).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(rows)


def test_lines_come_through_the_anti_join(spark, monkeypatch):
    """Without what the merge anti-join gives, keys that later batches bring first are lost."""
    rows = [(i, f"a line that three documents hold {i % 40}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r["n_dropped"] for r in line_dedup(docs).collect()) == 120
    monkeypatch.setattr(LineRuns, "unknown", lambda self, batch: batch.limit(0))
    assert sum(r["n_dropped"] for r in line_dedup(docs).collect()) < 120


def test_runs_compact(spark):
    runs = LineRuns(spark)
    batch = lambda *keys: spark.createDataFrame([(k.encode(), 1, n) for n, k in enumerate(keys)], "key binary, n_docs long, top_doc long")
    for keys in ("ab", "bc", "d", "a"):
        runs.add(batch(*keys))
    assert [len(level) for level in runs.levels] == [0, 1] and runs.compactions == 1
    runs.add(batch("e", "a"))
    assert {bytes(r["key"]): (r["n_docs"], r["top_doc"]) for r in runs.totals().collect()} == {b"a": (3, 1), b"b": (2, 1), b"c": (1, 1), b"d": (1, 0), b"e": (1, 0)}
    assert {bytes(r["key"]) for r in runs.unknown(batch("e", "x")).collect()} == {b"x"}
    runs.drop()
    assert runs.totals().count() == 0


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets, at = {}, defaultdict(list)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, t in rows:
        sets.setdefault(shingles(t, k), []).append(i)
    for s, ids in sets.items():
        for i in ids:
            root(i)
        if s:
            for i in ids:
                parent[max(root(i), root(ids[0]))] = min(root(i), root(ids[0]))
            for g in s:
                at[g].append(s)
    for s in sets:
        both = Counter(x for g in s for x in at[g])
        for o, n in both.items():
            if o is not s and 100 * n >= percent * (len(s) + len(o) - n):
                a, b = root(sets[s][0]), root(sets[o][0])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("k", [4, 5])
def test_near_against_brute_force(documents, k):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute_components(rows, k, 80)
    got = near_groups(documents, k, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, k)) for i, t in rows}


def test_near_chain_and_hub(spark):
    """Links that no hub sees: a chain of texts, each near only to the next."""
    base = [f"w{i}" for i in range(200)]
    rows = [(j, " ".join(f"v{j}x{i}" if i < 6 * j else w for i, w in enumerate(base))) for j in range(12)]
    rows += [(100, None), (101, ""), (102, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in near_groups(docs, 4, 80).collect()} == want


def test_near_of_odd_rows(odd, none):
    got = near_groups(odd, 4).collect()
    assert len(got) == odd.count() and near_groups(none, 4).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["n_shingles"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    out = near_dedup(odd)
    assert out.columns == odd.columns and out.where("doc_id = 2").count() == 0 and out.where("doc_id = 5").count() == 1


def test_bands_take_different_permutations():
    for own in band_values(48, 4):
        assert len({v % 48 for v in own}) == 4 and sum(v < 48 for v in own) == 2
    assert sorted(v for own in band_values(48, 4) for v in own) == list(range(96))


def test_sketches_find_pairs_near_the_threshold():
    """Pairs of similarity 0.8 share a band; each extreme agrees as often as the sets are alike."""
    rng = np.random.default_rng(11)
    same, own = 160, 20
    sets = []
    for _ in range(1500):
        common = rng.integers(0, 2**63, same, dtype=np.uint64)
        sets += [np.sort(np.r_[common, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2)]
    sketch = sketches(np.concatenate(sets), np.arange(len(sets) + 1) * (same + own), 48)
    agree = sketch[::2] == sketch[1::2]
    assert abs(agree[:, :48].mean() - 0.8) < 0.01 and abs(agree[:, 48:].mean() - 0.8) < 0.01
    keys = band_keys(sketch, 4)
    assert (keys[::2] == keys[1::2]).any(1).all()


def test_near_large_group_of_copies(spark):
    """Exact and near copies of one text, some thousand, and a group that no hub links whole."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(2000)] + [(2000 + i, " ".join([*base[:-1], f"x{i}"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_groups(docs, 4, 80)
    assert got.where("component_id <> 0").count() == 0 and got.where("kept").count() == 1


def test_exact_links():
    a = [np.array([1, 2, 3, 4, 5], np.uint64), np.array([9], np.uint64)]
    b = [np.array([1, 2, 3, 4], np.uint64), np.array([7, 8], np.uint64)]
    x, y = _exact_links(a, b, 80)
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0)]


def brute_cut(rows):
    seen = Counter()
    words = [WORD.findall(t or "") for _, t in rows]
    for w in words:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        out.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (2, 4), (9, 3)])
def test_substrings_of_odd_rows(odd, none, batches, fanout):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup(odd, batches, fanout).collect())
    assert got == brute_cut(rows)
    assert substring_dedup(none).count() == 0


def test_substrings_come_through_the_merge_join(spark, monkeypatch):
    """Without what the merge joins with earlier runs find, passages of documents of different batches stay."""
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = [(j, passage) for i in range(20) for passage in [text(60)] for j in (i, 100 + i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_removed"] == 60 for r in substring_dedup(docs).collect())
    monkeypatch.setattr(FingerprintRuns, "known", lambda self, batch: None)
    assert not all(r["n_removed"] == 60 for r in substring_dedup(docs).collect())


def test_substrings_shared_in_part(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, loop = text(60), "tick tock " * 40
    rows = [(1, f"{text(20)} {passage} {text(30)}"), (2, f"{text(50)} {passage}"), (3, f"{passage[:200]} {text(40)}"), (4, loop), (5, text(100)), (6, f"{text(10)} {passage} x {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup(docs).collect())
    assert got == brute_cut(rows)


def test_cut_keeps_columns(odd):
    out = substring_cut(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 6 and text = 'short text'").count() == 1 and out.where("doc_id = 3 and text is null").count() == 1


def test_known_fingerprints(spark):
    runs = FingerprintRuns(spark, fanout=2)
    batch = lambda *fp: spark.createDataFrame([(f, f, 1, 0, 1) for f in fp], "fp long, bh long, rid long, lo int, wins int")
    hits = [{r["fp"] for r in runs.add(batch(*b)).collect()} for b in ((1, 2), (2, 3), (3, 4, 4))]
    assert hits == [set(), {2}, {3, 4}] and runs.compactions == 1
    assert {r["fp"]: r["n"] for r in runs.compacted().collect()} == {1: 1, 2: 2, 3: 2, 4: 2}
