"""Language-model scores by online logistic context mixing (after Mahoney's PAQ family).

A text is its words, A-Z lower-cased, and one end. Each token is written as bits: the path of a Huffman code
over the CODED most frequent tokens, or an escape and the word's bytes by a Huffman code of their own. Every
bit is predicted by hashed contexts:

    word bits   the node of the code; node and last of the FREQUENT words (deep nodes: of the FEW most
                frequent); node and last word (deep nodes: node and the first bits of the last word's code);
                and the token that followed the same CONTEXT words in other texts
    byte bits   node and the last two bytes of the word; the last three; the last five

The short contexts are tables of how often each of their slots saw a one and a zero in all learned texts. They
are counted over all of them (each task adds up its own, then blocks are summed over tasks) and have a fixed
size, which a cluster of any size can hold. The long context grows with the corpus and stays distributed:
where the hash of CONTEXT words falls in one class of ANCHOR, the tokens that follow up to the next such place
are kept with it, tallied over all learned rows, and only what a text's own places find travels to it. A
learned row is scored by what other rows say there; its own does not count.

Scoring learns while it codes: predictions are combined as logits by the set of weights that is selected by the kind
of bit and by how often the two longer contexts were seen, or by a long context that predicts; all weights set out
alike in every text; each coded block moves them by its errors; and a map from combined prediction to observed
frequency, filled as the text goes, refines the result. What a long context says weighs the more, the longer it
has been right without a break. A bit's probability depends on nothing that follows it.

Counts of single tokens, for the base score, are exact and cover all learned texts. The most frequent ones
travel with the tables (HOT at most); the other tokens of a text are joined with the full table by hash.

Defined results: a null, empty or blank text is its end alone. Rows repeated are scored each. With nothing
to learn from, every bit costs one bit and base_score is 0. A null doc_id counts as an empty one in the
split. An empty table gives no rows. Columns other than doc_id and text are not read. Tokens are told apart
by 64-bit hashes, those that a long context foretells by 24 bits of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import Words, discard, join_by_weight, pick, shared_dir, slices, splitmix, spread, stored, windows

#: Tokens whose counts travel with the tables; those with a code word of their own, seen CODED_LEAST times or more.
HOT, CODED, CODED_LEAST, FREQUENT = 1 << 18, 1 << 18, 2, 64
#: Sizes of the three tables' parts for word bits and byte bits, as powers of two.
WORD_BITS, SPELL_BITS = (18, 22, 22), (19, 20, 20)
#: The hash of the end token.
END = np.uint64(0x5851F42D4C957F2D)
#: Nodes, counted from the root by weight, that have a slot for each FREQUENT word and for each of 2^12 hashes of
#: the last word. All others have one for each of the 7 most frequent words, and for 3 bits of the last word's code.
BROAD, NEAR, FEW = 1 << 14, 1 << 8, 8
#: Words of a long context; one in so many places keeps what follows, at most FOLLOW tokens in TAG bytes each.
CONTEXT, ANCHOR, FOLLOW, TAG = 4, 16, 64, 3
LEVELS = 4
GATES = LEVELS * LEVELS
CELLS = 33
_SLICE = 1 << 19
_BLOCK = 1 << 12
#: Bits looked up at once, which stay in the caches.
_CHUNK = 1 << 15
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes for symbols of the given weights: offsets; for each step of each path its node and bit; and what
    weight takes bit 0 and bit 1 at each node, in turn. Nodes are numbered from the root down by weight."""
    n = len(weights)
    if n < 2:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    order = np.argsort(weights, kind="stable")
    leaves, inner = [(int(weights[i]), int(i)) for i in order], []
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    split = np.zeros(2 * (n - 1), np.int64)
    at = head = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for bit in (0, 1):
            if at < n and (head >= len(inner) or leaves[at][0] <= inner[head][0]):
                w, x = leaves[at]
                at += 1
            else:
                w, x = inner[head]
                head += 1
            parent[x], side[x] = node, bit
            split[2 * (2 * n - 2 - node) + bit] = w
            total += w
        inner.append((total, node))
    root, here, steps = 2 * n - 2, np.arange(n), []
    while (live := here != root).any():
        up = np.where(live, parent[here], root)
        steps.append((live, root - up, side[here]))
        here = up
    length = sum(s[0].astype(np.int64) for s in steps)
    off = np.r_[0, np.cumsum(length)]
    nodes, bits = np.empty(off[-1], np.int32), np.empty(off[-1], np.uint8)
    for k, (live, node, bit) in enumerate(steps):  # the k-th step from the leaf is the k-th from the path's end
        to = off[1:][live] - 1 - k
        nodes[to], bits[to] = node[live], bit[live]
    return off, nodes, bits, split


@dataclass
class Code:
    """How tokens become bits.

    hashes, counts: the hot tokens by hash; symbol: the code word of each, or the escape, which is the last;
    rank: of each symbol by frequency.
    """

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    rank: np.ndarray
    word: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    byte: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, total: int, letters: np.ndarray) -> Code:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        top = np.lexsort((hashes, -counts))[: CODED - 1]
        top = np.sort(top[(counts[top] >= CODED_LEAST) | (hashes[top] == END)])
        symbol = np.full(len(hashes) + 1, len(top), np.int64)
        symbol[top] = np.arange(len(top))
        weights = np.r_[counts[top], max(1, total - counts[top].sum())]
        rank = np.empty(len(weights), np.int64)
        rank[np.lexsort((np.arange(len(weights)), -weights))] = np.arange(len(weights))
        return cls(hashes, counts, symbol, rank, huffman(weights), huffman(letters + 1))

    def __post_init__(self):
        """An open-addressed table of the hot tokens' places, the first three bits of each code word, and symbols by tag."""
        self.escape = len(self.rank) - 1
        coded = np.flatnonzero(self.symbol[:-1] != self.escape)
        own = tags(self.hashes[coded])
        order = np.lexsort((self.rank[self.symbol[coded]], own))  # of a tag's tokens, the most frequent
        new = np.r_[True, own[order][1:] != own[order][:-1]][: len(order)]
        self.tag, self.tag_symbol = own[order][new].astype(np.int64), self.symbol[coded][order][new]
        start, _, path, _ = self.word
        self.first = np.zeros(len(self.rank), np.int32)
        for k in range(3):
            long = start[1:] - start[:-1] > k
            self.first[long] |= path[start[:-1][long] + k].astype(np.int32) << k
        # where the slots of each node begin in the second and third table, and how many steps of each path use the wide ones
        node = np.arange(max(1, len(self.rank) - 1), dtype=np.int32)
        self.base = [np.where(node < most, node << shift, (1 << bits - 1) + (node << 3)) for most, shift, bits in ((BROAD, 6, WORD_BITS[1]), (NEAR, 12, WORD_BITS[2]))]
        self.wide = {}
        for most in (BROAD, NEAR):
            low = np.r_[0, np.cumsum(self.word[1] < most)]
            self.wide[most] = (low[start[1:]] - low[start[:-1]]).astype(np.int32)
        self.keys = np.append(self.hashes, np.uint64(0))
        self.shift = np.uint64(64 - max(4, 2 + len(self.hashes).bit_length()))
        self.table = np.full((1 << (64 - int(self.shift))) + 64, -1, np.int32)
        todo, at = np.arange(len(self.hashes), dtype=np.int32), (self.hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            todo, at = todo[lost], at[lost] + 1

    def tagged(self, tag: np.ndarray) -> np.ndarray:
        """The symbol of each tag, or the escape."""
        if not len(self.tag):
            return np.full(len(tag), self.escape)
        at = np.minimum(np.searchsorted(self.tag, tag), len(self.tag) - 1)
        return np.where(self.tag[at] == tag, self.tag_symbol[at], self.escape)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each token stands among the hot ones; their number if it is not there."""
        at = (h >> self.shift).astype(np.int64)
        found = self.table.take(at)
        todo = np.flatnonzero((found >= 0) & (self.keys.take(found) != h))
        while len(todo):
            at[todo] += 1
            own = self.table[at[todo]]
            found[todo] = own
            todo = todo[(own >= 0) & (self.keys[own] != h[todo])]
        return np.where(found < 0, len(self.hashes), found)


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, hashes of all tokens (each text's words, then its end), each one's word or -1, and offsets of the texts."""
    w = Words(texts, lower=True)
    n = len(w.doc) - 1
    off = w.first + np.arange(n + 1)
    h, which = np.full(off[-1], END, np.uint64), np.full(off[-1], -1, np.int64)
    at = np.arange(len(w.start)) + np.repeat(np.arange(n), w.counts())
    h[at], which[at] = w.hashes(), np.arange(len(w.start))
    return w, h, which, off


def _paths(code: tuple, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the paths of symbols in a row: length of each, and node and bit of each step."""
    off, nodes, bits, _ = code
    length = (off[1:] - off[:-1]).take(symbols)
    ends = np.r_[0, np.cumsum(length)]
    shift = off.take(symbols) - ends[:-1]
    node, bit = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.uint8)
    for i in range(0, len(symbols), _BLOCK):
        j = min(i + _BLOCK, len(symbols))
        own = slice(ends[i], ends[j])
        src = np.arange(ends[i], ends[j])
        src += np.repeat(shift[i:j], length[i:j])
        node[own], bit[own] = nodes.take(src), bits.take(src)
    return length, node, bit


def _slot(node: np.ndarray, context: np.ndarray, table: int) -> np.ndarray:
    """A slot of the hashed part of a table that holds spellings."""
    x = (node.astype(np.uint64) * _A + context) * _B
    return (1 << WORD_BITS[table]) + (x >> np.uint64(64 - SPELL_BITS[table])).astype(np.int32)


def sizes() -> list[int]:
    return [(1 << a) + (1 << b) for a, b in zip(WORD_BITS, SPELL_BITS)]


#: One kind of bits of all texts of a slice: the slots of the three predictors, the bits, and offsets of the texts.
Stream = tuple[list[np.ndarray], np.ndarray, np.ndarray]


@dataclass
class Tokens:
    """The tokens of a slice of texts: see tokens(); place and symbol in the code, and what went before.

    context has in one number the last frequent word, the last very frequent one, and the last word's code and hash.
    """

    w: Words
    h: np.ndarray
    which: np.ndarray
    off: np.ndarray
    place: np.ndarray
    s: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, code: Code, texts: pa.Array) -> Tokens:
        w, h, which, off = tokens(texts)
        place = code.places(h)
        s = code.symbol.take(place)
        rank = code.rank.take(s)
        word = (s != code.escape) & (which >= 0)
        begins = np.repeat(off[:-1], np.diff(off))
        many, few = (_latest(np.where(word & (rank < most - 1), rank + 1, 0), begins) for most in (FREQUENT, FEW))
        context = (many << 18 | few << 15).astype(np.int32)
        context[1:] |= code.first.take(s[:-1]) << 12 | (h[:-1] >> np.uint64(52)).astype(np.int32)
        context[off[:-1]] &= ~((1 << 15) - 1)
        return cls(w, h, which, off, place, s, context)


def word_bits(code: Code, t: Tokens) -> tuple[Stream, np.ndarray]:
    """The bits of all tokens' paths, and how many each token has."""
    n_path, node, bits = _paths(code.word, t.s)
    slots, parts = [node], np.empty((len(t.s), 2), np.int64)
    context = np.empty((len(t.s), 2), np.int32)
    for base, wide, (_, many, mask), (_, few, least) in zip(code.base, code.wide.values(), _CLASSES[::2], _CLASSES[1::2]):
        parts[:, 0] = wide.take(t.s)  # a path's first steps are at its widely told nodes
        parts[:, 1] = n_path - parts[:, 0]
        context[:, 0], context[:, 1] = t.context >> many & mask, t.context >> few & least
        slot = np.repeat(context.ravel(), parts.ravel())
        for i in range(0, len(node), _CHUNK):
            slot[i : i + _CHUNK] += base.take(node[i : i + _CHUNK])
        slots.append(slot)
    return (slots, bits, np.r_[0, np.cumsum(n_path)][t.off]), n_path


def byte_bits(code: Code, t: Tokens, known: np.ndarray | None = None) -> Stream:
    """After each escape the word's bytes and its end, but for the tokens that are known otherwise."""
    spelt = (t.s == code.escape) & (t.which >= 0)
    rare = np.flatnonzero(spelt if known is None else spelt & ~known)
    own, w = t.which[rare], t.w
    size = w.length[own] + 1
    ends = np.cumsum(size)
    pos = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    letter = w.data.take(np.minimum(np.repeat(w.start[own], size) + pos, max(0, len(w.data) - 1))).astype(np.int64) if len(rare) else pos
    letter[ends - 1] = 256
    n_letter, node, bits = _paths(code.byte, letter)
    so_far, slots = np.zeros(len(letter), np.uint64), []
    for k in range(5):
        so_far[k + 1 :] += np.where(pos[k + 1 :] > k, letter[: max(0, len(letter) - k - 1)] + 1, 0).astype(np.uint64) << np.uint64(10 * k)
        if k in (1, 2, 4):
            slots.append(_slot(node, np.repeat(splitmix(so_far), n_letter), len(slots)))
    upto = np.r_[0, np.cumsum(n_letter)][np.r_[0, ends]]
    return slots, bits, upto[np.searchsorted(rare, t.off)]


def tags(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8 * (8 - TAG))).astype(np.uint32)


def anchors(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose context is an anchor: its hash, the first token after it, and how many follow up to the next one."""
    at = spread(off, CONTEXT + 1)
    g = windows(h, CONTEXT)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    at = at[(g[at] & np.uint64(ANCHOR - 1)) == 0]
    text = np.searchsorted(off, at, side="right") - 1
    follow = off[text + 1] - at - CONTEXT
    same = np.flatnonzero(text[1:] == text[:-1])
    follow[same] = np.minimum(follow[same], at[same + 1] - at[same])
    return g[at], at + CONTEXT, np.minimum(follow, FOLLOW)


def _flat(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of n in turn."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def followers(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each text's anchors, each hash once: the text's number, the hash, and the tags of the tokens that follow."""
    key, at, n = anchors(h, off)
    text = np.searchsorted(off, at, side="right") - 1
    order = np.lexsort((at, key, text))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(order)]
    once = order[new]
    key, at, n, text = key[once], at[once], n[once], text[once]
    body = np.ascontiguousarray(tags(h)[_flat(at, n)]).view(np.uint8).reshape(-1, 4)[:, :TAG].tobytes()
    ends = np.r_[0, np.cumsum(n)] * TAG
    return text, key, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body)])


def foretold(t: Tokens, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the tag that the long context foretells, or -1, and by how many rows; found lists
    (key, follow, n) for each text."""
    guess, weight = np.full(len(t.h), -1, np.int64), np.zeros(len(t.h), np.int64)
    rows = found.flatten()
    if not len(rows):
        return guess, weight
    listed = np.diff(found.offsets.to_numpy())
    mixed_key = lambda text, key: splitmix(text.astype(np.uint64) * _A + key)
    keys = mixed_key(np.repeat(np.arange(len(listed)), listed), rows.field(0).to_numpy(zero_copy_only=False).view(np.uint64))
    order = np.argsort(keys)
    keys = keys[order]
    key, at, n = anchors(t.h, t.off)
    own = mixed_key(np.searchsorted(t.off, at, side="right") - 1, key)
    to = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    hit = np.flatnonzero(keys[to] == own)
    entry, at, n = order[to[hit]], at[hit], n[hit]
    follow = rows.field(1)
    size = (pc.binary_length(follow).to_numpy(zero_copy_only=False) // TAG).astype(np.int64)
    raw = np.frombuffer(b"".join(follow.to_pylist()), np.uint8).reshape(-1, TAG).astype(np.int64)
    value = raw @ (1 << 8 * np.arange(TAG))
    n = np.minimum(n, size[entry])
    to = _flat(at, n)
    guess[to] = value[_flat((np.cumsum(size) - size)[entry], n)]
    weight[to] = np.repeat(rows.field(2).to_numpy(zero_copy_only=False)[entry], n)
    return guess, weight


def matched(code: Code, t: Tokens, n_path: np.ndarray, path: np.ndarray, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the long context says: the logit of each word bit, of which path has the bits themselves (0 where it says
    nothing), which tokens need no spelling as they are the rare ones foretold, and the bits that telling so costs in
    each text."""
    guess, weight = foretold(t, found)
    said = np.flatnonzero(guess >= 0)
    logit, known = np.zeros(int(n_path.sum()), np.float32), np.zeros(len(t.s), bool)
    extra = np.zeros(len(t.off) - 1)
    if not len(said):
        return logit, known, extra
    tag = guess[said]
    symbol = code.tagged(tag)
    text = np.searchsorted(t.off, said, side="right") - 1
    right = (symbol == t.s[said]) & ((symbol != code.escape) | (tags(t.h[said]) == tag))
    seen = np.arange(len(said))
    first = np.r_[True, text[1:] != text[:-1]]
    # how many were right in a row just before, in the same text
    broken = np.maximum.accumulate(np.where(first, seen, np.r_[0, np.where(right[:-1], 0, seen[1:])]))
    trust = np.log((seen - broken + weight[said] + 0.4) / 0.4).astype(np.float32)

    off, nodes, _, _ = code.word
    size = np.diff(off)
    shared = np.where(symbol == t.s[said], size[symbol], 0)  # steps of the path on which the guess says something
    wrong = np.flatnonzero(symbol != t.s[said])
    a, b = off[symbol[wrong]], off[t.s[said][wrong]]
    most = np.minimum(size[symbol[wrong]], size[t.s[said][wrong]])
    live = np.arange(len(wrong))
    for k in range(int(most.max()) if len(most) else 0):
        live = live[(most[live] > k)]
        live = live[nodes[a[live] + k] == nodes[b[live] + k]]
        shared[wrong[live]] += 1
    # on those steps the guess has the path's own bits, but for the last one if it goes elsewhere there
    parts, signs = np.zeros((len(n_path), 2), np.int64), np.zeros((len(n_path), 2), np.float32)
    parts[said, 0] = shared
    parts[:, 1] = n_path - parts[:, 0]
    signs[said, 0] = trust
    logit = np.repeat(signs.ravel(), parts.ravel())
    logit *= 2 * path.astype(np.float32) - 1
    turn = wrong[shared[wrong] > 0]
    last = (np.cumsum(n_path) - n_path)[said[turn]] + shared[turn] - 1
    logit[last] = -logit[last]

    # an escape where a token without a code word is foretold: is it that one?
    asked = np.flatnonzero((symbol == code.escape) & (t.s[said] == code.escape) & (t.which[said] >= 0))
    if len(asked):
        yes, whose = right[asked], text[asked]
        start = np.r_[True, whose[1:] != whose[:-1]]
        order = np.arange(len(asked))
        begin = np.maximum.accumulate(np.where(start, order, 0))
        before = np.r_[0, np.cumsum(yes)[:-1]]
        before = before - before[begin]
        p = (before + 1) / (order - begin + 1.25)
        p = np.clip(p, 1e-3, 1 - 1e-3)
        extra += np.bincount(whose, weights=-np.log2(np.where(yes, p, 1 - p)), minlength=len(extra))
        known[said[asked[yes]]] = True
    return logit, known, extra


def _latest(kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each token the last kind that is not 0 among the text's tokens before it, or 0."""
    if not len(kind):
        return kind
    seen = np.maximum.accumulate(np.where(kind > 0, np.arange(len(kind)), -1))
    seen = np.r_[-1, seen[:-1]]
    return np.where(seen >= begins, kind[np.maximum(seen, 0)], 0)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, uid, follow) of rows (uid, held_out, text): kind 0 counts learned tokens by hash, kind 1 bytes
    of learned words and, as 256, their ends; kind 2 has the anchors of all rows, n being 1 if it is learned."""
    letters = np.zeros(257, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["kind", "key", "n", "uid", "follow"]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)

    def rows(kind: int, keys: np.ndarray, n: np.ndarray, uid=None, follow=None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            more = [pa.nulls(len(k), t) if c is None else c[i : i + 100_000] for c, t in ((uid, pa.int64()), (follow, pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[i : i + 100_000]), *more], names)

    for batch in batches:
        for learned in (True, False):
            for b in slices([batch.filter(pc.equal(batch.column(1), not learned))], most=1 << 21):
                w, h, _, off = tokens(b.column(2))
                text, key, follow = followers(h, off)
                yield from rows(2, key, np.full(len(key), int(learned), np.int64), b.column(0).take(pa.array(text)), follow)
                if not learned:
                    continue
                letters[:256] += np.bincount(w.data, minlength=256)
                letters[256] += len(w.start)
                held.append(np.unique(h, return_counts=True))
                if sum(len(k) for k, _ in held) > 1_000_000:  # bounded: what has been added up so far goes on
                    held = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield from rows(0, *held.pop())
    if held:
        yield from rows(0, *merged())
    letters[[0x20, 9, 10, 11, 12, 13]] = 0
    yield from rows(1, np.arange(257, dtype=np.uint64), letters)


def groups(code: Code, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols whose paths agree at all nodes below `most`: the group of each, and of each group a symbol and the
    length of that part of its path. Nodes below `most` come first on every path."""
    off, nodes, bits, _ = code.word
    size, symbols = np.diff(off), np.arange(len(code.rank))
    part = code.wide[most].astype(np.int64)
    last = off[:-1] + part - 1
    own = np.where(part > 0, (nodes[np.maximum(last, 0)].astype(np.int64) << 1 | bits[np.maximum(last, 0)]) if len(nodes) else -1, -1) if len(size) else symbols
    _, one, group = np.unique(own, return_index=True, return_inverse=True)
    return group, one, part[one]


#: Classes of what went before, and shift and mask of each in Tokens.context.
_CLASSES = ((64, 18, 63), (8, 15, 7), (4096, 0, 4095), (8, 12, 7))


def _counted(shared) -> object:
    """(kind, block, planes) of learned texts, as byte planes of uint32: kinds 0 to 3 say how often each group of
    symbols came after each of _CLASSES, kinds 4 to 6 how often each slot of spellings saw a zero and a one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        whole = np.arange(len(code.rank))
        of = [groups(code, BROAD)[0], whole, groups(code, NEAR)[0], whole]
        seen = [np.zeros(n * (int(g.max()) + 1), np.uint32) for g, (n, _, _) in zip(of, _CLASSES)]
        spelt = [np.zeros(2 << n, np.uint32) for n in SPELL_BITS]
        one = np.uint32(1)
        for b in slices(batches, most=1 << 19):
            t = Tokens.of(code, b.column(0))
            for table, g, (n, shift, mask) in zip(seen, of, _CLASSES):
                np.add.at(table, g.take(t.s) * n + (t.context >> shift & mask), one)
            slots, bits, _ = byte_bits(code, t)
            for k, table in enumerate(spelt):
                np.add.at(table, (slots[k] - (1 << WORD_BITS[k]) << 1) + bits, one)
        for kind, table in enumerate(seen + spelt):
            for at in range(0, len(table), _BLOCK):
                part = table[at : at + _BLOCK]
                if part.any():
                    planes = np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at // _BLOCK], pa.int32()), pa.array([planes], pa.binary())], ["kind", "block", "planes"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the planes of each block over tasks, as float32."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for kind, block, planes in zip(*(c.to_pylist() for c in b.columns)):
            part = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.float64)
            total[kind, block] = total[kind, block] + part if (kind, block) in total else part
    for (kind, block), n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], ["kind", "block", "counts"])


def slot_counts(code: Code, seen: list[np.ndarray], k: int) -> np.ndarray:
    """Zeros and ones in turn of the slots of table k (0 to 2), from the counts of groups and of spellings."""
    off, nodes, bits, split = code.word
    out = np.zeros(2 * sizes()[k], np.float32)
    if k == 0:
        out[: len(split)] = split
    else:
        for part, (n, most, shift) in enumerate(((_CLASSES[2 * k - 2][0], (BROAD, NEAR)[k - 1], (6, 12)[k - 1]), (8, len(code.rank), 3))):
            group, one, size = groups(code, most) if part == 0 else (None, np.arange(len(code.rank)), np.diff(off))
            steps = _flat(off[one], size)
            g = np.repeat(np.arange(len(one)), size)
            table = seen[2 * k - 2 + part].reshape(-1, n)
            node, bit = nodes[steps].astype(np.int64), bits[steps]
            if part:
                deep = node >= (BROAD, NEAR)[k - 1]
                g, node, bit = g[deep], node[deep], bit[deep]
            base = (1 << WORD_BITS[k] - 1) if part else 0
            top = int(node.max()) + 1 if len(node) else 0
            for c in range(n):
                n_c = np.bincount(node << 1 | bit, weights=table[g, c], minlength=2 * top)
                to = 2 * (base + (np.arange(top) << shift | c))
                out[to], out[to + 1] = n_c[0::2], n_c[1::2]
    out[2 << WORD_BITS[k] :] = seen[4 + k]
    return out


#: A power of two, with which 12 fits into 16 bits.
UNIT = np.float32(1 / 2048)


def logits(counts: np.ndarray) -> np.ndarray:
    """From zeros and ones in turn: the logit of each slot in units of UNIT, whose last two bits say instead how
    often the slot was seen (never, 1 to 3, 4 to 31, 32 times or more)."""
    out = np.empty(len(counts) // 2, np.int16)
    for at in range(0, len(out), 1 << 18):
        zero, one = (counts[2 * at + bit : 2 * at + (2 << 18) : 2].astype(float) for bit in (0, 1))
        level = np.searchsorted([1, 4, 32], zero + one, side="right").astype(np.int16)
        logit = np.rint(np.clip(np.log((one + 0.4) / (zero + 0.4)), -12, 12) / (4 * UNIT)).astype(np.int16)
        out[at : at + len(logit)] = logit << 2 | level
    return out


#: Weights with which every text sets out: the three short contexts, alike in all sets; the last set, of bits that
#: the long context foretells, trusts that one.
START = np.full((GATES + 1, 4), 0.4, np.float32)
START[:, 3] = 0
START[GATES] = (0.1, 0.1, 0.1, 1.2)
RATE, PULL, REFINE = np.float32(1.0), np.float32(20), np.float32(150)


def cost_of(tables: list[np.ndarray], stream: Stream, long: np.ndarray | None = None) -> np.ndarray:
    """Bits that a stream costs in each text; long has the logits of the long context, if there is one."""
    slots, bits, off = stream
    packed = np.empty((len(bits), 4), np.int16)  # what each bit takes from the tables, and the bit: read together
    packed[:, 3] = bits
    for i in range(0, len(bits), _CHUNK):
        for k, (table, at) in enumerate(zip(tables, slots)):
            packed[i : i + _CHUNK, k] = table.take(at[i : i + _CHUNK])
    whole = packed.view(np.int64).ravel()

    def read(at: np.ndarray | slice) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        own = whole[at] if isinstance(at, slice) else whole.take(at)
        part = own.view(np.int16).reshape(-1, 4)
        x = [part[:, k] * UNIT for k in range(3)]
        gate = own >> 14 & 12 | own >> 32 & 3  # the last two bits of the second and of the third
        if long is not None:
            x.append(long[at] if isinstance(at, slice) else long.take(at))
            gate[x[3] != 0] = GATES
        return x, gate, part[:, 3].astype(np.float32)

    return coded(read, off, START[:, : len(slots) + (long is not None)])


def mixed(x: list[np.ndarray], bit: np.ndarray, gate: np.ndarray, off: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bits each text costs; x are the predictors' logits, gate says which set of weights each bit uses, start has
    the weights of each set at first."""
    return coded(lambda at: ([a[at] for a in x], gate[at].astype(np.int64), bit[at].astype(np.float32)), off, start)


def coded(read: Callable, off: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bits each text costs, coded block by block in all texts at once. read gives of the bits at some places the
    predictors' logits, the sets of weights, and the bits. Longer texts come first, so that those not yet at their
    end always do."""
    sets, inputs = start.shape
    length = np.diff(off)
    by = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
    length, begin = length[by], off[by]
    weight = [np.tile(w, len(by)) for w in start.T]
    ones, all_ = np.zeros(len(by) * CELLS, np.float32), np.full(len(by) * CELLS, REFINE)
    cost, live, size, done = np.zeros(len(by)), len(by), 32, 0
    while live:
        n = np.minimum(size, length[:live] - done)
        head = np.cumsum(n) - n
        row = np.repeat(np.arange(live), n)
        if live == 1:
            at = slice(begin[0] + done, begin[0] + done + n[0])
        else:
            at = np.repeat(begin[:live] + done - head, n)
            at += np.arange(len(at))
        own, key, said = read(at)
        key += row * sets
        logit = weight[0].take(key)
        logit *= own[0]
        for w, a in zip(weight[1:], own[1:]):
            part = w.take(key)
            part *= a
            logit += part
        np.clip(logit, -13, 13, out=logit)
        p = np.exp(-logit)
        p += 1
        np.divide(1, p, out=p)
        row *= CELLS
        row += (logit + np.float32(16.5)).astype(np.int64)
        q = p * REFINE
        q += ones.take(row)
        q /= all_.take(row)
        np.clip(q, 1e-6, 1 - 1e-6, out=q)
        q += said - np.float32(1)  # q, or 1 - q of a zero
        np.abs(q, out=q)
        cost[:live] -= np.add.reduceat(np.log(q, out=q), head, dtype=np.float64)
        miss = np.subtract(said, p, out=p)
        m = live * sets
        pull = RATE / (np.bincount(key, minlength=m) + PULL)
        for w, a in zip(weight, own):
            w[:m] += np.bincount(key, weights=a * miss, minlength=m) * pull
        np.add.at(all_, row, np.float32(1))
        np.add.at(ones, row, said)
        done += size
        size = min(max(32, done // 8), 1 << 14)
        live = int(np.searchsorted(-length, -done))
    out = np.zeros(len(off) - 1)
    out[by] = cost / np.log(2)
    return out


def _scored(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables = shared.value
        # once a worker, as large arrays of numpy's own are on huge pages and those of a pickle are not
        tables[:], code.word = ([a if a.flags.owndata else a.copy() for a in part] for part in (tables, code.word))
        known = np.log10(np.r_[code.counts, 0] + 0.1)
        known[-1] = 0
        part, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            alone = pc.is_null(batch.column(3))
            for b in slices([batch.filter(alone), batch.filter(pc.invert(alone))], "text", _SLICE):
                t = Tokens.of(code, b.column(2))
                words, n_path = word_bits(code, t)
                long = spelt = extra = None
                if b.column(3).null_count < b.num_rows:
                    long, spelt, extra = matched(code, t, n_path, words[1], b.column(3))
                cost = cost_of(tables, words, long)
                del words, long
                cost += cost_of(tables, byte_bits(code, t, spelt))
                if extra is not None:
                    cost += extra
                text = np.repeat(np.arange(b.num_rows), np.diff(t.off))
                rare = t.place == len(code.hashes)
                hot = np.bincount(text, weights=known[t.place], minlength=b.num_rows)
                n_rare = np.bincount(text[rare], minlength=b.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_rare)].astype(np.int32)), pa.array(t.h[rare].view(np.int64)))
                n = np.diff(t.off)
                columns = [pa.array(part + row + np.arange(b.num_rows)), b.column(0), b.column(1), pa.array(n), pa.array(n - n_rare), pa.array(hot), pa.array(-cost * np.log10(2)), pa.array(np.diff(t.w.doc)), lists]
                row += b.num_rows
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_hot", "hot", "score", "n_bytes", "rare"])

    return run


def long_contexts(places: DataFrame, total: int, store) -> DataFrame:
    """uid and found, a list of (key, follow, n), from the anchors (uid, key, follow, n) of all rows, `total` in number.

    n of the result is how many learned rows other than the row itself have follow after key. The most common
    follow counts; of equally common ones, that of the largest hash, or for the row that has it the smallest.
    Only keys in two rows or more, one of them learned, can say anything; what follows the others isn't moved twice.
    store(df, name) writes and rereads a table.
    """
    many = store(places.groupBy("key").agg(F.sum("n").alias("known"), F.count("*").alias("rows")).where("rows > 1 and known > 0").select("key", "rows"), "many")
    met = store(join_by_weight(places, many, ["key"], "rows", total), "met")
    by = met.groupBy("key", "follow").agg(F.sum("n").alias("n"), F.first("rows").alias("rows")).withColumn("q", F.xxhash64("follow"))
    most = lambda q: F.max(F.struct("n", q.alias("q"), "follow"))
    tops = store(by.groupBy("key").agg(F.first("rows").alias("rows"), most(F.col("q")).alias("a"), most(F.bitwise_not("q")).alias("b")).where("a.n > 0"), "tops")
    met = join_by_weight(met.select("uid", "key", F.col("follow").alias("own"), F.col("n").alias("learned")), tops, ["key"], "rows", total)
    mine = (F.col("learned") > 0) & (F.col("own") == F.col("a.follow"))
    other = F.col("a.follow") != F.col("b.follow")
    says = F.when(mine & other, F.struct("b.n", "b.follow")).when(mine, F.struct((F.col("a.n") - 1).alias("n"), "a.follow")).otherwise(F.struct("a.n", "a.follow"))
    met = met.select("uid", "key", says.alias("says")).where("says.n > 0")
    return met.groupBy("uid").agg(F.collect_set(F.struct("key", F.col("says.follow").alias("follow"), F.col("says.n").alias("n"))).alias("found"))


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits and bits_per_byte for each row.

    Learns from the rows where held_out is false. score is the model's log10 probability of the text, bits the
    same as binary digits in all; bits_per_byte is null for a text without bytes.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", held_out.alias("held_out"), "text")
    learned = rows.where("not held_out").select("text")
    raw = stored(rows.select("uid", "held_out", "text").mapInArrow(_gathered, "kind int, key long, n long, uid long, follow binary"), f"{path}/raw")
    counted = raw.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = stored(counted, f"{path}/tokens")
    places = raw.where("kind = 2").select("uid", "key", "follow", "n")
    found = stored(long_contexts(places, places.count(), lambda df, name: stored(df, f"{path}/{name}")), f"{path}/found")
    discard(spark, *(f"{path}/{name}" for name in ("raw", "many", "met", "tops")))
    vocabulary = counted.where("kind = 0").select("key", "n")
    letters = np.zeros(257, np.int64)
    for r in counted.where("kind = 1").collect():  # 257 rows
        letters[r["key"]] = r["n"]
    # The least count whose tokens, with all more frequent ones, are at most HOT. Counts are tallied by size.
    tally = vocabulary.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("types"), F.sum("n").alias("total")).collect()
    types, total = sum(r["types"] for r in tally), sum(r["total"] for r in tally)
    least, room = 1 << 16, HOT - 1
    for r in sorted(tally, key=lambda r: -r["n"]):
        if r["types"] > room:
            break
        least, room = r["n"], room - r["types"]
    end = int(END.view(np.int64))
    hot = vocabulary.where((F.col("n") >= least) | (F.col("key") == end)).toArrow()  # at most HOT rows
    code = Code.of(hot.column(0).to_numpy().view(np.uint64), hot.column(1).to_numpy(), total, letters)

    shared = spark.sparkContext.broadcast(code)  # of bounded size: HOT tokens and their codes
    planes = learned.mapInArrow(_counted(shared), "kind int, block int, planes binary")
    symbols = len(code.rank)
    seen = [np.zeros(n * g, np.float32) for (n, _, _), g in zip(_CLASSES, (len(groups(code, BROAD)[1]), symbols, len(groups(code, NEAR)[1]), symbols))]
    seen += [np.zeros(2 << n, np.float32) for n in SPELL_BITS]
    summed = planes.repartition("kind", "block").mapInArrow(_summed, "kind int, block int, counts binary")
    for r in summed.toLocalIterator():
        part, at = np.frombuffer(r["counts"], np.float32), r["block"] * _BLOCK
        seen[r["kind"]][at : at + len(part)] = part
    tables = [logits(slot_counts(code, seen, k)) for k in range(3)]
    del planes, summed, seen
    discard(spark)
    shared.unpersist()
    shared = spark.sparkContext.broadcast((code, tables))  # of fixed size: the sum of sizes(), two bytes each
    kind = rows.schema["doc_id"].dataType.simpleString()
    asked = rows.join(found.withColumnRenamed("uid", "_u"), F.col("uid") == F.col("_u"), "left").select("doc_id", "held_out", "text", "found")
    scored = asked.mapInArrow(_scored(shared), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_hot long, hot double, score double, n_bytes long, rare array<long>")
    scored = stored(scored, f"{path}/scored")
    discard(spark, f"{path}/found")

    rare = scored.select("row", F.explode("rare").alias("key"))
    cold = rare.join(vocabulary.where(F.col("n") < least), "key", "left")
    by = cold.groupBy(F.col("row").alias("_row")).agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("cold"), F.count("n").alias("n_cold"))
    out = scored.drop("rare").join(by, F.col("row") == F.col("_row"), "left")
    base = F.col("hot") + F.coalesce("cold", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(total + 0.1 * (types + 1)))
    n_known = (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).cast("long")
    bits = -F.col("score") * float(np.log2(10))
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits"), F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))
