"""Exact SentencePiece BPE as best paths in a lattice of pieces, in max-plus algebra.

A sequence of pieces is what the merge procedure makes of its text exactly if this holds for each pair of
neighbours alone. So encoding is a best path: an arc (piece a, piece b) weighs 0 if merging the text of both
gives back (a, b), and minus infinity if not; one path over a text has a finite weight. Weights of stretches
are matrices from the pieces that can hold their left edge to those that can hold their right edge; they
combine by the max-plus product, which is associative, so chunks of a text can be treated apart.

Texts fall into units that no piece crosses: a run of spaces with what follows it, and what stands before and
after a line break (which this vocabulary has no piece for). Units are looked up in a cache; new ones are
solved together, position by position, in numpy.
"""

from __future__ import annotations

import functools
import re

import numpy as np

SPACE_MARK = "▁"
_UNITS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|\n|[^{SPACE_MARK}\n]+")
_NEVER = float("-inf")
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
CACHE_UNITS, LONG_UNIT, _PAIR_BITS = 150_000, 200, 20


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: the best weight from each row of a to each column of b."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), _NEVER)


def raw_pieces(model) -> list[bytes]:
    """The bytes that each id stands for; none for control pieces."""
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        none = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        out.append(bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if none else p.replace(SPACE_MARK, " ").encode())
    return out


def text_of(raw: list[bytes], ids) -> str:
    """The text of ids, without the space that stands before every text."""
    whole = b"".join(map(raw.__getitem__, ids))
    return (whole[1:] if whole.startswith(b" ") else whole).decode("utf-8", "replace")


class Lattice:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.rank = {p: (-model.get_score(i), i) for i, p in enumerate(self.pieces) if plain[i]}
        self.unknown = n  # stands for any character without a piece
        self.texts = [p if plain[i] else None for i, p in enumerate(self.pieces)] + ["\0\0"]
        self.ids: dict[str, int] = {}
        for p, (_, i) in self.rank.items():
            if len(p) == 1 or self.merged(p) == [p]:
                self.ids[p] = i
        self.longest = max(map(len, self.ids))
        self.raw = raw_pieces(model)
        self.cache: dict[str, bytes] = {}
        self.pair_key = np.full(1 << _PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << _PAIR_BITS, bool)
        self._index()

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself: the best-ranked neighbouring pair, leftmost first, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best[0]):
                    best = (r, i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    @functools.lru_cache(100_000)
    def fits(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a. a is -1 at the start of a unit."""
        if a < 0 or a == self.unknown or b == self.unknown:
            return True
        x, y = self.texts[a], self.texts[b]
        return self.merged(x + y) == [x, y]

    # the vocabulary as sorted hashes of all prefixes of its pieces

    def _index(self) -> None:
        found: dict[int, int] = {}
        for p, i in self.ids.items():
            h = 0
            for k, c in enumerate(p):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & (2**64 - 1)
                found[h] = i if k == len(p) - 1 else found.get(h, -1)
        keys = np.array(sorted(found), np.uint64)
        self.prefix = np.append(keys, np.uint64(0))
        self.prefix_id = np.array([found[int(h)] for h in keys], np.int32)
        # an open-addressed table of their places, four times as large
        self.shift = np.uint64(62 - len(keys).bit_length())
        self.table = np.full((1 << (64 - int(self.shift))) + 64, len(keys), np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), (keys * _SPREAD >> self.shift).astype(np.int64)
        while len(todo):
            free = self.table[at] == len(keys)
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            todo, at = todo[lost], at[lost] + 1

    def _prefixes(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the prefixes, or their number."""
        none = len(self.prefix_id)
        at = (h * _SPREAD >> self.shift).astype(np.int64)
        found = self.table.take(at)
        todo = np.flatnonzero((found != none) & (self.prefix.take(found) != h))
        while len(todo):
            at[todo] += 1
            own = self.table.take(at[todo])
            found[todo] = own
            todo = todo[(own != none) & (self.prefix.take(own) != h[todo])]
        return found

    def _matches(self, points: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece that starts at each position, or -1. room: characters to the unit's end."""
        active, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        out = []
        for k in range(self.longest):
            inside = room[active] > k
            active, h = active[inside], h[inside]
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[active + k] + np.uint64(1)
            at = self._prefixes(h)
            ok = at < len(self.prefix_id)
            ids = np.full(len(points), self.unknown if k == 0 else -1, np.int32)
            ids[active[ok]] = self.prefix_id[at[ok]]
            if k == 0:
                ids[ids < 0] = self.unknown
            out.append(ids)
            active, h = active[ok], h[ok]
            if not len(active):
                break
        return out

    def _pairs_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (1 << 20) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        out = self.pair_fits.take(slot)
        if len(miss := np.flatnonzero(self.pair_key.take(slot) != key)):
            keys, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            new = np.array([self.fits(int(a[i]), int(b[i])) for i in miss[first]], bool)
            out[miss] = new[back]
            self.pair_key[slot[miss]], self.pair_fits[slot[miss]] = key[miss], out[miss]
        return out

    def _solve(self, units: list[str]) -> list[bytes]:
        """Ids of short units' best paths, all of them advanced by one position at a time."""
        size = np.array([len(u) for u in units])
        order = np.argsort(-size, kind="stable")
        begin = np.cumsum(size) - size
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        room = np.repeat(begin + size, size) - np.arange(len(points))
        match = self._matches(points, room)
        last = np.full(len(points) + len(units), -2, np.int32)  # piece that ends before each position
        span = np.zeros(len(last), np.int8)
        at = begin + np.arange(len(units))
        last[at] = -1
        for p in range(1, int(size.max()) + 1):
            live = order[: int((size >= p).sum())]
            first, base = begin[live], at[live]
            for k in range(1, min(p, len(match)) + 1):
                piece, before = match[k - 1].take(first + (p - k)), last.take(base + (p - k))
                ok = np.flatnonzero((piece >= 0) & (before != -2))
                if p > k:
                    ok = ok[self._pairs_fit(before[ok], piece[ok])]
                to = base[ok] + p
                last[to], span[to] = piece[ok], k
        # walk back from all ends at once; a unit with a character that has no piece is written out singly
        count, steps = np.zeros(len(units), np.int64), []
        live, here = np.arange(len(units)), at + size
        while len(live):
            piece = last[here]
            steps.append((live, piece))
            count[live] += 1
            here = here - span[here]
            on = here > at[live]
            live, here = live[on], here[on]
        off = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(off[-1], np.int32)
        for k, (live, piece) in enumerate(steps):
            flat[off[live + 1] - 1 - k] = piece
        raw = flat.astype("<u2").tobytes()
        out = [raw[2 * a : 2 * b] for a, b in zip(off.tolist(), off[1:].tolist())]
        gaps = np.flatnonzero(flat == self.unknown)
        for i in np.unique(np.searchsorted(off, gaps, side="right") - 1).tolist():
            path, p = [], 0
            for b in flat[off[i] : off[i + 1]].tolist():
                path.append(b if b != self.unknown else -ord(units[i][p]))
                p += 1 if b == self.unknown else len(self.texts[b])
            out[i] = self.flat(path)
        return out

    def walk(self, text: str, start: int, last: int, stop: int) -> dict[int, tuple[int, int]]:
        """Position -> (piece that ends there, its start), for all positions reached from `start`, where
        piece `last` ends, by pieces that start before `stop`."""
        reached = {start: (last, -1)}
        for p in range(start, min(stop, len(text))):
            if p not in reached:
                continue
            a = reached[p][0]
            for k in range(1, min(self.longest, len(text) - p) + 1):
                b = self.ids.get(text[p : p + k], self.unknown if k == 1 else -1)
                if b >= 0 and self.fits(a, b):
                    reached[p + k] = (b, p)
        return reached

    def path(self, text: str, reached: dict[int, tuple[int, int]], end: int) -> list[int]:
        out = []
        while (step := reached[end])[1] >= 0:
            out.append(step[0] if step[0] != self.unknown else -ord(text[step[1]]))
            end = step[1]
        return out[::-1]

    def flat(self, path: list[int]) -> bytes:
        """Ids as little-endian 16 bit, characters without a piece as their bytes."""
        ids: list[int] = []
        for b in path:
            if b >= 0:
                ids.append(b)
            else:
                ids.extend(self.bytes[x] for x in chr(-b).encode())
        return np.array(ids, "<u2").tobytes()

    def learn(self, units: set[str]) -> None:
        """Solves the units that the cache doesn't hold."""
        new = list(units.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_UNITS:
            # short units come back most; the rest make room
            kept = {u: v for u, v in self.cache.items() if len(u) <= 8 or u in units}
            self.cache = kept if len(kept) + len(new) <= CACHE_UNITS else {u: v for u, v in kept.items() if u in units}
        short = [u for u in new if len(u) <= LONG_UNIT]
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            self.cache.update(zip(part, self._solve(part)))
        for u in new:
            if len(u) > LONG_UNIT:
                self.cache[u] = self.flat(self.path(u, self.walk(u, 0, -1, len(u)), len(u)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        units = [_UNITS.findall(marked(t)) if t else [] for t in texts]
        out: list[np.ndarray] = []
        step = 1024
        for i in range(0, len(units), step):
            part = units[i : i + step]
            self.learn(set().union(*part))
            out += [np.frombuffer(b"".join(map(self.cache.__getitem__, u)), "<u2") for u in part]
        return out

    def decode(self, ids) -> str:
        return text_of(self.raw, ids)

    # chunks of a giant text; positions count characters of the marked text

    def holders(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The pieces that can hold a cut: (start, piece) with start before the cut and end at or after it."""
        out = []
        for p in range(max(0, cut - self.longest), cut):
            for k in range(max(1, cut - p), min(self.longest, len(text) - p) + 1):
                b = self.ids.get(text[p : p + k], self.unknown if k == 1 else -1)
                if b >= 0:
                    out.append((p, b))
        return out

    def _end(self, holder: tuple[int, int]) -> int:
        return holder[0] + (1 if holder[1] == self.unknown else len(self.texts[holder[1]]))

    def transfer(self, text: str, left: int, right: int, first: bool) -> np.ndarray:
        """Weights from the holders of the cut `left` to those of the cut `right`.

        The first chunk of a text has one holder, its start. Where a unit begins inside the chunk, all
        paths meet: the matrix is the sum of a column and a row.
        """
        into = [(left, -1)] if first else self.holders(text, left)
        out = self.holders(text, right)
        at = {h: j for j, h in enumerate(out)}
        meet = self._meeting(text, left, right)
        weight = np.full((len(into), len(out)), _NEVER)
        ends: dict[tuple[int, int], list[int]] = {}

        def reach(start: int, last: int, stop: int) -> tuple[dict, list[int]]:
            reached = self.walk(text, start, last, stop)
            exits = []
            for p, (a, _) in reached.items():
                if p < stop:
                    for k in range(1, min(self.longest, len(text) - p) + 1):
                        b = self.ids.get(text[p : p + k], self.unknown if k == 1 else -1)
                        if b >= 0 and p + k >= stop and (p, b) in at and self.fits(a, b):
                            exits.append(at[p, b])
            return reached, exits

        if meet is not None:
            row = np.full(len(out), _NEVER)
            row[reach(meet[1], -1, right)[1]] = 0
        for i, holder in enumerate(into):
            start = left if first else self._end(holder)
            if meet is None or start > meet[0]:
                if start >= right:
                    if holder in at:
                        weight[i, at[holder]] = 0
                else:
                    weight[i, reach(start, holder[1], right)[1]] = 0
            elif start == meet[0] or meet[0] in self.walk(text, start, holder[1], meet[0]):
                weight[i] = row
        return weight

    def _meeting(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """The first and last position in a chunk where a unit begins, away from its edges."""
        low, high = left + self.longest, right - self.longest
        begins = [m.start() for m in re.finditer(f"(?<=[^{SPACE_MARK}]){SPACE_MARK}", text[low:high])] if high > low else []
        return (low + begins[0], low + begins[-1]) if begins else None

    def between(self, text: str, left: int, right: int, holder: tuple[int, int] | None, leaves: tuple[int, int]) -> bytes:
        """Ids of the pieces that start at the cut `left` or later and before the cut `right`, once it is
        known which piece holds either cut. holder is None at the start of the text."""
        start, last = (left, -1) if holder is None else (self._end(holder), holder[1])
        if holder is not None and holder == leaves:
            return b""
        meet = self._meeting(text, left, right)
        piece = self.flat([leaves[1] if leaves[1] != self.unknown else -ord(text[leaves[0]])])
        if meet is None or start > meet[0]:
            return self.flat(self.path(text, self.walk(text, start, last, leaves[0]), leaves[0])) + piece
        head = self.path(text, self.walk(text, start, last, meet[0]), meet[0])
        middle = _UNITS.findall(text[meet[0] : meet[1]])
        tail = self.path(text, self.walk(text, meet[1], -1, leaves[0]), leaves[0])
        self.learn(set(middle))
        return self.flat(head) + b"".join(map(self.cache.__getitem__, middle)) + self.flat(tail) + piece


def marked(text: str) -> str:
    return SPACE_MARK + text.replace(" ", SPACE_MARK)


def _model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


@functools.lru_cache(2)
def lattice(path: str | None = None) -> Lattice:
    """The lattice of this process."""
    return Lattice(_model_path(path))


@functools.lru_cache(2)
def decoder(path: str | None = None) -> list[bytes]:
    """What decoding needs, without the lattice's tables."""
    from sentencepiece import SentencePieceProcessor

    return raw_pieces(SentencePieceProcessor(model_file=_model_path(path)))
