"""Byte-level BPE ids of a public vocabulary file in `tokenizers` JSON form.

The ids are those of Tokenizer.from_file(path).encode(text, add_special_tokens=False). They are computed
by tiktoken over the same file's vocabulary, about four times as fast; a text that holds the string of an
added token goes through `tokenizers` itself, which alone knows those. A test holds the two equal.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

#: The split of the byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        self.path = path
        self.added = [t["content"] for t in model["added_tokens"]]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def full(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    """The encoder of this process."""
    return ByteBpe(path or default_path())
