"""Byte-level BPE from a public ``tokenizer.json``, with byte spans, for use inside tasks."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
#: Where two white-space characters never meet, this splits a text as the full pattern does, without its look-ahead.
SINGLE_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    stand for themselves, the rest follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Ids as the tokenizers library gives them without special tokens added.

    The vocabulary of the file is run by tiktoken's merge loop, several times as fast; a text
    that holds an added token's own string goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = byte_of()
        ranks = {bytes(known[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {word: i for word, i in ranks.items() if i not in added.values()}
        full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        single = tiktoken.Encoding("single", pat_str=SINGLE_SPACED, mergeable_ranks=ranks, special_tokens={})
        self.full, self.single = full._core_bpe.encode_ordinary, single._core_bpe.encode_ordinary
        self.path, self.slow = path, None
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        self.spaces = re.compile(r"\s\s")
        size = 1 + max([*ranks.values(), *added.values()])
        self.vocabulary: list[bytes] = [b""] * size
        for word, i in [*ranks.items(), *((c.encode(), i) for c, i in added.items())]:
            self.vocabulary[i] = word
        self.n_bytes = np.array([len(x) for x in self.vocabulary], np.int64)

    def encode(self, text: str) -> np.ndarray:
        if self.added.search(text):
            self.slow = self.slow or Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        run = self.full if self.spaces.search(text) else self.single
        return np.array(run(text), np.uint32)


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)


def default_path() -> str:
    return public_tokenizers.path(BYTE_BPE)
