"""Byte-level BPE ids equal to those of the ``tokenizers`` library.

Two libraries read the same vocabulary; the rank-table one is about four times as
fast. It is used for texts made of characters on which both split alike, and the
``tokenizers`` library itself for every other text (control characters, scripts
outside Latin, the special token's string).
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

SPECIAL = "<|endoftext|>"
#: Characters outside this set go to the ``tokenizers`` library.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]")
#: A run of white space longer than this goes there too (backtracking of the fast matcher).
_LONG_SPACE = re.compile(r"\s{2000}")


def odd_text(text: str) -> bool:
    return SPECIAL in text or _UNUSUAL.search(text) is not None or _LONG_SPACE.search(text) is not None


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str, plain_specials: bool = False):
    """The library's tokenizer; with ``plain_specials``, special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain_specials
    return found


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encode_ids(text: str, json_path: str, ranks_path: str | None, pattern: str | None) -> np.ndarray:
    """Token ids of a whole text, without added special tokens, as little-endian uint32."""
    if ranks_path and not odd_text(text):
        return np.array(rank_encoder(ranks_path, pattern).encode_ordinary(text), dtype="<u4")
    return np.array(library_tokenizer(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
