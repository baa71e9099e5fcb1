"""Byte-level BPE ids equal to those of the tokenizers library for ``byte_bpe_50k.json``.

The merges are run from the same vocabulary in rank form, which is several times faster; the tests
hold both against each other.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

END = "<|endoftext|>"
END_ID = 50256


@lru_cache(1)
def encoding(path: str | None = None) -> tiktoken.Encoding:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={END: END_ID})


@lru_cache(1)
def token_bytes() -> list[bytes]:
    """The bytes of every id."""
    own = encoding()
    return [*map(own.decode_single_token_bytes, range(own.n_vocab))]


def ids_of(text: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; the special string inside a text is its own id."""
    return encoding().encode_to_numpy(text, allowed_special="all")
