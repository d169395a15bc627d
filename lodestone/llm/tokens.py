"""Token ids of the public byte-level BPE, by the fastest library that is exact.

``tokenizers`` defines the ids.  ``tiktoken`` holds the same vocabulary and is
several times faster, but its tables of letters and digits may be of another
Unicode version; it is used for texts whose characters all lie in ranges that
have been the same in every version (a test compares all of them), and
``tokenizers`` for the rest.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Printable and control ASCII, Latin-1, Latin Extended-A, basic Greek and Cyrillic letters, common punctuation.
_SETTLED = re.compile(r"[^\x00-\x7f\xa0-ſΑ-ΡΣ-ωА-я–—‘’“”…]")


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _exact(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=4)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("lodestone", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """Encoder and decoder; a special token's string in a text is ordinary text."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        self.path = path or public("byte_bpe_50k.json")
        self.ranks = ranks or public("byte_bpe_50k.tiktoken")

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if _SETTLED.search(text) is None:
            return _fast(self.ranks).encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(_exact(self.path).encode(text, add_special_tokens=False).ids, np.uint32)

    def decode_bytes(self, ids) -> bytes:
        return _fast(self.ranks).decode_bytes(ids)
