"""Token ids and byte spans of whole texts with a public byte-level BPE.

The vocabulary is read from ``public_tokenizers`` (the file is a parameter and
never copied). Ids are those of the ``tokenizers`` library with
``add_special_tokens=False``. Texts of ASCII and Latin letters alone (code
points below U+0380) go through ``tiktoken`` with the same ranks, which gives
the same ids faster; texts with any other character, curly quotes included, or
with the name of an added token in them (``<|endoftext|>``) go through
``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: bytes that start characters beyond those blocks, and rare separators
_OTHER = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xce-\xff]|\xc2[\x80-\x9f]")


class ByteBpe:
    """Build one in each task: ``ids(text bytes)`` and ``lengths`` of tokens in bytes."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        added = {number: token.content.encode() for number, token in self._slow.get_added_tokens_decoder().items()}
        self._added = re.compile(b"|".join(map(re.escape, added.values()))) if added else None
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max([*ranks.values(), *added]) + 1, dtype=np.int64)
        for rank, token in [*added.items(), *((rank, token) for token, rank in ranks.items())]:
            self.lengths[rank] = len(token)

    def ids(self, b: bytes | None) -> np.ndarray:
        """uint32 ids of the whole text; null and empty texts have none."""
        if not b:
            return np.zeros(0, dtype="<u4")
        text = b.decode("utf-8")
        if _OTHER.search(b) or self._added and self._added.search(b):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self._fast.encode_ordinary(text), dtype="<u4")
