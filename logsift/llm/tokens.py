"""Token ids of the public byte-level BPE vocabulary, per whitespace chunk.

The vocabulary's pre-tokeniser never joins characters across the boundary
before ``' x'`` or around a run of white space, so a text can be cut there and
each chunk encoded by itself; chunks repeat, so their ids are kept in a bounded
table per Python worker.  The ids equal the ``tokenizers`` library's
(tests/llm/test_text_operators.py compares them).
"""

from __future__ import annotations

import base64
import re

import public_tokenizers

# white space as the vocabulary's pattern has it (Unicode White_Space; fixed values)
_WS = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# the vocabulary's one special token and its id (fixed values)
SPECIAL = {"<|endoftext|>": 50256}
MAX_CACHED = 400_000        # chunks kept per worker
MAX_CACHED_CHARS = 64       # longer chunks are encoded each time


def byte_bpe(ranks_path: str | None = None):
    """tiktoken encoding of the rank file (the vocabulary of byte_bpe_50k.json)."""
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens=SPECIAL)


class Chunks(dict):
    """chunk -> value of ``fn(chunk)``, kept up to a fixed number of entries."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, chunk):
        v = self.fn(chunk)
        if len(self) < MAX_CACHED and len(chunk) <= MAX_CACHED_CHARS:
            self[chunk] = v
        return v


_ENCODERS: dict = {}


def id_bytes(ranks_path: str | None = None):
    """Function text -> ids as little-endian unsigned 32-bit values."""
    if ranks_path not in _ENCODERS:
        import numpy as np

        enc = byte_bpe(ranks_path)
        chunks = Chunks(lambda c: np.array(enc.encode_ordinary(c), "<u4").tobytes())
        whole = CHUNK.findall
        special = next(iter(SPECIAL))
        mark = np.array([SPECIAL[special]], "<u4").tobytes()

        def encode(text: str) -> bytes:
            if special in text:     # a special token ends the text before it
                return mark.join(encode(t) for t in text.split(special))
            return b"".join(map(chunks.__getitem__, whole(text)))

        _ENCODERS[ranks_path] = encode
    return _ENCODERS[ranks_path]
